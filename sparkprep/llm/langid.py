"""Language identification by words first, then by ever shorter character n-grams.

A language model holds, per language, the log frequency of its known words and of
character n-grams of one to five characters (words are padded with a space on
either side). A known word scores by its own frequency in each language; an
unseen word is scored by its longest n-grams that are known, falling back one
character at a time. A text's score in a language is the mean over its words.

The classifier is fitted on a bounded sample: about ``SAMPLE_ROWS`` labelled
documents of each language, all if it has no more, chosen by a hash of id and text
where they are read, so that no text is shuffled for it; equal rows are chosen
together. The model
keeps at most ``MODEL_WORDS`` words and ``MODEL_GRAMS`` n-grams a language and
length, the most frequent. The tables so bounded are broadcast. Every document is
scored over its whole text.

Defined results: ``und`` with score 0 for a text that is null or has no letter;
the same for all texts if nothing is labelled. Ties go to the language that comes
first in code-point order. Rows with a null label are not learned from; equal rows
get equal results; an empty table gives an empty result. Only the named columns
are read, and predictions use the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import spare

SAMPLE_ROWS = 1500
MODEL_WORDS = 20_000
MODEL_GRAMS = 20_000
LENGTHS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
# What a text's evidence is worth: words beyond so many add no more certainty.
EVIDENCE_WORDS = 8

LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 400_000


@dataclass
class Model:
    """Log frequencies of words and n-grams: where each one's row is, and a row per item with a number per language."""

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """The mean over a word's longest known n-grams; even if it has none."""
        padded = f" {word} "
        for n in LENGTHS:
            found = [g for g in (self.grams.get(padded[i : i + n]) for i in range(len(padded) - n + 1)) if g is not None]
            if found:
                return self.gram_rows[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def word(self, word: str) -> np.ndarray:
        """A word's log frequency in each language; of its longest known n-grams if it is unseen."""
        row = self.words.get(word)
        return self.unseen(word) if row is None else self.word_rows[row]

    def predict(self, text: str) -> tuple[str, float]:
        return Predictor(self).predict(text)


class Predictor(dict):
    """A model in use: rows of its words, and of unseen words met so far."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        """Back to the model's own words."""
        model = self.model
        self.clear()
        self.update(model.words)
        self.rows = np.concatenate([model.word_rows, np.zeros((1024, len(model.languages)))])

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[row] = self.model.unseen(word)
        self[word] = row
        return row

    def predict(self, text: str) -> tuple[str, float]:
        words = Counter(LETTERS.findall(text.lower()))
        languages = self.model.languages
        # digits like a superscript two are no letters, though they are no decimal digits either
        if not languages or not any(c.isalpha() for word in words for c in word):
            return UNDETERMINED, 0.0
        if len(self) > len(self.model.words) + CACHED_WORDS:
            self.forget()
        counts = np.fromiter(words.values(), dtype=float, count=len(words))
        at = [self[word] for word in words]
        scores = counts @ self.rows[at] * (min(counts.sum(), EVIDENCE_WORDS) / counts.sum())
        chances = np.exp(scores - scores.max())
        best = int(np.argmax(scores))
        return languages[best], float(chances[best] / chances.sum())


@lru_cache(maxsize=1)
def _predictor(shared) -> Predictor:
    """One per broadcast model and Python worker."""
    return Predictor(shared.value)


def _log_shares(rows: list, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies from (language, item, count) rows: each item's row number, and the rows."""
    at = {language: i for i, language in enumerate(languages)}
    items = {item: i for i, item in enumerate(dict.fromkeys(item for _, item, _ in rows))}
    counts = np.zeros((len(items), len(languages)))
    for language, item, count in rows:
        counts[items[item], at[language]] += count
    floor = 0.5
    return items, np.log((counts + floor) / (counts.sum(axis=0) + floor * max(1, len(items))))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``doc_id, text, lang`` rows; rows without text or label are left out."""
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    # one row per language; the share of its documents to be sampled
    shares = {r.lang: min(1.0, sample_rows / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    sample = rows.where(place < share).select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for language, own in frame.groupby("lang", sort=False):
                words = Counter()
                for text in own["text"]:
                    words.update(LETTERS.findall(text.lower()))
                yield pd.DataFrame({"lang": language, "word": list(words), "n": list(words.values())})

    words = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    cuts = [F.transform(F.sequence(F.lit(1), F.length("padded") - n + 1), lambda i, n=n: F.substring(F.col("padded"), i, F.lit(n))) for n in LENGTHS]
    cuts = [F.when(F.length("padded") >= n, cut).otherwise(F.array().cast("array<string>")) for n, cut in zip(LENGTHS, cuts)]
    padded = words.withColumn("padded", F.concat(F.lit(" "), "word", F.lit(" ")))
    grams = padded.select("lang", "n", F.explode(F.concat(*cuts)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def frequent(items: DataFrame, item: str, most: int, *also) -> list:
        best = Window.partitionBy("lang", *also).orderBy(F.desc("n"), item)
        top = items.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)
        return [tuple(r) for r in top.select("lang", item, "n").collect()]

    known, parts = frequent(words, "word", MODEL_WORDS), frequent(grams, "gram", MODEL_GRAMS, F.length("gram"))
    languages = sorted({r[0] for r in known})
    grams, rows = {}, [np.zeros((0, len(languages)))]
    for n in LENGTHS:
        items, shares = _log_shares([r for r in parts if len(r[1]) == n], languages)
        first = len(grams)
        grams |= {item: first + i for item, i in items.items()}
        rows.append(shares)
    return Model(languages, *_log_shares(known, languages), grams, np.concatenate(rows))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``lang_pred`` and ``lang_score`` put after them (columns so named are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def run(column: pd.Series) -> pd.DataFrame:
        use = _predictor(shared)
        found = [use.predict(t if isinstance(t, str) else "") for t in column]
        return pd.DataFrame(found, columns=["lang_pred", "lang_score"])

    guess = spare("guess", docs.columns)
    kept = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "lang_score")]
    guessed = docs.withColumn(guess, run(F.col(text)))
    return guessed.select(*kept, f"{guess}.lang_pred", f"{guess}.lang_score")
