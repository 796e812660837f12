"""Subword lattice likelihood of documents.

A document is a sequence of words (lower-cased A-Z) and one end. A word's
probability mixes its count in the training documents with a subword lattice:

    P(w) = (c(w) + V * L(w)) / (N + V)

with N training tokens of V kinds (Witten and Bell's weight for the unseen).
L(w) is the probability that the vocabulary's pieces spell w, marginal over all
segmentations, by a forward recursion in log space; the empty word, spelled by no
piece, is the document's end. The vocabulary is an existing one; its scores give
each piece a prior weight of one over its place in the order of scores, to which
the pieces of the distinct training words are added, as new words resemble kinds
rather than tokens.

Documents differ in their words, so a document's own distribution is taken to be
drawn around P (Dirichlet, weight ``CONCENTRATION``); its score is the marginal
probability over these draws, which depends on word counts alone, times that of
the end. Both factors are proper probabilities: over all texts they sum to no more
than 1. (The add-one base gives every unseen word the share of a known one and so
sums to more than 1; on small corpora with many unseen words it can exceed the
model for that reason.)

``lattice_score`` is the pure lattice marginal beside it: the product of L over the
document's words and its end, without word counts and without a Dirichlet factor.

Nothing whole passes through one task: texts are cut into blocks of bounded size,
a block's distinct words are counted together over all blocks by word, and come
back to the block as numbers, never as text. Only piece weights (bounded by the
vocabulary) and the two totals reach the driver.

Defined results: a null or blank text has the end as its only token; without any
training document N and V are 0 and P(w) is L(w). Equal rows give equal results,
rows with a null id belong to the training part, an empty table gives an empty
result. Only id and text are read, so other columns never clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import WORDS, texts
from sparkprep.session import materialise

BLOCK_CHARS = 24_000_000
CONCENTRATION = 1000.0
START = "▁"
LN10 = math.log(10.0)


def lower_words(text: str) -> list[str]:
    """Words with A-Z in lower case; bytes.lower() leaves all other characters alone."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


@lru_cache(maxsize=2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def usable(piece: str) -> bool:
    """Pieces that can spell a word after its start mark: no inner mark, no capital A-Z."""
    return START not in piece[1:] and not any("A" <= c <= "Z" for c in piece)


class Lattice:
    """Piece weights and the forward recursion over them."""

    def __init__(self, model: bytes, counts: np.ndarray, words: float):
        """``counts``: how often each piece spelled a training word; ``words``: how many words those were."""
        sp = processor(model)
        ids = range(sp.get_piece_size())
        of_bytes = {i for i in ids if sp.is_byte(i)}
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and (i in of_bytes or usable(sp.id_to_piece(i)))]
        plain.sort(key=lambda i: (-sp.get_score(i), i))
        prior = {i: 1.0 / (k + 1) for k, i in enumerate(plain)}
        scale = 100.0 / sum(prior.values())
        weight = {i: counts[i] + prior[i] * scale for i in plain}
        total = sum(weight.values())
        # pieces stand for a step that goes on, the stop for one that ends
        go = math.log(total / (total + words + 1.0))
        self.stop = math.log((words + 1.0) / (total + words + 1.0))
        self.pieces = {sp.id_to_piece(i): math.log(weight[i] / total) + go for i in plain if i not in of_bytes}
        self.bytes = [-50.0] * 256
        for i in plain:
            if i in of_bytes:
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = math.log(weight[i] / total) + go
        self.longest = max(map(len, self.pieces))
        self.single = {p for p in self.pieces if len(p) == 1}

    def log_probability(self, word: str) -> float:
        """Natural log of L(word), summed over all segmentations."""
        if not word:
            return self.stop
        spelled, pieces, longest = START + word, self.pieces, self.longest
        size = len(spelled)
        arriving: list[list[float]] = [[] for _ in range(size + 1)]
        arriving[0].append(0.0)
        for i in range(size):
            terms = arriving[i]
            if not terms:
                continue
            top = max(terms)
            here = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
            arriving[i] = ()
            for j in range(i + 1, min(size, i + longest) + 1):
                step = pieces.get(spelled[i:j])
                if step is not None:
                    arriving[j].append(here + step)
            if spelled[i] not in self.single:
                arriving[i + 1].append(here + sum(self.bytes[b] for b in spelled[i].encode("utf-8", "replace")))
        top = max(arriving[size])
        return top + math.log(sum([math.exp(t - top) for t in arriving[size]])) + self.stop


@lru_cache(maxsize=2)
def lattice(model: bytes, counts: bytes, words: float) -> Lattice:
    return Lattice(model, np.frombuffer(counts), words)


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _packed(words: np.ndarray) -> bytes:
    """A document's distinct word numbers and their counts."""
    kinds, counts = np.unique(words, return_counts=True)
    return zlib.compress(np.concatenate([np.diff(kinds, prepend=0), counts]).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i4")
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """Per document its word numbers, per block and word the word's number and training count; one pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        index, trained, rows, chars, block = _Index(), [], [], 0, first

        def flush() -> Iterator[pd.DataFrame]:
            sums = np.bincount(np.concatenate(trained), minlength=len(index)) if trained else np.zeros(len(index), "i8")
            if index:
                yield pd.DataFrame({"block": block, "doc_id": None, "held_out": None, "packed": None, "word": list(index), "number": np.arange(len(index), dtype="i4"), "n": sums.astype("i8")})
            ids, out, packed = zip(*rows)
            yield pd.DataFrame({"block": block, "doc_id": pd.Series(ids, dtype=object), "held_out": out, "packed": packed, "word": None, "number": None, "n": None})

        for frame, batch in texts(frames):
            for doc, out, text in zip(frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None), frame["held_out"], batch):
                words = np.array(list(map(index.__getitem__, lower_words(text))), dtype="i8")
                rows.append((doc, bool(out), _packed(words)))
                if not out and len(words):
                    trained.append(words)
                chars += len(text)
                if chars >= block_chars:
                    yield from flush()
                    index, trained, rows, chars, block = _Index(), [], [], 0, block + 1
        if rows:
            yield from flush()

    schema = f"block long, doc_id {kind}, held_out boolean, packed binary, word string, number int, n long"
    return docs.select("doc_id", "text", "held_out").mapInPandas(run, schema)


def _piece_counts(words: DataFrame, shared) -> tuple[np.ndarray, float]:
    """How often each piece occurs in the distinct training words, and how many these are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = processor(shared.value)
        sums, seen = np.zeros(sp.get_piece_size() + 1, "i8"), 0
        for frame in frames:
            for ids in sp.encode(list(frame["word"]), num_threads=1):
                np.add.at(sums, ids, 1) if len(ids) > 64 else _add(sums, ids)
            seen += len(frame)
        sums[-1] = seen
        held = np.flatnonzero(sums)
        yield pd.DataFrame({"piece": held, "n": sums[held]})

    rows = words.select("word").mapInPandas(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    size = processor(shared.value).get_piece_size()
    counts = np.zeros(size + 1)
    for piece, n in rows:
        counts[piece] = n
    return counts[:-1], float(counts[-1])


def _add(sums: np.ndarray, ids: list[int]) -> None:
    for i in ids:
        sums[i] += 1


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def document_score(log_p: np.ndarray, n: np.ndarray, concentration: float) -> float:
    """Log10 of the marginal probability of words that occur ``n`` times, with natural log probabilities ``log_p``."""
    log_a = log_p + math.log(concentration)
    total = float(log_a.sum()) + math.lgamma(concentration) - math.lgamma(concentration + float(n.sum()))
    again = n > 1
    if again.any():
        # Gamma(a + n) / Gamma(a) = a (a + 1) ... (a + n - 1), where a is one factor already
        a = np.exp(log_a[again])
        total += float((_log_gamma(a + n[again]) - _log_gamma(a + 1.0)).sum())
    return total / LN10


def score(docs: DataFrame, held_out: Column, model: bytes, block_chars: int = BLOCK_CHARS, concentration: float = CONCENTRATION) -> DataFrame:
    """Log10 probability of every document under the unigram base, the model and the lattice alone.

    ``held_out`` marks the documents that are scored but not learned from; ``model``
    is the contents of a sentencepiece vocabulary file.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = materialise(_blocks(marked, block_chars), "lm-blocks")
    rows = blocks.where("word is null").select("block", "doc_id", "held_out", "packed")
    words = blocks.where("word is not null").select("word", "block", "number", "n")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    ends = rows.where("not held_out").count()
    known = counts.where("c > 0")
    total, kinds = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    shared = spark.sparkContext.broadcast(model)
    pieces, spelled = _piece_counts(known, shared)
    weights = spark.sparkContext.broadcast(pieces.tobytes())

    @F.pandas_udf("double")
    def spelling(column: pd.Series) -> pd.Series:
        of = lattice(shared.value, weights.value, spelled)
        return pd.Series([of.log_probability(w) for w in column], dtype="float64")

    weighed = counts.withColumn("l", spelling("word"))
    back = words.select("word", "block", "number").join(weighed, "word").select(F.col("block").alias("of"), "number", "c", "l")

    def score_block(frame: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        size = len(numbers)
        c, l = np.zeros(size), np.zeros(size)
        c[numbers["number"]], l[numbers["number"]] = numbers["c"], numbers["l"]
        base = np.log10((c + 1.0) / (total + kinds + 1.0))
        log_p = _mixed(c, l, total, kinds)
        end_base = math.log10((ends + 1.0) / (total + kinds + 1.0))
        stop = lattice(shared.value, weights.value, spelled).stop
        end_mixed = float(_mixed(np.array([float(ends)]), np.array([stop]), total, kinds)[0]) / LN10
        out = []
        for packed in frame["packed"]:
            i, n = _unpacked(packed)
            out.append((int(n.sum()) + 1, int(n[c[i] > 0].sum()) + (ends > 0), float(base[i] @ n) + end_base, document_score(log_p[i], n, concentration) + end_mixed, (float(l[i] @ n) + stop) / LN10))
        n_tokens, n_known, base_score, scores, pure = zip(*out) if out else ((), (), (), (), ())
        return pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_tokens": n_tokens, "n_known": n_known, "train_tokens": total, "base_score": base_score, "score": scores, "lattice_score": pure})

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(score_block, schema)


def _mixed(c: np.ndarray, l: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Natural log of (c + V L) / (N + V), in log space so that no spelling underflows."""
    if not kinds:
        return l
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(c), math.log(kinds) + l) - math.log(total + kinds)
