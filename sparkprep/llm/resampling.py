"""Quality selection by importance resampling.

Two bag-of-n-grams models over ``BINS`` hashed words and word pairs are counted:
one on target texts (documents labelled good, ``TARGET_IDS`` of them at most), one on all raw texts. A document's
log importance weight is the log ratio of its probability under the two. Adding
Gumbel noise to the weights and keeping the k largest sums draws k documents
without replacement in proportion to their weights.

Counts cover all words of all texts; each task returns at most ``BINS`` sums. The
k-th largest sum is found by counting in ever finer ranges, so rows are never
sorted or gathered. The noise is a hash of id and text: reruns agree.

Defined results: a null or blank text has no n-grams and log weight 0; without a
target text all weights are 0, which is plain sampling; rows without an id are
treated like others. ``k`` is the rounded share of all rows. Ties at the k-th sum,
as equal rows give, are all selected. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import WORDS, texts
from sparkprep.session import materialise

BINS = 10_000
SHARE = 0.5
SMOOTHING = 1.0
# Target documents that the target model is fitted on, at most; their ids are broadcast.
TARGET_IDS = 100_000
RANGES = 1024


@lru_cache(maxsize=300_000)
def _word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def bins(text: str, size: int = BINS) -> np.ndarray:
    """The hashed bin of every word and every pair of neighbouring words."""
    words = np.array([_word(w) for w in WORDS.findall(text.lower())], dtype="u8")
    pairs = (words[:-1] * np.uint64(0x9E3779B1) + words[1:]) % np.uint64(4294967291)
    return np.concatenate([words % np.uint64(size), pairs % np.uint64(size)]).astype("i8")


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bin occurs in target and in raw texts; one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BINS), dtype="i8")
        for frame, batch in texts(frames):
            for good, text in zip(frame["good"], batch):
                own = np.bincount(bins(text), minlength=BINS)
                sums[1] += own
                if good:
                    sums[0] += own
        for model in (0, 1):
            held = np.flatnonzero(sums[model])
            yield pd.DataFrame({"model": model, "bin": held, "n": sums[model][held]})

    rows = docs.select("text", "good").mapInPandas(run, "model int, bin int, n long").groupBy("model", "bin").agg(F.sum("n").alias("n"))
    out = np.zeros((2, BINS))
    for model, place, n in rows.collect():
        out[model, place] = n
    return out[0], out[1]


def _kth_largest(scores: DataFrame, k: int) -> float | None:
    """The k-th largest ``score``, by counts in ranges that narrow around it."""
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    if k >= n:
        return low
    if k < 1:
        return None
    wanted = k
    while low < high:
        step = (high - low) / RANGES
        place = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(step)), F.lit(RANGES - 1)) if step > 0 else F.lit(0)
        inside = scores.where(F.col("score").between(low, high))
        found = inside.groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy(F.desc("r")).collect()
        for r in found:
            if wanted <= r.n:
                narrower = (r.low, r.high) != (low, high)
                low, high = r.low, r.high
                break
            wanted -= r.n
        if not narrower:
            break
    return low


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = 1) -> DataFrame:
    """``doc_id, n_grams, log_weight, score, selected`` for every document.

    ``target_ids`` holds the ids of the target documents in its column ``doc_id``; the
    target model is fitted on those ``TARGET_IDS`` with the least hashes, the raw model
    on all documents.
    """
    good = target_ids.select(F.col("doc_id").alias("__good")).distinct().orderBy(F.xxhash64("__good"), "__good").limit(TARGET_IDS)
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left")
    marked = marked.select("doc_id", "text", F.col("__good").isNotNull().alias("good"))
    target, raw = _counts(marked)
    ratio = np.zeros(BINS)
    if target.sum():
        ratio = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BINS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BINS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, batch in texts(frames):
            found = [bins(t) for t in batch]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "noise": frame["noise"], "n_grams": [len(b) for b in found], "log_weight": [float(shared.value[b].sum()) for b in found]})

    noisy = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("noise"))
    weighed = noisy.mapInPandas(weigh, f"doc_id {kind}, noise long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned("noise", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = weighed.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("score"))
    scored = materialise(scored, "weights")
    least = _kth_largest(scored, round(share * scored.count()))
    return scored.withColumn("selected", F.lit(False) if least is None else F.col("score") >= F.lit(least))
