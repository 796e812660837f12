"""Mixing sources to target weights along a time-varying curriculum.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. Together they
take as many words as the input has; a source gets its share by weight, but no
more than ``cap`` times its own words, and what that leaves over is shared again
by weight. In closed form: with sources ordered by cap * size / weight, those at
the front are full and the rest get one common multiple of their weight.

A source's documents stand in a fixed random order (a hash of id and text) and
are repeated until its target is met, so each gets whole copies and the last one
taken may be cut. A weight schedule says how a source's share moves over the
training time [0, 1]; its integral is the cumulative word demand, and inverting
it at the words before a copy gives that copy's position. Documents are then
range-sorted by position.

Prefix sums over a source are taken in two levels, words per hash bucket and
words within a bucket, so no task sees a whole source. The table of sources (one
row each) and of buckets (one row per some thousand documents) are small.

Defined results: a null or blank text has size 0 and nothing is taken of it; a
source without words has target 0; an empty table gives an empty result; equal
rows are taken one after another; ties in the order are broken by id and size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import WORD_PATTERN, spare
from sparkprep.session import materialise

Schedule = Sequence[tuple[float, float]]

WEIGHTS = (1.0, 2.0, 3.0)
# Relative weight at points of the training time: early, even and late sources in turn.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
CAP = 3.0
BUCKET_ROWS = 4096


def _pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Per linear piece: start, cumulative share there, weight there, slope, cumulative share at its end."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    if area <= 0 or min(w for _, w in schedule) < 0 or schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule runs from 0 to 1 with weights that are not negative and not all 0")
    done, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        share = (t1 - t0) * (w0 + w1) / 2 / area
        pieces.append((t0, done, w0 / area, (w1 - w0) / area / (t1 - t0), done + share))
        done += share
    return pieces


def position_at(share: Column, schedule: Schedule) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its total."""
    at = None
    pieces = _pieces(schedule)
    for start, before, weight, slope, after in reversed(pieces):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * rest, F.lit(0.0)))
        # rest = weight * x + slope * x * x / 2, solved without cancellation
        here = F.lit(start) + F.coalesce(F.try_divide(2 * rest, F.lit(weight) + root), F.lit(0.0))
        at = here if at is None else F.when(share < F.lit(after), here).otherwise(at)
    return F.least(at, F.lit(1.0))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size`` with ``rank`` (from 0) and ``target``: one row per source, in windows over that small table."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    fullness = cap * F.col("source_size") / F.col("weight")
    ranked = ranked.withColumn("fullness", fullness)
    before = Window.orderBy("fullness", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("multiple", rest / heavy).withColumn("full", F.col("multiple") >= F.col("fullness"))
    common = F.min_by(F.when(~F.col("full"), F.col("multiple")), F.when(~F.col("full"), F.struct("fullness", "rank"))).over(everything)
    target = F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.col("weight") * F.col("common"))
    return ranked.withColumn("common", common).select("source", "source_size", "rank", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    schedules: Sequence[Schedule] = SCHEDULES,
    keep: bool = False,
    seed: int = 1,
) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, and the positions of its copies.

    ``positions`` has an entry per copy taken, the cut one included. With ``keep``
    a struct column ``document`` holds the whole input row.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    # 53 of the hash's bits as a number in [0, 1)
    place = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if keep else []
    sized = docs.select("doc_id", "source", size.alias("size"), order.alias("order"), *whole).withColumn("place", place)
    narrow = materialise(sized.drop("document"), "mix-sizes")
    per_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n_buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    plan = targets(per_source, weights, cap).join(per_source.select(F.col("source").alias("s"), n_buckets.alias("n_buckets")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = materialise(plan, "mix-targets").withColumnRenamed("source", "name")

    def bucketed(rows: DataFrame) -> DataFrame:
        joined = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        return joined.withColumn("bucket", F.floor(F.col("place") * F.col("n_buckets")))

    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed(narrow).groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select("rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("rank", "bucket").orderBy("place", "order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = bucketed(sized if keep else narrow).join(offsets, ["rank", "bucket"])
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = rows.withColumn("start", start).withColumn("wanted", F.floor("target").cast("long"))
    epochs = F.coalesce(F.expr("try_divide(wanted - wanted % nullif(source_size, 0), source_size)"), F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    cut = F.least(F.greatest(F.col("wanted") - F.col("epochs") * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("cut", cut.cast("long")).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + (F.col("cut") > 0).cast("long")).otherwise(0))

    def position(i: Column) -> Column:
        share = (i * F.col("source_size") + F.col("start")) / F.col("wanted")
        at = position_at(share, schedules[-1])
        for k in range(len(schedules) - 1):
            at = F.when(F.col("rank") % len(schedules) == k, position_at(share, schedules[k])).otherwise(at)
        return at

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    taken = (F.col("epochs") * F.col("size") + F.col("cut")).cast("long")
    names = [F.col(c) for c in ("doc_id", "size", "source_size", "target")]
    extra = [F.col("cut"), F.col("document")] if keep else []
    return rows.select(*names, taken.alias("taken"), positions.alias("positions"), *extra)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per copy, range-sorted by position.

    The copy that a source's target cuts holds the words up to the cut, joined by
    single spaces; all others hold their text unchanged.
    """
    mixed = mix(docs, keep=True, **options)
    copies = mixed.select("*", F.posexplode("positions").alias("copy", "position"))
    is_cut = (F.col("cut") > 0) & (F.col("cut") < F.col("size")) & (F.col("copy") == F.size("positions") - 1)
    words = F.slice(F.regexp_extract_all("document.text", F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.greatest(F.col("cut"), F.lit(1)).cast("int"))
    text = F.when(is_cut, F.array_join(words, " ")).otherwise(F.col("document.text"))
    kept = [(text if c == "text" else F.col(f"document.`{c}`")).alias(c) for c in docs.columns]
    order = spare("order", docs.columns)
    hidden = F.struct("position", "doc_id", "copy").alias(order)
    return copies.select(*kept, hidden).repartitionByRange(order).sortWithinPartitions(order).drop(order)
