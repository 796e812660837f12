"""Metric documents of a run, and quality metrics over time windows.

A metric document is (run_id, source, ts, contents) with JSON text as contents.
The functions work on streams and on batch tables alike.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.cells import NUMBER, is_missing, quoted
from sparkprep.operators.robust import ColumnStats, numeric_cells

# The five origins whose documents complete a run.
ORIGINS = ("source_observer", "target_observer", "planning_engine", "pre_etl_pipeline", "post_etl_pipeline")


def latest_metrics(documents: DataFrame) -> DataFrame:
    """The newest document per run and origin; equal times go to the larger text.

    Partial maxima are taken before the shuffle, so a busy run costs one record
    per task.
    """
    return (
        documents.groupBy("run_id", "source")
        .agg(F.max(F.struct("ts", "contents")).alias("last"))
        .select("run_id", "source", "last.ts", "last.contents")
    )


def run_documents(documents: DataFrame) -> DataFrame:
    """One row per run: the newest contents per origin, and its time span."""
    newest = [F.max(F.when(F.col("source") == o, F.struct("ts", "contents"))).alias(o) for o in ORIGINS]
    return (
        documents.groupBy("run_id")
        .agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), *newest)
        .select("run_id", "started", "ended", *[F.col(f"{o}.contents").alias(o) for o in ORIGINS])
    )


def complete_runs(documents: DataFrame) -> DataFrame:
    """Runs for which all five origins have reported."""
    seen = reduce(lambda a, b: a & b, [F.col(o).isNotNull() for o in ORIGINS])
    return run_documents(documents).filter(seen)


def _sum(parts: list[Column]) -> Column:
    return F.sum(reduce(lambda a, b: a + b, parts, F.lit(0).cast("bigint")))


def windowed_quality(
    events: DataFrame,
    ts: str,
    width: str,
    delay: str,
    types: Mapping[str, str],
    stats: Mapping[str, ColumnStats],
    window_origin: str = "0 seconds",
) -> DataFrame:
    """Quality per tumbling window of event time, closed ``delay`` after its end.

    Medians cannot be kept incrementally, so outliers are judged by the given
    statistics, taken from a reference table or an earlier batch. Missing cells
    and outliers are plain sums that a window keeps as running state.
    """
    cells = [f for f in events.schema.fields if f.name != ts]
    numbers = [f.name for f in cells if types.get(f.name) == NUMBER]
    missing = [is_missing(quoted(f.name), f.dataType).cast("bigint") for f in cells]
    outliers = [stats[c].is_outlier(numeric_cells(events, c)).cast("bigint") for c in numbers]
    n_cells, n_numbers = len(cells), max(len(numbers), 1)
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width, startTime=window_origin).alias("span"))
        .agg(F.count(F.lit(1)).alias("n_rows"), _sum(missing).alias("n_missing"), _sum(outliers).alias("n_outliers"))
        .select(
            F.col("span.start").alias("window_start"),
            "n_rows",
            F.round(F.col("n_missing") * 100.0 / (F.col("n_rows") * n_cells), 3).alias("missing_pct"),
            F.round(F.col("n_outliers") * 100.0 / (F.col("n_rows") * n_numbers), 3).alias("outlier_pct"),
        )
    )


def first_copies(events: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """Drop repeats of the same keys that arrive within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
