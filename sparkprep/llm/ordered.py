"""Running totals and streams over ordered groups, with no group bound to one task's memory."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.session import materialise

ROWS_A_BATCH = 2000


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], totals: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """The rows with, per entry of ``totals``, an aggregate over the earlier rows of their group.

    ``totals`` names a column and gives (aggregate, value); aggregates are ``sum``,
    ``max`` and ``bit_xor``, and an aggregate over no row is NULL. ``order`` should
    tell the rows of a group apart; rows equal in it come in any order.

    Rows are range-partitioned by group and order, so that a group of any size is
    spread over tasks; each piece is scanned by itself and starts from the total of
    the group's earlier pieces. A border between partitions cuts one group at most,
    so there are fewer than two such carried rows a partition, which bounds what is
    broadcast. The rows are written once, which pins their partitions. Columns named
    ``piece``, ``carry..`` and ``value..`` are the function's own.
    """
    functions = {"sum": F.sum, "max": F.max, "bit_xor": F.bit_xor}
    values = [v.alias(f"value{i}") for i, (_, v) in enumerate(totals.values())]
    placed = rows.select("*", *values).repartitionByRange(*group, *order)
    placed = materialise(placed.withColumn("piece", F.spark_partition_id()), "running")
    whole = [functions[f](f"value{i}").alias(f"carry{i}") for i, (f, _) in enumerate(totals.values())]
    earlier = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(*group, "piece").agg(*whole).withColumn("pieces", F.count("*").over(Window.partitionBy(*group))).where("pieces > 1")
    carried = pieces.select(
        *[F.col(g).alias(f"carry_{g}") for g in group],
        F.col("piece").alias("carry_piece"),
        *[functions[f](f"carry{i}").over(earlier).alias(f"carry{i}") for i, (f, _) in enumerate(totals.values())],
    )
    same = F.col("piece") == F.col("carry_piece")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"carry_{g}"))
    within = Window.partitionBy(*group, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[functions[f](f"value{i}").over(within).alias(f"local{i}") for i, (f, _) in enumerate(totals.values())])
    joined = local.join(F.broadcast(carried), same, "left")
    out = []
    for i, (name, (f, _)) in enumerate(totals.items()):
        here, before = F.col(f"local{i}"), F.col(f"carry{i}")
        if f == "max":
            total = F.greatest(here, before)
        else:
            both = here + before if f == "sum" else here.bitwiseXOR(before)
            total = F.coalesce(both, here, before)
        out.append(total.alias(name))
    return joined.select(*[F.col(c) for c in rows.columns], *out)


def streamed(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows brought together by ``keys`` and sorted within them, for tasks that read one group after another."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Each group of a sorted stream: its first ``keys`` fields, and an iterator over its rows, which may span batches."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_A_BATCH):
                yield from zip(*[c.to_pylist() for c in batch.slice(start, ROWS_A_BATCH).columns])

    return groupby(rows(), key=itemgetter(*range(keys)) if keys > 1 else lambda row: (row[0],))


def batched(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Output rows as record batches of bounded length and text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= ROWS_A_BATCH or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
