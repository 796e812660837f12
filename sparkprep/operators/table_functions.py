"""User table functions: named, registered callables instead of code as text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.cells import quoted
from sparkprep.session import materialise

_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def table_function(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a DataFrame function under a name that a plan can mention."""

    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        _REGISTRY[name] = fn
        return fn

    return register


def pandas_table_function(
    name: str, schema: T.StructType | str
) -> Callable[[Callable[[pd.DataFrame], pd.DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a function of Pandas batches; Spark feeds it partition by partition.

    Batches are independent, so the function must work row by row or batch by
    batch; anything that needs the whole table belongs in DataFrame operators.
    """

    def register(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield fn(part)

        def run(df: DataFrame) -> DataFrame:
            return df.mapInPandas(batches, schema)

        _REGISTRY[name] = run
        return run

    return register


def get_table_function(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in _REGISTRY:
        raise ValueError(f"no table function named {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


@dataclass(frozen=True)
class Isolated:
    """What a function made of the rows it could take, and the rows it failed on (``record``, ``error``)."""

    good: DataFrame
    failed: DataFrame


RECORD, ERROR = "__record", "__error"


def isolate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> Isolated:
    """Run a function of Pandas batches so that the rows it fails on do not stop the rest.

    A batch that raises is halved until single rows are left that raise by
    themselves: ``f`` failing rows among ``n`` cost about ``f log n`` calls. Such a row
    comes out as JSON with its error's text; the function must work row by row.
    The result is written once, so that both outputs come from the same run of the
    function. Faults of the engine are raised as ever.
    """
    taken = {RECORD, ERROR} & {*df.columns, *schema.names}
    if taken:
        raise ValueError(f"column names kept for failed rows: {sorted(taken)}")
    record = F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})
    whole = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    whole = whole.add(RECORD, T.StringType()).add(ERROR, T.StringType())

    def tried(part: pd.DataFrame, made: list[pd.DataFrame], lost: list[tuple[str, str]]) -> None:
        try:
            made.append(fn(part.drop(columns=RECORD).reset_index(drop=True)))
        except Exception as error:  # noqa: BLE001 - user functions may raise anything
            if len(part) == 1:
                lost.append((part[RECORD].iloc[0], f"{type(error).__name__}: {error}"))
                return
            half = len(part) // 2
            tried(part.iloc[:half], made, lost)
            tried(part.iloc[half:], made, lost)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made, lost = [], []
            if len(part):
                tried(part, made, lost)
            if made:
                yield pd.concat(made, ignore_index=True).assign(**{RECORD: None, ERROR: None})[whole.names]
            if lost:
                none = {c: [None] * len(lost) for c in schema.names}
                yield pd.DataFrame(none | {RECORD: [r for r, _ in lost], ERROR: [e for _, e in lost]}, dtype=object)

    out = materialise(df.withColumn(RECORD, record).mapInPandas(run, whole), "isolated")
    good = out.where(F.col(ERROR).isNull()).select(*[quoted(c) for c in schema.names])
    return Isolated(good, out.where(F.col(ERROR).isNotNull()).select(F.col(RECORD).alias("record"), F.col(ERROR).alias("error")))
