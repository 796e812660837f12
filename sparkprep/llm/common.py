"""Helpers that several operators share."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)
# Upper-case ASCII letters to lower case; other characters stay.
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(key: str, folds: int, of: str) -> Column:
    """``crc32`` of a column's text modulo ``folds``, compared with ``of``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == int(of), F.lit(False))


def held_out(key: str, folds: int) -> Column:
    """Rows whose crc32(key as text) leaves remainder 2; rows without a key are not held out."""
    return fold(key, folds, "2")


def spare(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores added until no column has it (names differ in more than case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def parts(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def texts(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """Each batch with its texts, null read as empty."""
    for frame in frames:
        yield frame, [t if isinstance(t, str) else "" for t in frame[column]]
