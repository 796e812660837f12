"""Cleaning: missing values, duplicate rows, numeric outliers."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.cells import (
    BOOLEAN,
    NOT_AVAILABLE,
    NUMBER,
    comparable,
    is_missing,
    is_nested_type,
    is_numeric_type,
    quoted,
    to_number,
)
from sparkprep.operators.robust import ColumnStats, numeric_cells, outlier_stats

# What imputation writes, by logical type ("" = any other type).
IMPUTE_DEFAULTS: dict[str, object] = {NUMBER: 0.0, "": NOT_AVAILABLE}
BASELINE_DEFAULTS: dict[str, object] = {NUMBER: 0.0, BOOLEAN: False, "": NOT_AVAILABLE}


class StepFailed(ValueError):
    """A cleaning step cannot run on this table."""


def numeric_columns(df: DataFrame, types: Mapping[str, str]) -> list[str]:
    """Columns whose logical type is ``number``, in column order."""
    return [c for c in df.columns if types.get(c) == NUMBER]


def _filled(c: Column, dtype: T.DataType, default: object) -> Column:
    """The cell, or the default where it is missing.

    A column that cannot hold the default changes type: lists and objects become
    variants, dates and numbers become text.
    """
    missing = is_missing(c, dtype)
    if isinstance(dtype, T.StringType):
        return F.when(missing, F.lit(str(default))).otherwise(c)
    if is_nested_type(dtype) or isinstance(dtype, T.VariantType):
        raw = c if isinstance(dtype, T.VariantType) else F.to_variant_object(c)
        return F.when(missing, F.parse_json(F.lit(json.dumps(default)))).otherwise(raw)
    is_flag = isinstance(default, bool) and isinstance(dtype, T.BooleanType)
    is_number = isinstance(default, float) and is_numeric_type(dtype)
    if is_flag or is_number:
        return F.coalesce(c, F.lit(default).cast(dtype))
    return F.coalesce(c.cast("string"), F.lit(str(default)))


def impute_missing(
    df: DataFrame, types: Mapping[str, str], defaults: Mapping[str, object] = IMPUTE_DEFAULTS
) -> DataFrame:
    """Fill missing cells: 0.0 in number columns, ``NA`` elsewhere."""
    out = []
    for f in df.schema.fields:
        default = defaults.get(types.get(f.name, ""), defaults[""])
        out.append(_filled(quoted(f.name), f.dataType, default).alias(f.name))
    return df.select(*out)


def any_missing(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(quoted(f.name), f.dataType) for f in df.schema.fields])


def drop_missing_rows(df: DataFrame) -> DataFrame:
    return df.filter(~any_missing(df))


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and missing cells per column, in one aggregate."""
    fields = df.schema.fields
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(quoted(f.name), f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)],
    ).first()
    return row["n"], {f.name: row[f"m{i}"] for i, f in enumerate(fields)}


def drop_missing_columns(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Drop every column whose share of missing cells exceeds ``threshold``."""
    n, missing = missing_counts(df)
    return df.select(*[quoted(c) for c in df.columns if missing[c] <= threshold * n])


def drop_duplicates(df: DataFrame, order: str | None = None) -> DataFrame:
    """Keep one row per distinct content; with ``order``, the first by that column.

    ``order`` is an ingest number outside the content. The content columns are
    the grouping keys, so the copies of a row collapse on the map side and a row
    that fills a third of the table costs one record per task.
    """
    content = [c for c in df.columns if c != order]
    special = [c for c in content if isinstance(df.schema[c].dataType, (T.VariantType, T.MapType))]
    keys = [quoted(c) for c in content if c not in special]
    keys += [comparable(quoted(c), df.schema[c].dataType).alias(f"__key_{i}") for i, c in enumerate(special)]
    aggs = [F.any_value(quoted(c)).alias(c) for c in special]
    if order is not None:
        aggs.append(F.min(quoted(order)).alias(order))
    if not aggs:
        return df.dropDuplicates()
    return df.groupBy(*keys).agg(*aggs).select(*[quoted(c) for c in df.columns])


def unreadable_counts(df: DataFrame, types: Mapping[str, str]) -> dict[str, int]:
    """Cells per number column, missing ones included, that are not numbers."""
    names = numeric_columns(df, types)
    if not names:
        return {}
    row = df.agg(
        *[
            F.count_if(to_number(quoted(c), df.schema[c].dataType).isNull()).alias(f"u{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    return {c: row[f"u{i}"] for i, c in enumerate(names)}


def check_readable(df: DataFrame, types: Mapping[str, str]) -> None:
    """Strict outlier handling needs a number in every cell of a number column."""
    bad = {c: n for c, n in unreadable_counts(df, types).items() if n}
    if bad:
        raise StepFailed(f"cells that are not numbers: {bad}")


def flag_outliers(
    df: DataFrame, types: Mapping[str, str], stats: Mapping[str, ColumnStats] | None = None, suffix: str = "_outlier"
) -> DataFrame:
    """Add one boolean per number column."""
    names = numeric_columns(df, types)
    stats = outlier_stats(df, names) if stats is None else stats
    return df.select("*", *[stats[c].is_outlier(numeric_cells(df, c)).alias(c + suffix) for c in names])


def impute_outliers(
    df: DataFrame,
    types: Mapping[str, str],
    stats: Mapping[str, ColumnStats] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Replace outliers by their column's median, all columns in one projection.

    Integer columns become double, because a median may fall between integers.
    """
    if strict:
        check_readable(df, types)
    names = numeric_columns(df, types)
    stats = outlier_stats(df, names) if stats is None else stats
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in names:
            x = numeric_cells(df, f.name)
            median = F.lit(stats[f.name].median)
            textual = isinstance(f.dataType, T.StringType)
            cell = c if textual else to_number(c, f.dataType)
            median = median.cast("string") if textual else median
            c = F.when(stats[f.name].is_outlier(x), median).otherwise(cell).alias(f.name)
        out.append(c)
    return df.select(*out)


def drop_outliers(
    df: DataFrame, types: Mapping[str, str], sequential: bool = True, strict: bool = False
) -> DataFrame:
    """Drop rows that hold an outlier.

    Sequentially (the default), the rows dropped for one column no longer count
    in the next column's median. Each step adds one filter on literals, so the
    chain stays a single scan with pushed-down columns and never shuffles.
    """
    if strict:
        check_readable(df, types)
    names = numeric_columns(df, types)
    if not sequential:
        stats = outlier_stats(df, names)
        return df.filter(~reduce(lambda a, b: a | b, [stats[c].is_outlier(numeric_cells(df, c)) for c in names], F.lit(False)))
    for c in names:
        stats = outlier_stats(df, [c])
        df = df.filter(~stats[c].is_outlier(numeric_cells(df, c)))
    return df
