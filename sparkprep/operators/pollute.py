"""Fault injection: missing cells, scaled outliers, repeated rows.

Every decision hashes a row key with a salt, so a run can be repeated, does not
depend on partitioning and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.cells import NUMBER, STRING, hash_fraction, is_missing, quoted, to_number

# Fixed values of the pollution recipe.
MISSING_SHARE, OUTLIER_SHARE, DUPLICATE_SHARE, OUTLIER_FACTOR = 0.4, 0.2, 0.2, 100


def inject_missing(
    df: DataFrame,
    types: Mapping[str, str],
    key: Column,
    share: float = MISSING_SHARE,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Blank a share of all cells: '' in string columns, NULL in others."""
    chosen = set(columns or df.columns)
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in chosen:
            textual = types.get(f.name) == STRING and isinstance(f.dataType, T.StringType)
            blank = F.lit("") if textual else F.lit(None).cast(f.dataType)
            if isinstance(f.dataType, T.VariantType):
                blank = F.parse_json(F.lit("null"))
            c = F.when(hash_fraction(key, f"missing|{f.name}", share), blank).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(*out)


def inject_outliers(
    df: DataFrame,
    types: Mapping[str, str],
    key: Column,
    share: float = OUTLIER_SHARE,
    factor: float = OUTLIER_FACTOR,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Multiply a share of the filled cells of number columns by ``factor``."""
    chosen = set(columns or df.columns)
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in chosen and types.get(f.name) == NUMBER:
            x = to_number(c, f.dataType) * factor
            scaled = x.cast("string") if isinstance(f.dataType, T.StringType) else x
            hit = hash_fraction(key, f"outlier|{f.name}", share) & ~is_missing(c, f.dataType)
            rest = c if isinstance(f.dataType, T.StringType) else c.cast("double")
            c = F.when(hit, scaled).otherwise(rest).alias(f.name)
        out.append(c)
    return df.select(*out)


def inject_duplicates(df: DataFrame, key: Column, share: float = DUPLICATE_SHARE) -> DataFrame:
    """Append a share of the rows once more, in one pass over the input."""
    copies = F.when(hash_fraction(key, "duplicate", share), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(copies).alias("__copy")).drop("__copy")


def pollute(df: DataFrame, types: Mapping[str, str], key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells, then outliers, then repeated rows; all columns by default.

    The key is copied first, so its own column can be polluted too.
    """
    names = list(columns or df.columns)
    out = df.withColumn("__key", quoted(key).cast("string"))
    k = F.col("__key")
    return (
        out.transform(inject_missing, types, k, columns=names)
        .transform(inject_outliers, types, k, columns=names)
        .transform(inject_duplicates, k)
        .drop("__key")
    )
