"""Predicates and conversions on single cells.

Four kinds of "no value" are kept apart until the sink: NULL and the empty
string are *missing*; ``_ext_`` marks a key that a JSON object lacked or a
column that the mapping created; ``NA`` is what imputation writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
ABSENT = "_ext_"
NOT_AVAILABLE = "NA"
NUMBER, STRING, BOOLEAN, COMPLEX, AMBIGUOUS = (
    "number",
    "string",
    "boolean",
    "complex",
    "ambiguous",
)
MAD_THRESHOLD = 3

# Text that counts as a number: decimal literals with optional exponent, digit
# groups joined by single underscores, signed infinities and nan. Spark's own
# cast would also take a type suffix (``1d``) and hexadecimal floats.
# Possessive quantifiers keep long texts from being scanned twice.
_DIGITS = r"[0-9]++(?:_[0-9]++)*+"
NUMBER_PATTERN = (
    rf"^\s*+[+-]?+(?:(?:{_DIGITS}\.?+(?:{_DIGITS})?+|\.{_DIGITS})(?:[eE][+-]?+{_DIGITS})?+"
    r"|(?i:inf|infinity|nan))\s*+$"
)


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters the header holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_nested_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """NULL or empty text. In a variant: JSON null or empty JSON text.

    A variant that is NULL stands for a key the object lacked, which is not a
    missing cell: it is neither counted nor filled, and leaves no key when written.
    """
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(dtype, T.VariantType):
        return F.coalesce(F.is_variant_null(c) | (F.to_json(c) == '""'), F.lit(False))
    return c.isNull()


def to_number(c: Column, dtype: T.DataType) -> Column:
    """The cell as double, NULL where it is not a number."""
    if isinstance(dtype, T.StringType):
        parsed = F.regexp_replace(c, "_", "").try_cast("double")
        return F.when(c.rlike(NUMBER_PATTERN), parsed)
    if isinstance(dtype, T.VariantType):
        return to_number(F.try_variant_get(c, "$", "string"), T.StringType())
    if is_numeric_type(dtype) or isinstance(dtype, T.BooleanType):
        return c.cast("double")
    return F.lit(None).cast("double")


def cell_type(c: Column, dtype: T.DataType) -> Column:
    """``number``, ``string`` or ``complex``; NULL for a missing or absent cell."""
    if is_nested_type(dtype):
        kind = F.lit(COMPLEX)
    elif is_numeric_type(dtype) or isinstance(dtype, T.BooleanType):
        kind = F.lit(NUMBER)
    elif isinstance(dtype, T.StringType):
        kind = F.when(c.rlike(NUMBER_PATTERN), NUMBER).otherwise(STRING)
    elif isinstance(dtype, T.VariantType):
        text = F.try_variant_get(c, "$", "string")
        kind = (
            F.when(F.schema_of_variant(c).rlike("^(ARRAY|OBJECT)"), COMPLEX)
            .when(F.schema_of_variant(c) == "BOOLEAN", NUMBER)
            .when(text.rlike(NUMBER_PATTERN), NUMBER)
            .otherwise(STRING)
        )
    else:
        kind = F.lit(STRING)
    return F.when(c.isNotNull() & ~is_missing(c, dtype), kind)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """A form of the cell that can be compared and grouped."""
    if isinstance(dtype, T.VariantType) or is_nested_type(dtype):
        return F.to_json(c)
    return c


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Two 64-bit hashes that identify a row's content (``h1``, ``h2``).

    Counting distinct rows then shuffles 16 bytes per distinct row, not the row.
    ``xxhash64`` passes NULLs through, so the places of NULLs are hashed as well;
    nested cells are hashed as JSON text so that array borders count.
    """
    names = list(columns or df.columns)
    cells = [comparable(quoted(n), df.schema[n].dataType) for n in names]
    nulls = [c.isNull() for c in cells]
    return [
        F.xxhash64(*nulls, *cells).alias("h1"),
        F.xxhash64(F.lit("second"), *reversed(cells), *nulls).alias("h2"),
    ]


def hash_fraction(key: Column, salt: str, fraction: float) -> Column:
    """True for a fixed pseudo-random ``fraction`` of the keys.

    Compares the first 16 bits of md5(key|salt) as hex text, which any SQL
    engine can repeat.
    """
    bound = format(int(fraction * 65536), "04x")
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), 1, 4) < bound


def na_safe(c: Column, expr: Column) -> Column:
    """Leave imputed ``NA`` cells alone, apply ``expr`` to all others."""
    return F.when(c == NOT_AVAILABLE, F.lit(NOT_AVAILABLE)).otherwise(expr)
