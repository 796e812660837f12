"""Value-standardisation functions: dates, text, units, lists, buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.cells import NOT_AVAILABLE, na_safe, quoted, to_number

_STRING = T.StringType()


def number(c: Column) -> Column:
    """Text to double, NULL if it is not a number."""
    return to_number(c, _STRING)


def reformat_date(c: Column, source: str, target: str) -> Column:
    """Date text from one pattern to another; unreadable text becomes NULL."""
    return na_safe(c, F.date_format(F.try_to_timestamp(c, F.lit(source)), target))


def reformat_local_date(c: Column, target: str) -> Column:
    """ISO timestamp text with an offset, formatted by its own local date.

    Parsing the offset would move the instant into the session time zone and
    could change the day, so only the date part is read.
    """
    return na_safe(c, F.date_format(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), target))


def lower(c: Column) -> Column:
    return na_safe(c, F.lower(c))


def lower_trim(c: Column) -> Column:
    return na_safe(c, F.lower(F.trim(c)))


def flag(c: Column, true_text: str) -> Column:
    """1 where the text equals ``true_text`` whatever its case, else 0."""
    return F.when(F.lower(c) == true_text, 1).otherwise(0)


def map_values(c: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace known values (compared in lower case); others keep their value."""
    out = None
    for old, new in mapping.items():
        cond = F.lower(c) == old.lower()
        out = F.when(cond, F.lit(new)) if out is None else out.when(cond, F.lit(new))
    rest = c if default is None else default
    return rest if out is None else out.otherwise(rest)


def bucket(c: Column, ranges: Sequence[tuple[float, float, str]], otherwise: str) -> Column:
    """Label of the closed range that holds the number, ``NA`` if unreadable."""
    x = number(c)
    out = F.when(x.isNull() | F.isnan(x), NOT_AVAILABLE)
    for low, high, label in ranges:
        out = out.when(x.between(low, high), label)
    return out.otherwise(otherwise)


def scale(c: Column, divisor: float) -> Column:
    return number(c) / F.lit(float(divisor))


def rounded(c: Column, digits: int) -> Column:
    return F.round(number(c), digits)


def rounded_text(c: Column, digits: int) -> Column:
    """Rounded number as text with ``digits`` decimals, ``NA`` if unreadable."""
    x = F.round(number(c), digits)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise(NOT_AVAILABLE)


def round_up_to(c: Column, step: int) -> Column:
    return F.ceil(number(c) / step).cast("bigint") * step


def mean_of(*cols: Column) -> Column:
    total = number(cols[0])
    for c in cols[1:]:
        total = total + number(c)
    return total / len(cols)


def first_part(c: Column) -> Column:
    """Text before the first space."""
    return na_safe(c, F.split_part(c, F.lit(" "), F.lit(1)))


def rest_part(c: Column) -> Column:
    """Text after the first space, empty if there is none."""
    at = F.instr(c, " ")
    return na_safe(c, F.when(at > 0, F.substr(c, at + F.lit(1))).otherwise(F.lit("")))


def last_word(c: Column) -> Column:
    return na_safe(c, F.substring_index(c, " ", -1))


def but_last_word(c: Column) -> Column:
    words = F.split(c, " ")
    return na_safe(c, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))


def dashed(c: Column) -> Column:
    """Words joined by single dashes."""
    return na_safe(c, F.regexp_replace(F.trim(c), r"\s+", "-"))


def join_list(df: DataFrame, name: str, separator: str) -> Column:
    """List elements joined by a separator; a column that is no list passes through."""
    c, dtype = quoted(name), df.schema[name].dataType
    if isinstance(dtype, T.ArrayType):
        return F.array_join(c, separator)
    if isinstance(dtype, T.VariantType):
        joined = F.array_join(F.try_variant_get(c, "$", "array<string>"), separator)
        return F.coalesce(joined, F.try_variant_get(c, "$", "string"))
    return c


def join_text(*cols: Column, separator: str = " ") -> Column:
    """Parts joined by a separator, ``NA`` if any part is ``NA``."""
    any_na = F.lit(False)
    for c in cols:
        any_na = any_na | (c == NOT_AVAILABLE)
    return F.when(any_na, NOT_AVAILABLE).otherwise(F.concat_ws(separator, *cols))


def text_length(c: Column) -> Column:
    """Characters in the text; an imputed cell has none."""
    return F.when(c == NOT_AVAILABLE, 0).otherwise(F.length(c))
