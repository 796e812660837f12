"""Matching source columns to target columns from names and example values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions import scalars as S
from sparkprep.functions.cells import ABSENT, NOT_AVAILABLE, comparable, is_missing, quoted
from sparkprep.session import materialise

# Fixed values of the matcher.
WEIGHT_THRESHOLD = 0.5
CAPACITY_DIFFERENCE = 0.05

# Size of the target's distinct values up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def column_catalogue(df: DataFrame, table: str) -> DataFrame:
    """(table, position, column) of one table, from its schema."""
    return df.sparkSession.createDataFrame(
        [(table, i, c) for i, c in enumerate(df.columns)], "table string, position int, column string"
    )


def _trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    at = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.transform(at, lambda i: F.substring(padded, i, F.lit(3)))


def similarity_edges(
    source: DataFrame, target: DataFrame, by: Sequence[str] = (), threshold: float = WEIGHT_THRESHOLD
) -> DataFrame:
    """Column pairs whose names are alike: (by, u, v, weight, rank).

    Weight is the mean of the edit-distance ratio and the trigram cosine of the
    names. A weight above 0.5 needs a positive cosine, hence a common trigram,
    so joining on trigrams finds every pair that can pass: no cross join. The
    inputs are column catalogues, one group per table pair if ``by`` is given.
    """
    if threshold < 0.5:
        raise ValueError("pairs without a common trigram could pass a threshold below 0.5")
    keys = list(by)

    def grams(df: DataFrame, name: str) -> DataFrame:
        counted = (
            df.select(*keys, F.col("column").alias(name), F.explode(_trigrams(F.col("column"))).alias("gram"))
            .groupBy(*keys, name, "gram")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        norm = counted.groupBy(*keys, name).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"norm_{name}"))
        return counted.withColumnRenamed("n", f"n_{name}").join(norm, [*keys, name])

    dots = (
        grams(source, "u")
        .join(grams(target, "v"), [*keys, "gram"])
        .groupBy(*keys, "u", "v")
        .agg(
            F.sum(F.col("n_u") * F.col("n_v")).alias("dot"),
            F.first("norm_u").alias("norm_u"),
            F.first("norm_v").alias("norm_v"),
        )
    )
    u, v = F.lower("u"), F.lower("v")
    ratio = F.lit(1.0) - F.levenshtein(u, v) / F.greatest(F.length(u), F.length(v))
    cosine = F.col("dot") / (F.col("norm_u") * F.col("norm_v"))
    edges = dots.select(*keys, "u", "v", F.round((ratio + cosine) / 2, 3).alias("weight"))
    return ranked(edges.filter(F.col("weight") > threshold), keys)


def ranked(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number each source column's edges by falling weight."""
    order = Window.partitionBy(*by, "u").orderBy(F.col("weight").desc(), "v")
    return edges.withColumn("rank", F.row_number().over(order))


def long_values(df: DataFrame, columns: Mapping[str, Column], name: str) -> DataFrame:
    """Distinct (column, value) pairs of several expressions.

    Pairs are combined on the map side, so a frequent value costs one record per
    task, and afterwards a value occurs at most once per column.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias(name), c.alias("value")) for n, c in columns.items()]))
    return df.select(cells.alias("cell")).select("cell.*").filter("value is not null").distinct()


def distinct_cells(df: DataFrame) -> DataFrame:
    """Distinct (c, value) of all columns; a missing cell is NULL and kept, as functions may make a value of it."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), c.alias("value")) for n, c in column_values(df).items()]))
    return df.select(cells.alias("cell")).select("cell.*").distinct()


def column_values(df: DataFrame) -> dict[str, Column]:
    """The filled cells of every column as text."""
    out = {}
    for f in df.schema.fields:
        c = quoted(f.name)
        out[f.name] = F.when(~is_missing(c, f.dataType), comparable(c, f.dataType).cast("string"))
    return out


def value_containment(
    source: DataFrame,
    target: DataFrame,
    source_columns: Mapping[str, Column] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Share of each target column's distinct values found in each source column.

    Rows: u, v, common, n_target, containment; pairs without a common value do
    not appear. Source cells that match no target value are dropped before the
    shuffle if the target's values, measured first, are small enough to broadcast.
    """
    columns = source_columns or column_values(source)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("u"), c.alias("value")) for n, c in columns.items()]))
    found = source.select(cells.alias("cell")).select("cell.*").filter("value is not null")
    return contained(found, target, broadcast_bytes)


def contained(found: DataFrame, target: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``value_containment`` of values (u, value), which may repeat."""
    wanted = materialise(long_values(target, column_values(target), "v"), "target-values")
    totals = wanted.groupBy("v").agg(F.count(F.lit(1)).alias("n_target"))
    # Stored values with some overhead per row.
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= broadcast_bytes:
        known = F.broadcast(wanted.select("value").distinct())
        found = found.join(known, "value", "left_semi").distinct()
        pairs = found.join(F.broadcast(wanted), "value")
    else:
        pairs = found.distinct().join(wanted, "value")
    # A column has few names: totals holds one row per target column.
    return (
        pairs.groupBy("u", "v")
        .agg(F.count(F.lit(1)).alias("common"))
        .join(totals, "v")
        .select(
            "u", "v", "common", "n_target", F.round(F.col("common") / F.col("n_target"), 6).alias("containment")
        )
    )


def _stable_pairs(edges: pd.DataFrame, diff: float = CAPACITY_DIFFERENCE) -> list[tuple[str, str]]:
    """Accepted (source, target) pairs of one table pair.

    Sources propose in turn to their best target that has not refused them. A
    target takes a second source whose weight is within ``diff`` of the first;
    otherwise the heavier stays. Two holders give way only to a source heavier
    than both together. Every refusal or replacement strikes a wish, so it ends.
    """
    ordered = edges.sort_values(["u_position", "rank"])
    wishes = {u: list(g["v"]) for u, g in ordered.groupby("u", sort=False)}
    weight = {(u, v): w for u, v, w in zip(edges["u"], edges["v"], edges["weight"])}
    queue = list(wishes)
    holders: dict[str, list[str]] = {}
    while queue := [u for u in queue if wishes[u]]:
        u = queue[0]
        v = wishes[u][0]
        held, mine = holders.setdefault(v, []), weight[(u, v)]
        theirs = [weight[(h, v)] for h in held]
        if len(held) == 1 and abs(mine - theirs[0]) <= diff * theirs[0]:
            held.append(u)
            queue.remove(u)
        elif not held or (len(held) == 1 and mine >= theirs[0]) or (len(held) == 2 and mine > sum(theirs)):
            for loser in held:
                wishes[loser].remove(v)
                queue.append(loser)
            holders[v] = [u]
            queue.remove(u)
        else:
            wishes[u].remove(v)
    return [(u, v) for v, us in holders.items() for u in us]


def match_columns(edges: DataFrame, by: Sequence[str] = (), diff: float = CAPACITY_DIFFERENCE) -> DataFrame:
    """Stable matching of source to target columns, per table pair: (by, u, v, weight).

    ``edges`` holds by, u, u_position, v, weight, rank. A group is one table
    pair's edges, bounded by its column names, never by its rows.
    """
    keys = list(by)
    types = dict(edges.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "u string, v string"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pd.DataFrame(_stable_pairs(pdf, diff), columns=["u", "v"])
        for k in keys:
            pairs[k] = pdf[k].iloc[0]
        return pairs[[*keys, "u", "v"]]

    grouped = edges.groupBy(*keys) if keys else edges.groupBy(F.lit(0).alias("one"))
    accepted = grouped.applyInPandas(match, schema)
    return accepted.join(edges.select(*keys, "u", "v", "weight"), [*keys, "u", "v"])


def unmatched(source: DataFrame, target: DataFrame, matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Target columns to create and source columns to drop: (by, action, column).

    The inputs are catalogues (by, column) and the accepted matches.
    """
    keys = list(by)
    create = target.select(*keys, "column").join(matches.select(*keys, F.col("v").alias("column")), [*keys, "column"], "left_anti")
    drop = source.select(*keys, "column").join(matches.select(*keys, F.col("u").alias("column")), [*keys, "column"], "left_anti")
    return create.select(*keys, F.lit("CREATE").alias("action"), "column").unionByName(
        drop.select(*keys, F.lit("DROP").alias("action"), "column")
    )


def _day(c: Column) -> Column:
    # Text that is no date is told apart first: a failing parse is costly.
    return F.when(c.like("____-__-__%"), F.substring(c, 1, 10))


# What may be done to a column's text, simplest first; names are used in proposals and run by ``apply_function``.
VALUE_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda c: c,
    "lower": F.lower,
    "lower_trim": lambda c: F.lower(F.trim(c)),
    "first_part": S.first_part,
    "rest_part": S.rest_part,
    "last_word": S.last_word,
    "dashed": S.dashed,
    "round_up_10": lambda c: S.round_up_to(c, 10).cast("string"),
    "rounded_0": lambda c: F.round(S.number(c), 0).cast("bigint").cast("string"),
    "day_month_year": lambda c: S.reformat_date(_day(c), "yyyy-MM-dd", "dd-MM-yyyy"),
    "year_slash": lambda c: S.reformat_date(_day(c), "yyyy-MM-dd", "yyyy/MM/dd"),
    "day_monthname_year": lambda c: S.reformat_date(_day(c), "yyyy-MM-dd", "dd-MMMM-yyyy"),
}


def apply_function(c: Column, name: str) -> Column:
    """A proposed function run on a column's text; marker cells stay as they are."""
    return F.when(c.isin(NOT_AVAILABLE, ABSENT), c).otherwise(VALUE_FUNCTIONS[name](c))


def made_values(cells: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values (u, value) that functions make of the distinct cells (c, value) of their ``wanted`` columns.

    ``u`` is named as by ``candidate_expressions``. A function runs once for a distinct
    cell of a column, however many rows hold it.
    """
    each = []
    for f, columns in wanted.items():
        name = F.concat(F.lit(f"{f}("), F.col("c"), F.lit(")"))
        each.append(F.when(F.col("c").isin(list(columns)), F.struct(name.alias("u"), VALUE_FUNCTIONS[f](F.col("value")).alias("value"))))
    return cells.select(F.explode(F.array(*each)).alias("cell")).select("cell.*").filter("value is not null")


def candidate_expressions(df: DataFrame, functions: Sequence[str] = tuple(VALUE_FUNCTIONS)) -> dict[str, Column]:
    """Catalogue functions applied to every column that can take them."""
    return {f"{f}({name})": VALUE_FUNCTIONS[f](value) for name, value in column_values(df).items() for f in functions}


def propose_expressions(source: DataFrame, target: DataFrame) -> DataFrame:
    """Best-fitting expression per target column: (v, expression, containment).

    Every candidate expression is evaluated over the distinct cells of its column
    and scored by containment of the target's values; ties go to the first candidate.
    """
    candidates = candidate_expressions(source)
    scored = contained(made_values(distinct_cells(source), dict.fromkeys(VALUE_FUNCTIONS, source.columns)), target)
    place = F.array_position(F.array(*[F.lit(u) for u in candidates]), F.col("u"))
    best = F.min_by("u", F.struct(-F.col("containment"), place))
    return scored.groupBy("v").agg(best.alias("expression"), F.max("containment").alias("containment"))
