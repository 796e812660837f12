"""Exact medians and median absolute deviations (MAD) without a sort or shuffle.

Spark's exact ``median`` gathers every distinct value of a column in one task,
which is fine for small tables only. Larger columns are solved by narrowing a
bracket around the wanted rank:

1. a random sample of rows gives two values just below and above the rank;
2. an exact count says how many cells lie below, on and between the two;
3. while many lie between, sample and count again inside the bracket;
4. once few do, gather just those and read off the wanted order statistics.

The counts decide every step, so the answer is exact whatever was sampled; a
bracket that missed its rank is discarded and drawn again. A round keeps about one
value in a hundred (one in several hundred on large tables), so three rounds do
10^12 rows. Copies of one value that fill much of a column end up on the edge of
a bracket, where they are only counted. All columns advance together, each job
is a filter plus a wide aggregate that combines before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.cells import MAD_THRESHOLD, quoted, to_number

# Most values of one column that the last step may gather (1.6 MB of doubles).
GATHER_LIMIT = 200_000
# Cells (rows x columns) up to which Spark's own median is the cheaper job.
SMALL_CELLS = 200_000
SKETCH_ACCURACY = 10_000
# Cells up to which the medians of many groups are one exact aggregate.
GROUPED_CELLS = 4_000_000
# Steps of the quantile grid that many groups share.
GRID = 200


@dataclass(frozen=True)
class ColumnStats:
    """Number of numeric cells, median and unscaled MAD of one column."""

    n: int
    median: float | None
    mad: float | None

    def is_outlier(self, x: Column) -> Column:
        """Farther than three MADs from the median; NULL and NaN never are."""
        if self.median is None:
            return F.lit(False)
        far = F.abs(x - F.lit(self.median)) > F.lit(MAD_THRESHOLD * self.mad)
        return F.coalesce(far & ~F.isnan(x), F.lit(False))


@dataclass
class _Bracket:
    """A value range, its exact counts, and the ranks wanted from the column."""

    n: int
    lo: float = -math.inf
    hi: float = math.inf
    below: int = 0  # cells < lo
    on_lo: int = 0  # cells = lo
    between: int = 0  # cells strictly inside
    on_hi: int = 0  # cells = hi, where hi differs from lo
    misses: int = 0

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n - 1) // 2, self.n // 2

    @property
    def within(self) -> int:
        return self.on_lo + self.between + self.on_hi

    def covers_ranks(self) -> bool:
        low, high = self.ranks
        return self.below <= low and high < self.below + self.within

    def edge_value(self, rank: int) -> float | None:
        """The value at ``rank`` if it lies on an edge of the range."""
        at = rank - self.below
        if at < self.on_lo:
            return self.lo
        return self.hi if at >= self.on_lo + self.between else None


def numeric_cells(df: DataFrame, name: str) -> Column:
    """The column as double with NaN taken as no number."""
    x = to_number(quoted(name), df.schema[name].dataType)
    return F.when(~F.isnan(x), x)


def _sample_size(n: int) -> int:
    return min(max(n // 100, 20_000), 10_000_000)


def sql_double(x: float) -> str:
    """A double as SQL text, exactly."""
    return f"double('{x!r}')"


def _propose(
    df: DataFrame, values: Mapping[str, str], state: Mapping[str, _Bracket], draw: int
) -> dict[str, tuple[float, float]]:
    """Two sampled values per column that should enclose its wanted ranks."""
    share = {c: min(1.0, _sample_size(b.within) / max(b.within, 1)) for c, b in state.items()}
    taken, quantiles = {}, {}
    for c, b in state.items():
        taken[c] = f"({values[c]} between {sql_double(b.lo)} and {sql_double(b.hi)} and draw < {share[c]!r}D)"
        m = max(b.within - 1, 1)
        # Four standard errors of a sampled rank (none if every cell is taken),
        # the sketch's own error and one rank; wider after a miss.
        sampling = 2.0 / math.sqrt(b.within * share[c]) if share[c] < 1 else 0.0
        slack = (1 + b.misses) * (sampling + 2.0 / SKETCH_ACCURACY + 1.0 / m)
        low = min(max((b.ranks[0] - b.below) / m - slack, 0.0), 1.0)
        high = min(max((b.ranks[1] - b.below) / m + slack, 0.0), 1.0)
        quantiles[c] = f"array({low!r}D, {high!r}D)"
    drawn = df.selectExpr("*", f"rand({draw}) as draw" if min(share.values()) < 1 else "0.0D as draw")
    row = (
        drawn.filter(" or ".join(taken.values()))
        .selectExpr(
            *[
                f"percentile_approx(case when {taken[c]} then {values[c]} end, {quantiles[c]}, {SKETCH_ACCURACY}) as q{i}"
                for i, c in enumerate(state)
            ]
        )
        .first()
    )
    return {c: tuple(row[f"q{i}"] or (b.lo, b.hi)) for i, (c, b) in enumerate(state.items())}


def _count(df: DataFrame, values: Mapping[str, str], ranges: Mapping[str, tuple]) -> dict[str, tuple]:
    """Exact number of cells below, on the edges of, and inside each range."""
    aggs = []
    for i, (c, ends) in enumerate(ranges.items()):
        v, lo, hi = values[c], sql_double(ends[0]), sql_double(ends[1])
        aggs += [
            f"count_if({v} < {lo}) as below{i}",
            f"count_if({v} = {lo}) as lo{i}",
            f"count_if({v} > {lo} and {v} < {hi}) as mid{i}",
            f"count_if({v} = {hi} and {hi} <> {lo}) as hi{i}",
        ]
    row = df.selectExpr(*aggs).first()
    return {c: (row[f"below{i}"], row[f"lo{i}"], row[f"mid{i}"], row[f"hi{i}"]) for i, c in enumerate(ranges)}


def _read_ranks(df: DataFrame, values: Mapping[str, str], state: Mapping[str, _Bracket]) -> dict[str, float]:
    """Median per column from the few cells strictly inside its bracket."""
    found = {c: [b.edge_value(r) for r in b.ranks] for c, b in state.items()}
    names = [c for c in state if None in found[c]]
    if names:
        inside, gathered, picks = [], [], []
        for i, c in enumerate(names):
            b = state[c]
            inside.append(f"({values[c]} > {sql_double(b.lo)} and {values[c]} < {sql_double(b.hi)})")
            gathered.append(f"array_sort(collect_list(case when {inside[i]} then {values[c]} end)) as mid{i}")
            for j, rank in enumerate(b.ranks):
                picks.append(f"try_element_at(mid{i}, {max(rank - b.below - b.on_lo + 1, 1)}) as pick{i}_{j}")
        row = df.filter(" or ".join(inside)).selectExpr(*gathered).selectExpr(*picks).first()
        for i, c in enumerate(names):
            found[c] = [row[f"pick{i}_{j}"] if v is None else v for j, v in enumerate(found[c])]
    return {c: (low + high) / 2 for c, (low, high) in found.items()}


def medians(
    df: DataFrame,
    values: Mapping[str, str],
    counts: Mapping[str, int],
    small_cells: int = SMALL_CELLS,
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, float | None]:
    """Exact median (mean of the middle two) of each SQL expression over ``df``.

    ``counts`` holds the number of non-null values of each expression.
    """
    filled = {c: v for c, v in values.items() if counts[c]}
    out: dict[str, float | None] = {c: None for c in values}
    if filled and sum(counts[c] for c in filled) <= small_cells:
        row = df.selectExpr(*[f"median({v}) as m{i}" for i, v in enumerate(filled.values())]).first()
        return out | {c: row[f"m{i}"] for i, c in enumerate(filled)}
    state = {c: _Bracket(counts[c], between=counts[c]) for c in filled}
    draw, gather_limit = 0, max(gather_limit, 100)
    while state:
        draw += 1
        ranges = _propose(df, filled, state, draw)
        for c, tally in _count(df, filled, ranges).items():
            proposed = _Bracket(counts[c], *ranges[c], *tally)
            if proposed.covers_ranks():
                state[c] = proposed
            else:
                state[c].misses += 1
        ready = {c: b for c, b in state.items() if b.between <= gather_limit}
        out.update(_read_ranks(df, filled, ready))
        state = {c: b for c, b in state.items() if c not in ready}
    return out


def _ranges(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Numbers per group (as many rows as groups), to be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, "g int, lo double, hi double, share double"))


def _grouped_medians(cells: DataFrame, counts: Mapping[int, int], small_cells: int, gather_limit: int) -> dict[int, float]:
    """Exact median of ``x`` per group ``g``, the brackets of all groups narrowed together."""
    if sum(counts.values()) <= small_cells:
        return {r["g"]: r["m"] for r in cells.groupBy("g").agg(F.expr("median(x)").alias("m")).collect()}
    spark, out = cells.sparkSession, {}
    state = {g: _Bracket(n, between=n) for g, n in counts.items()}
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    draw, gather_limit = 0, max(gather_limit, 100)
    while state:
        draw += 1
        share = {g: min(1.0, _sample_size(b.within) / max(b.within, 1)) for g, b in state.items()}
        inside = cells.join(_ranges(spark, [(g, b.lo, b.hi, share[g]) for g, b in state.items()]), "g")
        drawn = inside.where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")) & (F.rand(draw) < F.col("share")))
        found = {r["g"]: r["q"] for r in drawn.groupBy("g").agg(F.percentile_approx("x", grid, SKETCH_ACCURACY).alias("q")).collect()}
        proposed = {}
        for g, b in state.items():
            if g not in found:
                proposed[g] = (b.lo, b.hi)
                continue
            m = max(b.within - 1, 1)
            sampling = 2.0 / math.sqrt(b.within * share[g]) if share[g] < 1 else 0.0
            slack = (1 + b.misses) * (sampling + 2.0 / SKETCH_ACCURACY + 1.0 / m)
            low, high = (b.ranks[0] - b.below) / m - slack, (b.ranks[1] - b.below) / m + slack
            at_low, at_high = math.floor(low * GRID), math.ceil(high * GRID)
            # the ends of the range stand where the sample does not reach
            proposed[g] = (found[g][at_low] if at_low > 0 else b.lo, found[g][at_high] if at_high < GRID else b.hi)
        counted = cells.join(_ranges(spark, [(g, *ends, 0.0) for g, ends in proposed.items()]), "g").groupBy("g")
        tallies = counted.agg(
            F.count_if(F.col("x") < F.col("lo")).alias("below"),
            F.count_if(F.col("x") == F.col("lo")).alias("on_lo"),
            F.count_if((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi"))).alias("between"),
            F.count_if((F.col("x") == F.col("hi")) & (F.col("lo") != F.col("hi"))).alias("on_hi"),
        )
        for r in tallies.collect():
            g = r["g"]
            bracket = _Bracket(counts[g], *proposed[g], r["below"], r["on_lo"], r["between"], r["on_hi"])
            if bracket.covers_ranks():
                state[g] = bracket
            else:
                state[g].misses += 1
        ready = {g: b for g, b in state.items() if b.between <= gather_limit}
        out.update(_read_groups(cells, ready))
        state = {g: b for g, b in state.items() if g not in ready}
    return out


def _read_groups(cells: DataFrame, state: Mapping[int, _Bracket]) -> dict[int, float]:
    found = {g: [b.edge_value(r) for r in b.ranks] for g, b in state.items()}
    wanted = [g for g in state if None in found[g]]
    if wanted:
        ranges = [(g, state[g].lo, state[g].hi, 0.0) for g in wanted]
        places = [(g, *[max(r - state[g].below - state[g].on_lo + 1, 1) for r in state[g].ranks]) for g in wanted]
        near = cells.join(_ranges(cells.sparkSession, ranges), "g").where((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi")))
        few = near.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("mid"))
        few = few.join(F.broadcast(cells.sparkSession.createDataFrame(places, "g int, i int, j int")), "g")
        for r in few.selectExpr("g", "try_element_at(mid, i) as low", "try_element_at(mid, j) as high").collect():
            picks = (r["low"], r["high"])
            found[r["g"]] = [pick if v is None else v for v, pick in zip(found[r["g"]], picks)]
    return {g: (low + high) / 2 for g, (low, high) in found.items()}


def grouped_stats(
    cells: DataFrame, at_most: int | None = None, small_cells: int = GROUPED_CELLS, gather_limit: int = GATHER_LIMIT // 4
) -> dict[int, ColumnStats]:
    """Median and MAD of ``x`` (finite doubles) for every group ``g`` (a small number of integers).

    All groups share every pass, whatever their number: a pass is one aggregate by
    group, combined before the shuffle, beside a broadcast row of numbers a group.
    ``at_most`` bounds the number of cells, where the caller knows one.
    """
    few = at_most is not None and at_most <= small_cells
    once = [F.expr("median(x)").alias("m")] if few else []
    found = cells.groupBy("g").agg(F.count("x").alias("n"), *once).collect()
    counts = {r["g"]: r["n"] for r in found}
    centre = {r["g"]: r["m"] for r in found} if few else _grouped_medians(cells, counts, small_cells, gather_limit)
    if not centre:
        return {}
    ranges = _ranges(cells.sparkSession, [(g, m, m, 0.0) for g, m in centre.items()])
    spread = cells.join(ranges, "g").select("g", F.abs(F.col("x") - F.col("lo")).alias("x"))
    mads = _grouped_medians(spread, counts, small_cells, gather_limit)
    return {g: ColumnStats(counts[g], centre[g], mads[g]) for g in counts}


def outlier_stats(
    df: DataFrame,
    columns: Sequence[str],
    small_cells: int = SMALL_CELLS,
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, ColumnStats]:
    """Median and MAD of each column, over the cells that are finite numbers.

    Infinite cells have no part in either, and are outliers wherever a MAD exists.
    Returns one small record per column; nothing else reaches the driver.
    """
    if not columns:
        return {}
    finite = [F.when(F.abs(numeric_cells(df, c)) < F.lit(math.inf), numeric_cells(df, c)) for c in columns]
    narrow = df.select(*[x.alias(f"x{i}") for i, x in enumerate(finite)])
    cells = {c: f"x{i}" for i, c in enumerate(columns)}
    row = narrow.selectExpr(*[f"count({x}) as n{i}" for i, x in enumerate(cells.values())]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    centre = medians(narrow, cells, counts, small_cells, gather_limit)
    spread = {c: f"abs({cells[c]} - {sql_double(m)})" for c, m in centre.items() if m is not None}
    mads = medians(narrow, spread, counts, small_cells, gather_limit)
    return {c: ColumnStats(counts[c], centre[c], mads.get(c)) for c in columns}
