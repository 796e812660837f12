"""A mapping and its value logic from an example of the target table.

Programs are searched for every target column: one source column through a catalogue
function, two source columns joined by ``|`` (and put through a function), or one source
column split at its first space into two targets. A program's score is the share of the
target's distinct values that it makes, then how little else it makes (Jaccard).

Every function of every source column is scored, and every merge under a function that
leaves the joined pieces in their places (``PIECEWISE``). Nothing is estimated: a program
that reaches the least wanted containment is found. Two exact steps keep the work small:

1. a merge of two columns can only make a target value if the text before one of its
   separators is a cell of the first and the text after it one of the second. Counting
   these texts over distinct cells bounds each side's containment from above, so pairs of
   columns are joined over the rows only where both sides can reach the least wanted one;
2. what a program makes beside the target is counted for those that reach it.

Programs are then assigned best first, every source and target column once; two
sources go to one target by a merge, one source to two targets by a split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.cells import quoted
from sparkprep.operators.match import VALUE_FUNCTIONS, apply_function, column_values, contained, distinct_cells, long_values, made_values
from sparkprep.operators.restructure import MERGE_SEPARATOR, Create, Drop, Merge, Rename, Rule, Split
from sparkprep.session import materialise

LEAST_CONTAINMENT = 0.5
# Functions that leave the pieces of a joined text in their places.
PIECEWISE = ("identity", "lower")
SPLIT = ("first_part", "rest_part")


@dataclass(frozen=True)
class Program:
    """How target columns are made, and the shares of their values that it makes."""

    targets: tuple[str, ...]
    sources: tuple[str, ...]
    function: str
    containment: float
    jaccard: float


def _pieces(target: DataFrame) -> DataFrame:
    """``v, side, piece, n``: hashes of the texts before (side 0) and after (1) each separator of a target column's values."""
    values = long_values(target, column_values(target), "v")
    values = values.select("v", F.split("value", f"\\Q{MERGE_SEPARATOR}\\E").alias("pieces"))
    cut = values.where(F.size("pieces") > 1).select("v", "pieces", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)).alias("nth"))
    rest = F.slice("pieces", F.col("nth") + 1, F.size("pieces") - F.col("nth"))
    sides = [F.xxhash64(F.array_join(part, MERGE_SEPARATOR)) for part in (F.slice("pieces", F.lit(1), F.col("nth")), rest)]
    return cut.select("v", F.posexplode(F.array(*sides)).alias("side", "piece")).groupBy("v", "side", "piece").agg(F.count("*").alias("n"))


def _mergeable(cells: DataFrame, target: DataFrame, functions: Sequence[str], least: float) -> list[tuple[str, str, str, str]]:
    """(function, source, source, target column) of all merges that can make ``least`` of the target's values.

    A value is counted once a separator and a hash may be shared by chance, so the counts
    are upper bounds: no merge that reaches ``least`` is lost. A missing cell is an empty text.
    """
    if not functions:
        return []
    text = F.coalesce("value", F.lit(""))
    made = F.array(*[F.struct(F.lit(f).alias("f"), F.xxhash64(VALUE_FUNCTIONS[f](text)).alias("piece")) for f in functions])
    met = cells.select("c", F.explode(made).alias("made")).select("c", "made.*").distinct().join(_pieces(target), "piece")
    totals = long_values(target, column_values(target), "v").groupBy("v").agg(F.count("*").alias("n_target"))
    found = met.groupBy("f", "v", "side", "c").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "v")
    able: dict[tuple, tuple[list[str], list[str]]] = {}
    for r in found.collect():
        if r["n"] / r["n_target"] >= least:
            able.setdefault((r["f"], r["v"]), ([], []))[r["side"]].append(r["c"])
    return [(f, a, b, v) for (f, v), (left, right) in able.items() for a in left for b in right if a != b]


def score_programs(
    source: DataFrame,
    target: DataFrame,
    functions: Sequence[str] = tuple(VALUE_FUNCTIONS),
    least: float = LEAST_CONTAINMENT,
    sketch: int | None = None,
) -> list[Program]:
    """All programs that make ``least`` of a target column's values; as many as columns and functions allow, not rows.

    ``sketch`` is taken for callers that pass it and changes nothing: no candidate is left out by an estimate.
    """
    texts = column_values(source)
    names = {f"{f}({u})": (f, (u,)) for u in texts for f in functions}
    # every function runs once for a distinct cell
    cells = materialise(distinct_cells(source), "source-cells")
    merges: dict[str, Column] = {}
    for f, left, right in sorted({m[:3] for m in _mergeable(cells, target, [f for f in PIECEWISE if f in functions], least)}):
        # a number is no name of a function of a column
        name = str(len(merges))
        names[name] = (f, (left, right))
        merges[name] = VALUE_FUNCTIONS[f](F.concat_ws(MERGE_SEPARATOR, *[F.coalesce(texts[c], F.lit("")) for c in (left, right)]))

    def made(wanted: Sequence[str]) -> DataFrame:
        """Values (u, value) of the named programs, which may repeat."""
        singles: dict[str, list[str]] = {}
        for f, sources in (names[u] for u in wanted if u not in merges):
            singles.setdefault(f, []).append(*sources)
        joined = {u: merges[u] for u in wanted if u in merges}
        values = long_values(source, joined, "u") if joined else None
        if not singles:
            return values
        return made_values(cells, singles) if values is None else made_values(cells, singles).unionByName(values)

    reached = [r for r in contained(made(list(names)), target).collect() if r["common"] / r["n_target"] >= least] if names else []
    if not reached:
        return []
    wanted = {r["u"] for r in reached}
    sizes = made([u for u in names if u in wanted]).distinct().groupBy("u").agg(F.count("*").alias("n"))
    sizes = {r["u"]: r["n"] for r in sizes.collect()}
    out = []
    for r in reached:
        function, sources = names[r["u"]]
        jaccard = r["common"] / (r["n_target"] + sizes[r["u"]] - r["common"])
        out.append(Program((r["v"],), sources, function, r["common"] / r["n_target"], jaccard))
    by_function = {(p.function, p.sources[0], p.targets[0]): p for p in out if len(p.sources) == 1}
    for (f, u, v), first in by_function.items():
        for (g, x, w), rest in by_function.items():
            if (f, g) == SPLIT and u == x and v != w:
                worst = (min(first.containment, rest.containment), min(first.jaccard, rest.jaccard))
                out.append(Program((v, w), (u,), "split", *worst))
    return out


def assign(programs: Sequence[Program], source_columns: Sequence[str]) -> list[Program]:
    """The programs taken, best first, so that no source or target column is used twice.

    Of equal containment the one that makes more targets, then the one with the
    higher Jaccard, the simpler function, the earlier sources and targets.
    """
    order = {f: i for i, f in enumerate(VALUE_FUNCTIONS)}
    place = {c: i for i, c in enumerate(source_columns)}

    def rank(p: Program) -> tuple:
        return (-round(p.containment, 6), -len(p.targets), -round(p.jaccard, 6), order.get(p.function, -1), [place[c] for c in p.sources], p.targets)

    taken, sources, targets = [], set(), set()
    for p in sorted(programs, key=rank):
        if sources.isdisjoint(p.sources) and targets.isdisjoint(p.targets):
            taken.append(p)
            sources.update(p.sources)
            targets.update(p.targets)
    return taken


def rules_of(programs: Sequence[Program], source_columns: Sequence[str], target_columns: Sequence[str]) -> list[Rule]:
    """Mapping rules of assigned programs; what no program uses is dropped, what none makes is created."""
    rules: list[Rule] = []
    for p in programs:
        if len(p.targets) > 1:
            rules.append(Split(p.sources[0], p.targets))
        elif len(p.sources) > 1:
            rules.append(Merge(p.sources, p.targets[0]))
        else:
            rules.append(Rename(p.sources[0], p.targets[0]))
    dropped = [c for c in source_columns if all(c not in p.sources for p in programs)]
    created = [c for c in target_columns if all(c not in p.targets for p in programs)]
    return rules + ([Drop(tuple(dropped))] if dropped else []) + ([Create(tuple(created))] if created else [])


def value_logic(programs: Sequence[Program]):
    """A function that runs the programs' value functions on the columns that a mapping has made."""
    functions = {p.targets[0]: p.function for p in programs if p.function not in ("identity", "split")}

    def standardise(df: DataFrame) -> DataFrame:
        return df.select(*[apply_function(quoted(c).cast("string"), functions[c]).alias(c) if c in functions else quoted(c) for c in df.columns])

    return standardise
