"""Logical types of the test tables, and SQL text shared by the counterparts.

A kind is ``n`` (number), ``s`` (string), ``b`` (two-valued text) or ``t`` (other
types, blanked with NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkprep.functions.cells import BOOLEAN, NUMBER, STRING
from sparkprep.operators.pollute import pollute
from sparkprep.session import materialise, rebalanced

KINDS = {"n": NUMBER, "s": STRING, "b": BOOLEAN, "t": STRING}

TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "customer": (
        "c_custkey",
        {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"},
    ),
    "orders": (
        "o_orderkey",
        {
            "o_orderkey": "n",
            "o_custkey": "n",
            "o_orderstatus": "s",
            "o_totalprice": "n",
            "o_orderdate": "t",
            "o_orderpriority": "s",
        },
    ),
    "events": (
        "event_id",
        {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "n", "props": "s"},
    ),
}


def types_of(name: str) -> dict[str, str]:
    return {c: KINDS[k] for c, k in TABLES[name][1].items()}


def polluted(df: DataFrame, name: str, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """The table after fault injection; ``stored`` for queries that pass over it often."""
    if not stored:
        return pollute(df, types_of(name), TABLES[name][0], columns)
    return materialise(pollute(rebalanced(df), types_of(name), TABLES[name][0], columns), f"polluted-{name}")


def hit(key: str, salt: str, bound: str) -> str:
    """SQL for the repeatable random choice."""
    return f"substr(md5(concat({key}, '|{salt}')), 1, 4) < '{bound}'"


def polluted_sql(name: str, columns: list[str] | None = None) -> str:
    """CTEs that end in ``polluted``, the table after fault injection."""
    key, kinds = TABLES[name]
    chosen = columns or list(kinds)
    missing, scaled = [], []
    for c, kind in kinds.items():
        blank = "''" if kind == "s" else "null"
        cell = f"case when {hit('k_', 'missing|' + c, '6666')} then {blank} else {c} end" if c in chosen else c
        missing.append(f"{cell} as {c}")
        if kind == "n" and c in chosen:
            cond = hit("k_", "outlier|" + c, "3333") + f" and {c} is not null"
            scaled.append(f"case when {cond} then cast({c} as double) * 100 else cast({c} as double) end as {c}")
        else:
            scaled.append(c)
    names = ", ".join(kinds)
    return f"""
keyed as (select cast({key} as varchar) as k_, * from {name}),
blanked as (select k_, {', '.join(missing)} from keyed),
scaled as (select k_, {', '.join(scaled)} from blanked),
polluted as (select {names} from scaled
  union all select {names} from scaled where {hit('k_', 'duplicate', '3333')})"""


def numbers_of(kinds: dict[str, str]) -> list[str]:
    return [c for c, k in kinds.items() if k == "n"]


def missing_sql(kinds: dict[str, str], rel: str = "") -> str:
    """SQL count of missing cells in a row."""
    parts = []
    for c, k in kinds.items():
        cell = f"{rel}.{c}" if rel else c
        empty = f" or {cell} = ''" if k in "sb" else ""
        parts.append(f"(case when {cell} is null{empty} then 1 else 0 end)")
    return " + ".join(parts)


def stats_sql(rel: str, cols: list[str], suffix: str = "") -> str:
    """CTEs ``med`` and ``mad`` with one column per number column."""
    med = ", ".join(f"median({c}) as {c}" for c in cols)
    mad = ", ".join(f"median(abs({rel}.{c} - med{suffix}.{c})) as {c}" for c in cols)
    return f"""
med{suffix} as (select {med} from {rel}),
mad{suffix} as (select {mad} from {rel}, med{suffix})"""


def is_outlier_sql(rel: str, c: str, suffix: str = "") -> str:
    return f"coalesce(abs({rel}.{c} - med{suffix}.{c}) > 3 * mad{suffix}.{c}, false)"


def quality_sql(rel: str, kinds: dict[str, str], suffix: str = "") -> str:
    """CTEs that end in ``quality``: n, missing, duplicate and outlier ratios, dq."""
    cols = numbers_of(kinds)
    far = " + ".join(f"(case when {is_outlier_sql(rel, c, suffix)} then 1 else 0 end)" for c in cols)
    return f"""{stats_sql(rel, cols, suffix)},
tally{suffix} as (select count(*) as n, sum({missing_sql(kinds, rel)}) as m, sum({far}) as o
  from {rel}, med{suffix}, mad{suffix}),
uniq{suffix} as (select count(*) as d from (select distinct * from {rel})),
ratio{suffix} as (select n, cast(m as double) / (n * {len(kinds)}) as missing_ratio,
    cast(n - d as double) / n as dup_ratio, cast(o as double) / (n * {len(cols)}) as outlier_ratio
  from tally{suffix}, uniq{suffix}),
quality{suffix} as (select cast(n as bigint) as n_rows, missing_ratio, dup_ratio, outlier_ratio,
    1.0 - abs((missing_ratio + dup_ratio + outlier_ratio) / 3) as dq from ratio{suffix})"""


def metrics_columns_sql(digits: int = 9) -> str:
    return f"""n_rows, round(missing_ratio * 100, 3) as missing_pct, round(dup_ratio * 100, 3) as dup_pct,
  round(outlier_ratio * 100, 3) as outlier_pct, round(dq, {digits}) as dq"""
