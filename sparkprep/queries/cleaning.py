"""Missing values, duplicates and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.operators import clean as C
from sparkprep.operators.pollute import inject_missing, inject_outliers
from sparkprep.queries.quality import LINE_MEASURES, polluted_lines, polluted_lines_sql
from sparkprep.queries.registry import query, table
from sparkprep.queries.shapes import (
    TABLES,
    hit,
    is_outlier_sql,
    missing_sql,
    polluted,
    polluted_sql,
    stats_sql,
    types_of,
)


def imputed_sql(kinds: dict[str, str], rel: str = "polluted") -> str:
    """CTE ``imputed``: 0.0 in number columns, NA in all others."""
    cells = []
    for c, k in kinds.items():
        if k == "n":
            cells.append(f"coalesce({c}, 0.0) as {c}")
        elif k == "t":
            cells.append(f"coalesce(cast({c} as varchar), 'NA') as {c}")
        else:
            cells.append(f"coalesce(nullif({c}, ''), 'NA') as {c}")
    return f"imputed as (select {', '.join(cells)} from {rel})"


@query("q11_impute_missing", f"with {polluted_sql('orders')}, {imputed_sql(TABLES['orders'][1])} select * from imputed")
def impute(spark, folder):
    return C.impute_missing(polluted(table(spark, folder, "orders"), "orders"), types_of("orders"))


_flagged = """flagged as (select l_orderkey, l_linenumber, l_partkey, l_quantity,
  case when {a} then null else l_linestatus = 'F' end as is_final,
  case when {b} then '' else l_returnflag end as l_returnflag,
  case when {c} then null else l_tax end as l_tax from lineitem)"""
_line_text = "concat_ws('|', cast(l_orderkey as {t}), cast(l_linenumber as {t}), cast(l_partkey as {t}))"


@query(
    "q12_impute_baseline",
    "with "
    + _flagged.format(
        a=hit(_line_text.format(t="varchar"), "missing|is_final", "6666"),
        b=hit(_line_text.format(t="varchar"), "missing|l_returnflag", "6666"),
        c=hit(_line_text.format(t="varchar"), "missing|l_tax", "6666"),
    )
    + """ select l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(is_final, false) as is_final,
  coalesce(nullif(l_returnflag, ''), 'NA') as l_returnflag, coalesce(l_tax, 0.0) as l_tax from flagged""",
)
def impute_baseline(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_linestatus") == "F").alias("is_final"),
        "l_returnflag", "l_tax",
    )
    types = {c: "number" for c in df.columns} | {"is_final": "boolean", "l_returnflag": "string"}
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")
    dirty = inject_missing(df, types, key, columns=["is_final", "l_returnflag", "l_tax"])
    return C.impute_missing(dirty, types, C.BASELINE_DEFAULTS)


@query(
    "q13_drop_rows",
    f"with {polluted_sql('customer')} select * from polluted where {missing_sql(TABLES['customer'][1])} = 0",
)
def drop_rows(spark, folder):
    return C.drop_missing_rows(polluted(table(spark, folder, "customer"), "customer"))


SOME_COLUMNS = ["c_name", "c_acctbal"]


@query(
    "q14_drop_columns",
    f"with {polluted_sql('customer', SOME_COLUMNS)} select c_custkey, c_nationkey, c_mktsegment from polluted",
)
def drop_columns(spark, folder):
    return C.drop_missing_columns(polluted(table(spark, folder, "customer"), "customer", SOME_COLUMNS))


@query("q15_dedup", "select distinct text, lang, source from documents")
def dedup(spark, folder):
    return C.drop_duplicates(table(spark, folder, "documents").select("text", "lang", "source"))


@query(
    "q16_dedup_keep_first",
    """select l_suppkey, l_quantity, l_returnflag, l_linestatus, min(l_orderkey) as l_orderkey
from lineitem group by all""",
)
def dedup_keep_first(spark, folder):
    df = table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_orderkey")
    return C.drop_duplicates(df, order="l_orderkey")


@query(
    "q17_outlier_flags",
    f"""with scaled as (select event_id, user_id,
  case when {hit('cast(event_id as varchar)', 'outlier|value', '3333')} then value * 100 else value end as value from events),
{stats_sql('scaled', ['value'])}
select event_id, user_id, scaled.value as value, {is_outlier_sql('scaled', 'value')} as value_outlier from scaled, med, mad""",
)
def outlier_flags(spark, folder):
    df = table(spark, folder, "events").select("event_id", "user_id", "value")
    dirty = inject_outliers(df, {"value": "number"}, F.col("event_id"))
    return C.flag_outliers(dirty, {"value": "number"})


@query(
    "q18_outlier_impute",
    f"""with {polluted_sql('orders')}, {stats_sql('polluted', ['o_orderkey', 'o_custkey', 'o_totalprice'])}
select o_orderstatus, o_orderdate, o_orderpriority, """
    + ", ".join(
        f"case when {is_outlier_sql('polluted', c)} then med.{c} else polluted.{c} end as {c}"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
    + " from polluted, med, mad",
)
def outlier_impute(spark, folder):
    return C.impute_outliers(polluted(table(spark, folder, "orders"), "orders", stored=True), types_of("orders"))


def _sequential_sql(rel: str, cols: list[str]) -> tuple[str, str]:
    """CTEs that drop outliers column by column; returns them and the last name."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(stats_sql(rel, [c], f"_{i}"))
        parts.append(f"left_{i} as (select {rel}.* from {rel}, med_{i}, mad_{i} where not {is_outlier_sql(rel, c, f'_{i}')})")
        rel = f"left_{i}"
    return ", ".join(parts), rel


_seq, _seq_last = _sequential_sql("lines", LINE_MEASURES)


@query("q19_outlier_drop_sequential", f"with {polluted_lines_sql()}, {_seq} select * from {_seq_last}")
def outlier_drop_sequential(spark, folder):
    df = polluted_lines(spark, folder)
    return C.drop_outliers(df, {c: "number" for c in LINE_MEASURES})


@query(
    "q20_outlier_drop_simultaneous",
    f"""with {polluted_lines_sql()}, {stats_sql('lines', LINE_MEASURES)}
select lines.* from lines, med, mad where not ({' or '.join(is_outlier_sql('lines', c) for c in LINE_MEASURES)})""",
)
def outlier_drop_simultaneous(spark, folder):
    df = polluted_lines(spark, folder)
    return C.drop_outliers(df, {c: "number" for c in LINE_MEASURES}, sequential=False)


@query(
    "q20_unreadable_cells",
    f"""with {polluted_sql('customer')}
select count(*) filter (c_custkey is null) as c_custkey, count(*) filter (c_nationkey is null) as c_nationkey,
  count(*) filter (c_acctbal is null) as c_acctbal from polluted""",
)
def unreadable_cells(spark, folder):
    counts = C.unreadable_counts(polluted(table(spark, folder, "customer"), "customer"), types_of("customer"))
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])
