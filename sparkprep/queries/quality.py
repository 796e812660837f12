"""Quality scores, metrics, profiles and pollution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.operators import pollute as P
from sparkprep.operators import quality as Q
from sparkprep.operators.profile import (
    infer_schema,
    inference_accuracy,
    profile_columns,
    type_counts,
    typed,
    value_counts,
)
from sparkprep.queries.registry import query, table
from sparkprep.queries.shapes import (
    TABLES,
    hit,
    metrics_columns_sql,
    missing_sql,
    polluted,
    polluted_sql,
    quality_sql,
    stats_sql,
    types_of,
)
from sparkprep.session import materialise, rebalanced


def _rounded_dq(df):
    return df.withColumn("dq", F.round("dq", 9))


@query(
    "q01_dq_score",
    f"""with {polluted_sql('events')}, {quality_sql('polluted', TABLES['events'][1])}
select n_rows, round(missing_ratio, 9) as missing_ratio, round(dup_ratio, 9) as dup_ratio,
  round(outlier_ratio, 9) as outlier_ratio, round(dq, 9) as dq from quality""",
)
def dq_score(spark, folder):
    df = polluted(table(spark, folder, "events"), "events", stored=True)
    ratios = Q.quality_ratios(df, types_of("events"))
    return ratios.select("n_rows", *[F.round(c, 9).alias(c) for c in ratios.columns[1:]])


def _joined_text(kinds: dict[str, str], absent: str) -> str:
    return "concat(" + ", ".join(f"coalesce(cast({c} as varchar), {absent})" for c in kinds) + ")"


@query(
    "q02_dq_score_compat",
    f"""with {polluted_sql('events')}, {stats_sql('polluted', ['value'])},
tally as (select count(*) as n, sum({missing_sql(TABLES['events'][1], 'polluted')}) as m,
    sum(case when abs(polluted.value - med.value) > 3 * mad.value then 1 else 0 end) as o
  from polluted, med, mad),
uniq as (select count(*) as d from (select distinct * from polluted)),
texts as (select count(distinct {_joined_text(TABLES['events'][1], "'None'")}) as t from polluted)
select cast(n as bigint) as n_rows, round(m * 100.0 / (n * 6), 3) as missing_pct,
  round(abs(n - t - 1) * 100.0 / n, 3) as dup_pct, round(o * 100.0 / (n * 3), 3) as outlier_pct,
  round(1.0 - abs((cast(m as double) / (n * 6) + cast(n - d - 1 as double) / n + cast(o as double) / (n * 3)) / 3), 9) as dq
from tally, uniq, texts""",
)
def dq_score_compat(spark, folder):
    df = polluted(table(spark, folder, "events"), "events", stored=True)
    return _rounded_dq(Q.quality_metrics(df, types_of("events"), compat=True))


@query(
    "q03_missing_pct",
    f"""with {polluted_sql('orders')}
select count(*) as n_rows, cast(count(*) * 6 as bigint) as n_cells,
  cast(sum({missing_sql(TABLES['orders'][1])}) as bigint) as n_missing,
  round(sum({missing_sql(TABLES['orders'][1])}) * 100.0 / (count(*) * 6), 3) as missing_pct
from polluted""",
)
def missing_pct(spark, folder):
    return Q.missing_pct(polluted(table(spark, folder, "orders"), "orders"))


@query(
    "q04_dup_pct",
    f"""with {polluted_sql('customer')},
counts as (select (select count(*) from polluted) as n, (select count(*) from (select distinct * from polluted)) as d)
select cast(n as bigint) as n_rows, cast(d as bigint) as n_distinct, round((n - d) * 100.0 / n, 3) as dup_pct from counts""",
)
def dup_pct(spark, folder):
    return Q.duplicate_pct(polluted(table(spark, folder, "customer"), "customer"))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = "concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar))"
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def polluted_lines(spark, folder):
    """lineitem with outliers in its four measures, stored for many passes."""
    df = rebalanced(table(spark, folder, "lineitem").drop("l_linestatus", "l_shipdate"))
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")
    return materialise(
        P.inject_outliers(df, {c: "number" for c in LINE_NUMBERS}, key, columns=LINE_MEASURES), "polluted-lines"
    )


def polluted_lines_sql(columns: str = "*") -> str:
    kept = {c: c for c in LINE_NUMBERS if c not in LINE_MEASURES} | {"l_returnflag": "l_returnflag"}
    scaled = [
        f"case when {hit(LINE_KEY, 'outlier|' + c, '3333')} and {c} is not null then {c} * 100 else {c} end as {c}"
        for c in LINE_MEASURES
    ]
    return f"lines as (select {', '.join([*kept, *scaled])} from lineitem)"


_line_union = " union all ".join(
    f"""select '{c}' as "column", cast(count(*) as bigint) as n_rows, count(lines.{c}) as n_numbers,
  cast(any_value(med.{c}) as double) as median, round(cast(any_value(mad.{c}) as double), 9) as mad,
  cast(sum(case when abs(lines.{c} - med.{c}) > 3 * mad.{c} then 1 else 0 end) as bigint) as n_outliers
  from lines, med, mad"""
    for c in LINE_NUMBERS
)


@query("q05_outlier_counts", f"with {polluted_lines_sql()}, {stats_sql('lines', LINE_NUMBERS)} {_line_union}")
def outlier_counts(spark, folder):
    df = polluted_lines(spark, folder).select(*LINE_NUMBERS)
    return Q.outlier_counts(df, {c: "number" for c in LINE_NUMBERS}).withColumn("mad", F.round("mad", 9))


@query(
    "q05_outlier_pct",
    f"""with {polluted_lines_sql()}, {stats_sql('lines', LINE_NUMBERS)}, per_column as ({_line_union})
select cast(sum(n_rows) as bigint) as n_numeric_cells, cast(sum(n_outliers) as bigint) as n_outliers,
  round(sum(n_outliers) * 100.0 / sum(n_rows), 3) as outlier_pct from per_column""",
)
def outlier_pct(spark, folder):
    df = polluted_lines(spark, folder).select(*LINE_NUMBERS)
    return Q.outlier_pct(df, {c: "number" for c in LINE_NUMBERS})


@query(
    "q06_metrics_bundle",
    f"""with {polluted_sql('orders')}, {quality_sql('polluted', TABLES['orders'][1])}
select {metrics_columns_sql()} from quality""",
)
def metrics_bundle(spark, folder):
    df = polluted(table(spark, folder, "orders"), "orders", stored=True)
    return _rounded_dq(Q.quality_metrics(df, types_of("orders")))


@query(
    "q07_baseline_bundle",
    f"""with {polluted_sql('customer')}, {stats_sql('polluted', ['c_acctbal'])},
tally as (select count(*) as n, sum({missing_sql(TABLES['customer'][1], 'polluted')}) as m,
    sum(case when abs(polluted.c_acctbal - med.c_acctbal) > 3 * mad.c_acctbal then 1 else 0 end) as o
  from polluted, med, mad),
texts as (select count(distinct {_joined_text(TABLES['customer'][1], "''")}) as t from polluted)
select cast(n as bigint) as n_rows, round(cast(m as double) / (n * 5), 3) as m,
  round(cast(abs(n - t - 1) as double) / n, 3) as d, round(cast(o as double) / (n * 3), 3) as o
from tally, texts""",
)
def baseline_bundle(spark, folder):
    return Q.baseline_metrics(polluted(table(spark, folder, "customer"), "customer", stored=True), types_of("customer"))


def _as_text(df):
    """Every column as text, as a CSV scan would deliver it."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _type_counts_sql() -> str:
    parts = []
    for c, kind in TABLES["orders"][1].items():
        cell = f"cast({c} as varchar)"
        parts.append(
            f"""select '{c}' as "column", case when try_cast({cell} as double) is not null then 'number'
  else 'string' end as cell_type, count(*) as n from polluted where {c} is not null and {cell} <> '' group by 1, 2"""
        )
    return f"with {polluted_sql('orders')} " + " union all ".join(parts)


@query("q08_cell_types", _type_counts_sql())
def cell_types(spark, folder):
    return type_counts(_as_text(polluted(table(spark, folder, "orders"), "orders")))


VALUE_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "q08_value_counts",
    " union all ".join(
        f"""select '{c}' as "column", cast({c} as varchar) as value, count(*) as n from orders
  where {c} is not null and cast({c} as varchar) <> '' group by 1, 2"""
        for c in VALUE_COLUMNS
    ),
)
def column_values(spark, folder):
    return value_counts(table(spark, folder, "orders"), VALUE_COLUMNS)


PROFILED = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_linenumber l_quantity l_discount l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
}


def _profile_sql() -> str:
    parts = []
    for name, columns in PROFILED.items():
        for i, c in enumerate(columns.split()):
            parts.append(
                f"""select '{name}' as table_name, {i} as position, '{c}' as "column", count(*) as n_cells,
  count(*) filter ({c} is null or cast({c} as varchar) = '') as n_missing,
  count(*) filter (try_cast(cast({c} as varchar) as double) is not null) as n_number,
  count(*) filter ({c} is not null and cast({c} as varchar) <> '' and try_cast(cast({c} as varchar) as double) is null) as n_string,
  cast(least(count(distinct case when cast({c} as varchar) <> '' then {c} end), 3) as integer) as distinct_class from {name}"""
            )
    return f"""select *, case when distinct_class = 2 then 'boolean' when n_number > 0 and n_string > 0 then 'ambiguous'
  when n_number > 0 then 'number' else 'string' end as inferred_type from ({' union all '.join(parts)})"""


def _profiles(spark, folder):
    out = None
    for name, columns in PROFILED.items():
        part = profile_columns(_as_text(table(spark, folder, name).select(*columns.split())))
        part = part.drop("n_complex").withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("q09_infer_schema", _profile_sql())
def inferred_schema(spark, folder):
    return _profiles(spark, folder)


# What a person would call the columns; labels are numbers to the eye.
TRUTH = {
    ("customer", "c_custkey"): "number",
    ("customer", "c_name"): "string",
    ("orders", "o_orderstatus"): "string",
    ("orders", "o_totalprice"): "number",
    ("orders", "o_orderdate"): "string",
    ("lineitem", "l_linestatus"): "boolean",
    ("lineitem", "l_quantity"): "number",
    ("events", "props"): "string",
    ("events", "value"): "number",
    ("labels", "quality"): "number",
    ("labels", "toxic"): "boolean",
}

_truth_rows = ", ".join(f"('{t}', '{c}', '{v}')" for (t, c), v in TRUTH.items())


@query(
    "q10_schema_accuracy",
    f"""with truth(table_name, "column", true_type) as (values {_truth_rows}),
inferred as ({_profile_sql()})
select count(*) as n_columns, count(*) filter (inferred_type = true_type) as n_correct,
  round(count(*) filter (inferred_type = true_type) * 100.0 / count(*), 2) as accuracy_pct
from truth left join inferred using (table_name, "column")""",
)
def schema_accuracy(spark, folder):
    truth = spark.createDataFrame(
        [(t, c, v) for (t, c), v in TRUTH.items()], "table_name string, column string, true_type string"
    )
    return inference_accuracy(_profiles(spark, folder), truth, by=("table_name", "column"))


@query(
    "q31_pollute_missing",
    "select "
    + ", ".join(
        f"case when {hit('cast(event_id as varchar)', 'missing|' + c, '6666')} then {chr(39) * 2 if k == 's' else 'null'} else {c} end as {c}"
        for c, k in TABLES["events"][1].items()
    )
    + " from events",
)
def pollute_missing(spark, folder):
    df = table(spark, folder, "events").withColumn("key", F.col("event_id"))
    out = P.inject_missing(df, types_of("events"), F.col("key"), columns=list(TABLES["events"][1]))
    return out.drop("key")


@query(
    "q32_pollute_duplicates",
    f"""select * from orders union all
select * from orders where {hit('cast(o_orderkey as varchar)', 'duplicate', '3333')}""",
)
def pollute_duplicates(spark, folder):
    return P.inject_duplicates(table(spark, folder, "orders"), F.col("o_orderkey"))


@query(
    "q33_pollute_outliers",
    "select o_orderkey, o_orderstatus, "
    + ", ".join(
        f"case when {hit('cast(o_orderkey as varchar)', 'outlier|' + c, '3333')} then cast({c} as double) * 100 else cast({c} as double) end as {c}"
        for c in ("o_custkey", "o_totalprice")
    )
    + " from orders",
)
def pollute_outliers(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    return P.inject_outliers(df, types_of("orders"), F.col("o_orderkey"), columns=["o_custkey", "o_totalprice"])


@query(
    "q56_pollute_run",
    f"""with {polluted_sql('events')}, {quality_sql('events', TABLES['events'][1], '_b')},
{quality_sql('polluted', TABLES['events'][1], '_a')},
b as (select round(missing_ratio * 100, 3) as missing_pct, round(dup_ratio * 100, 3) as dup_pct,
  round(outlier_ratio * 100, 3) as outlier_pct, dq from quality_b),
a as (select round(missing_ratio * 100, 3) as missing_pct, round(dup_ratio * 100, 3) as dup_pct,
  round(outlier_ratio * 100, 3) as outlier_pct, dq from quality_a)
"""
    + " union all ".join(
        f"select '{m}' as metric, round(b.{m}, 9) as before, round(a.{m}, 9) as after, round(a.{m} - b.{m}, 9) as change from b, a"
        for m in ("missing_pct", "dup_pct", "outlier_pct", "dq")
    ),
)
def pollute_run(spark, folder):
    clean = table(spark, folder, "events")
    dirty = polluted(clean, "events", stored=True)
    types = types_of("events")
    out = Q.compare_quality(Q.quality_metrics(clean, types), Q.quality_metrics(dirty, types))
    return out.select("metric", *[F.round(c, 9).alias(c) for c in ("before", "after", "change")])


@query(
    "q09_typed_columns",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate,
  o_orderpriority from orders""",
)
def typed_columns(spark, folder):
    """Text columns back to numbers by their inferred type."""
    raw = _as_text(table(spark, folder, "orders"))
    return typed(raw, infer_schema(raw), integers=True)
