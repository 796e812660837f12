"""CSV and JSON sources and sinks, files and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.functions.cells import hash_fraction
from sparkprep.queries.registry import query, table
from sparkprep.queries.shapes import hit
from sparkprep.session import scratch_path
from sparkprep.sources.csv import quarantine, read_csv, write_csv
from sparkprep.sources.files import file_stats, sample_rows
from sparkprep.sources.json import attribute_counts, read_json_lines, write_json_lines

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "q30_sample_hash_topk",
    f"""select * from lineitem
order by md5(concat_ws('|', {', '.join(f'cast({c} as varchar)' for c in LINE_ID)}, 'sample')), {', '.join(LINE_ID)}
limit (select least(20, cast(floor(count(*) * 0.05) as bigint)) from lineitem)""",
)
def sample_topk(spark, folder):
    return sample_rows(table(spark, folder, "lineitem"), LINE_ID)


@query(
    "q39_json_key_union",
    """with docs as (select to_json({'event': event_id, 'kind': event_type}) as value from events
  union all select props from events)
select unnest(json_keys(value)) as attribute, count(*) as n_objects from docs group by 1""",
)
def json_key_union(spark, folder):
    events = table(spark, folder, "events")
    made = events.select(F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"))).alias("value"))
    return attribute_counts(made.unionByName(events.select(F.col("props").alias("value"))))


@query(
    "q40_json_absent_marker",
    """select conv_id, turn, case when role = 'user' then text end as question,
  case when role <> 'user' then text end as answer, role = 'user' as has_question, turn % 3 = 0 as null_note,
  turn % 3 = 1 as absent_note from conversations""",
)
def json_absent(spark, folder):
    """Absent keys, explicit nulls and values stay apart through a JSON file."""
    path = scratch_path(spark, "conversations")
    note = F.when(F.col("turn") % 3 == 0, F.lit(',"note":null')).when(F.col("turn") % 3 == 2, F.lit(',"note":"x"')).otherwise("")
    body = F.to_json(
        F.struct(
            "conv_id",
            "turn",
            F.when(F.col("role") == "user", F.col("text")).alias("question"),
            F.when(F.col("role") != "user", F.col("text")).alias("answer"),
        )
    )
    lines = table(spark, folder, "conversations").select(
        F.concat(body.substr(F.lit(1), F.length(body) - 1), note, F.lit("}")).alias("value")
    )
    lines.write.text(path)
    records, _ = read_json_lines(spark, path)
    return records.select(
        F.try_variant_get("conv_id", "$", "bigint").alias("conv_id"),
        F.try_variant_get("turn", "$", "bigint").alias("turn"),
        F.try_variant_get("question", "$", "string").alias("question"),
        F.try_variant_get("answer", "$", "string").alias("answer"),
        F.col("question").isNotNull().alias("has_question"),
        F.coalesce(F.is_variant_null("note"), F.lit(False)).alias("null_note"),
        F.col("note").isNull().alias("absent_note"),
    )


@query("q41_json_roundtrip", "select event_id, user_id, event_type, value, props from events")
def json_roundtrip(spark, folder):
    columns = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
    path = scratch_path(spark, "events-json")
    write_json_lines(table(spark, folder, "events").select(*columns), path)
    records, _ = read_json_lines(spark, path)
    return records.select(*[F.try_variant_get(c, "$", t).alias(c) for c, t in columns.items()])


@query("q51_csv_roundtrip", "select doc_id, text, lang, source, n_chars from documents")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "documents-csv")
    write_csv(table(spark, folder, "documents"), path)
    raw = read_csv(spark, path)
    return raw.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "n_chars")})


@query("q52_file_stats", "select 'orders.parquet' as file_name, count(*) as n_rows from orders")
def files(spark, folder):
    return file_stats(table(spark, folder, "orders")).select("file_name", "n_rows")


@query(
    "q53_quarantine",
    f"""select event_id, case when {hit('cast(event_id as varchar)', 'broken', '3333')} then null else value end as value,
  {hit('cast(event_id as varchar)', 'broken', '3333')} as is_bad from events""",
)
def broken_lines(spark, folder):
    """A fifth of the JSON lines is cut short; good and bad lines part ways."""
    path = scratch_path(spark, "events-broken")
    body = F.to_json(F.struct("event_id", "value"))
    cut = body.substr(F.lit(1), F.length(body) - 1)
    broken = hash_fraction(F.col("event_id"), "broken", 0.2)
    table(spark, folder, "events").select(F.when(broken, cut).otherwise(body).alias("value")).write.text(path)
    good, bad = read_json_lines(spark, path)
    return good.select(
        F.try_variant_get("event_id", "$", "bigint").alias("event_id"),
        F.try_variant_get("value", "$", "double").alias("value"),
        F.lit(False).alias("is_bad"),
    ).unionByName(
        bad.select(
            F.regexp_extract("value", '"event_id":(\\d+)', 1).cast("bigint").alias("event_id"),
            F.lit(None).cast("double").alias("value"),
            F.lit(True).alias("is_bad"),
        )
    )


@query(
    "q53_ragged_csv",
    f"""select count(*) filter (not {hit('cast(o_orderkey as varchar)', 'ragged', '3333')}) as n_good,
  count(*) filter ({hit('cast(o_orderkey as varchar)', 'ragged', '3333')}) as n_bad,
  cast(sum(case when not {hit('cast(o_orderkey as varchar)', 'ragged', '3333')} then o_custkey end) as bigint) as sum_custkey
from orders""",
)
def ragged_csv(spark, folder):
    """Rows with a surplus cell are set aside with their raw text."""
    path = scratch_path(spark, "orders-ragged")
    surplus = F.when(hash_fraction(F.col("o_orderkey"), "ragged", 0.2), F.lit(",surplus")).otherwise("")
    line = F.concat(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus"), surplus)
    table(spark, folder, "orders").select(line.alias("value")).write.text(path)
    raw = spark.read.csv(
        path, schema="o_orderkey string, o_custkey string, o_orderstatus string, _corrupt_record string",
        mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record",
    )
    good, bad = quarantine(raw)
    return good.agg(F.count("o_orderkey").alias("n_good"), F.sum(F.col("o_custkey").cast("bigint")).alias("sum_custkey")).select(
        "n_good", bad.agg(F.count(F.lit(1))).scalar().alias("n_bad"), "sum_custkey"
    )
