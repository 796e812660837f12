"""Metric documents, run reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.operators.pollute import inject_duplicates
from sparkprep.operators.robust import outlier_stats
from sparkprep.queries.registry import query, table
from sparkprep.reports.report import render_reports
from sparkprep.session import scratch_path
from sparkprep.streaming import ingest
from sparkprep.streaming.metrics import ORIGINS, complete_runs, first_copies, latest_metrics, windowed_quality

_bundle = """concat('{"missing":{"missing_cells_percent":', cast(user_id as string), '},"outliers":{"numerical_outliers_percent":',
  cast(event_id % 9 as string), '},"duplicates":{"duplicate_rows_percent":', cast(event_id % 4 as string), '},"dq":', cast(event_id % 2 as string), '}')"""
_file = """concat('{"filename":"', event_type, '.csv","objects_count":', cast(event_id as string), ',"filesize_mbs":', cast(event_id % 100 as string), '}')"""
_plans = """concat('{"plans_computed_count":36,"plans_failed_count":', cast(event_id % 36 as string), ',"max_dq_achieved":', cast(event_id % 2 as string),
  ',"best_plan":["missingValues/impute","duplicates","outliers/impute"]}')"""

# One metric document per event: a run is a user, the origin follows the event's number.
DOCUMENTS = [
    "cast(user_id as string) as run_id",
    """case event_id % 5 when 0 then 'source_observer' when 1 then 'target_observer' when 2 then 'planning_engine'
    when 3 then 'pre_etl_pipeline' else 'post_etl_pipeline' end as source""",
    "ts",
    f"""case event_id % 5 when 0 then {_file} when 1 then {_file} when 2 then {_plans} else {_bundle} end as contents""",
]


def documents(spark, folder):
    return table(spark, folder, "events").selectExpr(*DOCUMENTS)


_latest = f"""docs as (select {', '.join(DOCUMENTS)} from events),
latest as (select * from docs qualify row_number() over (partition by run_id, source order by ts desc, contents desc) = 1)"""


@query("q47_metrics_latest", f"with {_latest} select run_id, source, ts, contents from latest")
def metrics_latest(spark, folder):
    return latest_metrics(documents(spark, folder))


_seen = f"""{_latest},
span as (select run_id, min(ts) as started, max(ts) as ended, count(distinct source) as n_origins from docs group by run_id),
wide as (select run_id, {', '.join(f"max(case when source = '{o}' then contents end) as {o}" for o in ORIGINS)} from latest group by run_id)"""


@query(
    "q47_complete_runs",
    f"with {_seen} select run_id, started, ended, {', '.join(ORIGINS)} from span join wide using (run_id) where n_origins = 5",
)
def runs_complete(spark, folder):
    return complete_runs(documents(spark, folder))


def _report_sql() -> str:
    def head(title: str, dashes: int) -> str:
        return f"'+ ' || repeat('-', {dashes}) || '{title}' || repeat('-', {dashes}) || ' +'"

    def line(label: str, value: str) -> str:
        return f"rpad('| {label}: ' || {value}, 99, ' ') || '|'"

    def field(origin: str, path: str) -> str:
        return f"json_extract_string({origin}, '{path}')"

    lines = [head("-------ETL Report-------", 36), line("time-elapsed", "printf('%.6f', epoch_us(ended) / 1e6 - epoch_us(started) / 1e6) || ' s'")]
    for origin, title in (("source_observer", "---Source File Info---"), ("target_observer", "---Target File Info---")):
        lines.append(head(title, 37))
        lines.append(line("filename", field(origin, "$.filename")))
        lines.append(line("objects-count", field(origin, "$.objects_count")))
        lines.append(line("filesize", field(origin, "$.filesize_mbs") + " || ' MBs'"))
    lines.append(head("-Planning Engine Stats", 37))
    for label, name in (("plans-computed", "plans_computed_count"), ("plans-failed", "plans_failed_count"), ("max-data-quality-score", "max_dq_achieved")):
        lines.append(line(label, field("planning_engine", f"$.{name}")))
    lines.append(line("best-plan", "'[''missingValues/impute'', ''duplicates'', ''outliers/impute'']'"))
    for origin, title in (("pre_etl_pipeline", "-Pre-ETL Source Stats-"), ("post_etl_pipeline", "-Post-ETL Source Stats")):
        lines.append(head(title, 37))
        lines.append(line("missing-cells-percent", field(origin, "$.missing.missing_cells_percent") + " || ' %'"))
        lines.append(line("numerical-outliers-percent", field(origin, "$.outliers.numerical_outliers_percent") + " || ' %'"))
        lines.append(line("duplicate-rows-percent", field(origin, "$.duplicates.duplicate_rows_percent") + " || ' %'"))
        lines.append(line("data-quality-score", field(origin, "$.dq")))
    lines.append("'+ ' || repeat('-', 96) || ' +'")
    parts = " union all ".join(f"select run_id, {i} as line_no, {expr} as line from runs" for i, expr in enumerate(lines, 1))
    return f"with {_seen}, runs as (select * from span join wide using (run_id) where n_origins = 5) {parts}"


@query("q48_run_reports", _report_sql())
def run_reports(spark, folder):
    return render_reports(documents(spark, folder))


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return ingest.file_stream(spark, folder, "parquet", schema, options={"pathGlobFilter": "events.parquet"})


@query("q49_stream_ingest", "select 'events.parquet' as run_id, 'source_observer' as source, count(*) as objects_count from events")
def stream_ingest(spark, folder):
    out = scratch_path(spark, "arrivals")
    write = ingest.store_batches(out, lambda batch: ingest.arrival_documents(batch, "source_observer"))
    ingest.watch_directory(_event_stream(spark, folder), write, scratch_path(spark, "arrivals-state")).awaitTermination()
    count = F.get_json_object("contents", "$.objects_count").cast("bigint")
    return spark.read.parquet(out).select("run_id", "source", count.alias("objects_count"))


@query(
    "q49_stream_complete_once",
    """with docs as (select cast(user_id as varchar) as run_id, event_id % 5 as origin from events)
select run_id from docs group by run_id having count(distinct origin) = 5""",
)
def stream_complete(spark, folder):
    """Runs whose five origins have all reported, each stored once."""
    stream = _event_stream(spark, folder).selectExpr(*DOCUMENTS)
    runs = complete_runs(stream).select("run_id")
    out = scratch_path(spark, "complete")
    query_ = (
        runs.writeStream.outputMode("update")
        .foreachBatch(ingest.store_once(out, runs.schema, "run_id"))
        .option("checkpointLocation", scratch_path(spark, "complete-state"))
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return spark.read.parquet(out).select("run_id")


@query(
    "q50_stream_windowed_quality",
    """with centre as (select median(value) as m from events), spread as (select median(abs(value - m)) as d from events, centre),
spans as (select time_bucket(interval '1 hour', ts) as window_start, count(*) as n_rows,
    sum(case when event_type is null or event_type = '' then 1 else 0 end) as m,
    sum(case when abs(value - centre.m) > 3 * d then 1 else 0 end) as o from events, centre, spread group by 1)
select window_start, n_rows, round(m * 100.0 / (n_rows * 3), 3) as missing_pct, round(o * 100.0 / n_rows, 3) as outlier_pct
from spans""",
)
def stream_quality(spark, folder):
    """Every window, open ones included, judged by the whole table's median and MAD."""
    stats = outlier_stats(table(spark, folder, "events"), ["value"])
    events = _event_stream(spark, folder).select("ts", "event_type", "user_id", "value")
    types = {"event_type": "string", "user_id": "string", "value": "number"}
    windows = windowed_quality(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", types, stats)
    newest = ingest.newest_rows(windows, "windows", ["window_start"])
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("q50_stream_first_copies", "select event_id, user_id, event_type, value from events")
def stream_dedup(spark, folder):
    events = _event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    repeated = inject_duplicates(events.select("event_id", "ts", "user_id", "event_type", "value"), F.col("event_id"))
    return ingest.run_to_table(first_copies(repeated, "ts", "10 minutes", ["event_id"]).drop("ts"), "first-copies")
