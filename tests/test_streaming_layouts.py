import datetime as dt
import json

from pyspark.sql import functions as F

from sparkprep.operators.standardise import LAYOUTS
from sparkprep.reports.report import header, render_reports, save_reports
from sparkprep.session import scratch_path
from sparkprep.streaming import ingest
from sparkprep.streaming.metrics import ORIGINS, complete_runs, latest_metrics

QUALITY = {"missing": {"missing_cells_percent": 10.717}, "outliers": {"numerical_outliers_percent": 2.483},
           "duplicates": {"duplicate_rows_percent": 3.127}, "dq": 0.946}
PLANS = {"plans_computed_count": 36, "plans_failed_count": 0, "max_dq_achieved": 0.983, "best_plan": ["missingValues/impute", "duplicates", "outliers/impute"]}
FILE = {"filename": "soil_source.csv", "objects_count": 65535, "filesize_mbs": 7662.23}


def documents(spark, run_id="r", origins=ORIGINS):
    contents = dict(zip(ORIGINS, [FILE, FILE, PLANS, QUALITY, QUALITY]))
    start = dt.datetime(2025, 1, 1)
    rows = [(run_id, o, start + dt.timedelta(seconds=1.5 * i), json.dumps(contents[o])) for i, o in enumerate(origins)]
    rows.append((run_id, origins[0], start - dt.timedelta(seconds=1), "{}"))
    return spark.createDataFrame(rows, "run_id string, source string, ts timestamp_ntz, contents string")


def test_report_lines(spark, tmp_path):
    docs = documents(spark).unionByName(documents(spark, "open", ORIGINS[:4]))
    lines = render_reports(docs)
    text = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert len(text) == 26 and all(len(x) == 100 for x in text)
    assert text[0] == "+ " + "-" * 43 + "ETL Report" + "-" * 43 + " +"
    assert text[1].startswith("| time-elapsed: 7.000000 s ") and text[1].endswith("|")
    assert text[14].startswith("| best-plan: ['missingValues/impute', 'duplicates', 'outliers/impute'] ")
    assert text[16].startswith("| missing-cells-percent: 10.717 % ")
    assert header("-Post-ETL Source Stats") in text
    path = save_reports(lines, str(tmp_path), dt.datetime(2025, 5, 31, 16, 5))
    assert path.endswith("etl_2025_05_31_16_05_00")
    assert spark.read.text(path).count() == 26


def test_latest_and_complete_runs(spark):
    docs = documents(spark).unionByName(documents(spark, "open", ORIGINS[:4]))
    last = {(r["run_id"], r["source"]): r["contents"] for r in latest_metrics(docs).collect()}
    assert len(last) == 9 and json.loads(last["r", ORIGINS[0]]) == FILE
    assert [r["run_id"] for r in complete_runs(docs).collect()] == ["r"]


def test_complete_runs_as_a_stream(spark):
    folder = scratch_path(spark, "documents")
    first, second = ORIGINS[:2], ORIGINS[2:]
    documents(spark).filter(F.col("source").isin(*first)).write.json(f"{folder}/a")
    documents(spark).filter(F.col("source").isin(*second)).write.json(f"{folder}/b")
    schema = "run_id string, source string, ts timestamp_ntz, contents string"
    stream = spark.readStream.schema(schema).json(f"{folder}/*")
    out = scratch_path(spark, "complete")
    write = ingest.store_batches(out, lambda batch: batch)
    query = (
        complete_runs(stream).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r["run_id"] for r in spark.read.parquet(out).collect()} == {"r"}


def test_every_file_is_one_batch_and_counts_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, n in enumerate((3, 5)):
        (folder / f"f{i}.csv").write_text("a,b\n" + "1,2\n" * n)
    stream = ingest.file_stream(spark, str(folder), "csv", "a string, b string", options={"header": "true"})
    out, state = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    write = ingest.store_batches(out, lambda b: ingest.arrival_documents(b, "source_observer"))
    ingest.watch_directory(stream, write, state).awaitTermination()
    ingest.watch_directory(stream, write, state).awaitTermination()
    counts = {r["run_id"]: json.loads(r["contents"])["objects_count"] for r in spark.read.parquet(out).collect()}
    assert counts == {"f0.csv": 3, "f1.csv": 5}
    messages = spark.read.parquet(out).select("run_id", "contents")
    joined = ingest.join_samples(messages, messages, messages.limit(0))
    assert joined.count() == 2


def test_updates_are_stored_once(spark):
    out = scratch_path(spark, "once")
    batch = lambda *keys: spark.createDataFrame([(k,) for k in keys], "run_id string")
    write = ingest.store_once(out, batch("a").schema, "run_id")
    for number, keys in enumerate([("a", "b"), ("b", "c"), ("c",)]):
        write(batch(*keys), number)
    write(batch("b", "c"), 1)
    assert sorted(r["run_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_prepared_arrivals_equal_the_batch_run(spark, tmp_path):
    from sparkprep.plans.apply import Preparation, apply_preparation

    folder = tmp_path / "arrivals"
    folder.mkdir()
    text = "id,v\n" + "".join(f"{i % 30},{i % 30 if i % 7 else ''}\n" for i in range(40))
    (folder / "one.csv").write_text(text)
    prep = Preparation(steps=("missingValues/impute", "duplicates", "outliers/impute"))
    stream = ingest.file_stream(spark, str(folder), "csv", "id string, v string", options={"header": "true"})
    out = scratch_path(spark, "prepared")
    ingest.watch_directory(stream, ingest.prepare_batches(out, prep), scratch_path(spark, "state")).awaitTermination()
    batch = apply_preparation(spark.read.csv(str(folder), header=True, schema="id string, v string"), prep)
    got = spark.read.parquet(f"{out}/rows").drop("batch_id")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
    assert {r["source"] for r in spark.read.parquet(f"{out}/documents").collect()} == {"pre_etl_pipeline", "post_etl_pipeline"}


def one(spark, layout, **cells):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()])
    return LAYOUTS[layout](df).first().asDict()


def test_published_examples(spark):
    film = one(
        spark, "films", ID="1", film="T", film_rating="G", cinema_score="A", release_date="22/11/1995", run_time="81",
        budget="30000000", box_office_other="1", box_office_worldwide="394436586", rotten_tomatoes_score="100",
        rotten_tomatoes_counts="96", metacritic_score="95", metacritic_counts="26", imdb_score="8.3", imdb_counts="1089101",
    )
    assert film["released_date"] == "1995-November-22" and film["budget_millions"] == 30.0
    assert film["imdb_counts_millions"] == 1089.101 and film["rotten_tomatoes_counts_millions"] == "96"
    user = one(
        spark, "streaming_users", User_ID="1", Name="Ann van Dyk", Age="18", Country="F", Subscription_Type="P",
        Watch_Time_Hours="70.5", Favorite_Genre="D", Last_Login="2024-05-12",
    )
    assert (user["first_name"], user["last_name"], user["watch_time_hours"], user["last_access"]) == ("Ann", "van Dyk", 80, "12-May-24")
    route = one(spark, "flight_routes", src="Linz LNZ", dst="NA", src_lat="1", src_lon="2", dst_lat="3", dst_lon="4")
    assert (route["source"], route["source_airport_code"], route["destination"]) == ("Linz", "LNZ", "NA")
    stock = one(spark, "stock_prices", date="2000-01-03 00:00:00-05:00", open="4.0754", high="1", low="1", close="1", adj_close="1", volume="322352000")
    assert (stock["date"], stock["open_price"], stock["trade_volume_millions"]) == ("2000/01/03", 4.075, 322.352)
    review = one(
        spark, "product_reviews", reviewerID="a", asin="b", reviewerName="c", reviewTime="02 3, 2013", overall="5.0",
        summary="Cute ", helpful="", reviewText="", unixReviewTime="1",
    )
    assert (review["review_date"], review["summary"]) == ("03-02-2013", "cute")
    sale = one(
        spark, "ecommerce", InvoiceNo="1", StockCode="2", Description="RED Coat", Quantity="3", InvoiceDate="2010-12-01 08:34:00",
        UnitPrice="4.95", CustomerID="9", Country="NA",
    )
    assert (sale["invoice_date"], sale["desc"], sale["country"]) == ("01-12-10 08-34-00", "red coat", "NA")


def test_lists_after_imputation_still_join(spark):
    from sparkprep.operators.clean import impute_missing

    df = spark.createDataFrame([("1", ["a", "b"], "X"), ("2", None, "")], "id string, ingredients array<string>, cuisine string")
    out = LAYOUTS["recipes"](impute_missing(df, {"id": "number", "ingredients": "complex", "cuisine": "string"}))
    assert [r["ingredients_list"] for r in out.orderBy("recipe_id").collect()] == ["a| b", "NA"]
