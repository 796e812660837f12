"""File arrival streams: every new file becomes one run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkprep.plans.apply import Preparation, run_preparation
from sparkprep.reports.report import quality_document
from sparkprep.session import materialise, scratch_path

FILE_COLUMNS = ["file_name", "file_size"]


def file_stream(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | str,
    files_per_batch: int = 1,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A stream over the files of a folder, with the name and size of the file."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load(path).select("*", "_metadata.file_name", "_metadata.file_size")


def watch_directory(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Run ``on_batch`` for every arrival; ``once`` stops after what is there now.

    The checkpoint remembers which files are done across restarts.
    """
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def store_batches(
    table: str, prepare: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Batch function that writes ``prepare(batch)`` under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so every
    file counts exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return write


def store_once(table: str, schema: T.StructType, key: str) -> Callable[[DataFrame, int], None]:
    """Batch function that keeps only the first row that a key ever yields.

    Keys of earlier batches are left out, so an update stream that reports a key
    again is stored once; running a batch again gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
            earlier = spark.read.schema(stored).parquet(table).filter(F.col("batch_id") < batch_id)
            batch = batch.join(earlier.select(key), key, "left_anti")
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return write


def prepare_batches(
    table: str, prep: Preparation, run_id: Callable[[int], str] = "run-{}".format
) -> Callable[[DataFrame, int], None]:
    """Batch function that prepares every arrival and stores rows and metrics.

    Rows go to ``table/rows``, the metric documents before and after to
    ``table/documents``; a failed arrival leaves zero metrics and no rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        batch = materialise(batch.drop(*FILE_COLUMNS), "arrival")
        result = run_preparation(batch, prep)
        if result.table is not None:
            result.table.write.mode("overwrite").parquet(f"{table}/rows/batch_id={batch_id}")
        documents = quality_document(result.before, run_id(batch_id), "pre_etl_pipeline", now).unionByName(
            quality_document(result.after, run_id(batch_id), "post_etl_pipeline", now)
        )
        documents.write.mode("overwrite").parquet(f"{table}/documents/batch_id={batch_id}")

    return write


def arrival_documents(batch: DataFrame, origin: str) -> DataFrame:
    """One metric document per file of a batch: run_id, source, ts, contents."""
    return (
        batch.groupBy(*FILE_COLUMNS)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("file_name").alias("run_id"),
            F.lit(origin).alias("source"),
            F.current_timestamp().alias("ts"),
            F.to_json(
                F.struct(
                    F.col("file_name").alias("filename"),
                    F.col("n").alias("objects_count"),
                    F.round(F.col("file_size") / (1024 * 1024), 2).alias("filesize_mbs"),
                )
            ).alias("contents"),
        )
    )


def join_samples(samples: DataFrame, targets: DataFrame, plans: DataFrame) -> DataFrame:
    """Sample, target and plan messages of the same run, side by side."""
    return (
        samples.withColumnRenamed("contents", "sample")
        .join(targets.withColumnRenamed("contents", "target"), "run_id")
        .join(plans.withColumnRenamed("contents", "plan"), "run_id", "left")
    )


def newest_rows(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over everything present; the last row it gave for each key.

    Windows that are still open at the end are in the result as they stand.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    writer = stream.writeStream.foreachBatch(store_batches(out, lambda batch: batch)).outputMode("update")
    writer = writer.option("checkpointLocation", scratch_path(spark, name + "-state")).trigger(availableNow=True)
    writer.start().awaitTermination()
    stored = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(stored).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch_id").alias("last"))
    return last.select("last.*")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything present, into Parquet, and read the result."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, name + "-state"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
