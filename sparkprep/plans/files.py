"""A raw file in, a prepared file of the same format out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from sparkprep.operators.restructure import Rule
from sparkprep.plans.run import FullRun, observe, prepare
from sparkprep.sources.csv import quarantine, read_csv, write_csv
from sparkprep.sources.json import read_json_document, read_json_lines, write_json_document, write_json_lines


def prepare_file(
    spark: SparkSession,
    source: str,
    target: str,
    mapping: Sequence[Rule],
    sample_keys: Sequence[str] = (),
    standardise: Callable[[DataFrame], DataFrame] | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    **options,
) -> FullRun:
    """Prepare a CSV, JSON or JSON-lines source and write it at ``target``.

    Records that cannot be read (ragged rows, broken lines or documents, list
    elements that are no objects) are stored as text at ``<target>_rejected``: good
    and bad ones together are the input. CSV files are split over tasks; quoted line
    breaks need ``multi_line``. A failed run writes no table. The run's documents
    are the five of a complete run.
    """
    fmt = source.rstrip("/").rsplit(".", 1)[-1].lower()
    records = None
    if fmt == "csv":
        table, rejected = quarantine(read_csv(spark, source, encoding, multi_line, keep_corrupt=True))
    elif fmt == "jsonl":
        table, rejected = read_json_lines(spark, source)
    elif fmt == "json":
        records = read_json_document(spark, source)
        if records is None:
            raise ValueError(f"{source} holds no list of objects")
        table, rejected = records.table, records.rejected
    else:
        raise ValueError(f"unsupported format {fmt!r}")

    name = source.rstrip("/").rsplit("/", 1)[-1]
    seen = observe(table, name, "source_observer", name, _megabytes(spark, source))
    rejected.toDF("value").write.text(f"{target.rstrip('/')}_rejected")
    run = prepare(table, mapping, sample_keys, standardise, run_id=name, **options)
    if run.result.table is not None:
        if fmt == "csv":
            write_csv(run.result.table, target)
        elif fmt == "jsonl":
            write_json_lines(run.result.table, target)
        else:
            write_json_document(run.result.table, target, records)
    documents = run.documents.unionByName(seen)
    if run.result.table is not None:
        made = target.rstrip("/").rsplit("/", 1)[-1]
        documents = documents.unionByName(observe(run.result.table, name, "target_observer", made, _megabytes(spark, target)))
    return replace(run, documents=documents, rejected=rejected)


def _megabytes(spark: SparkSession, path: str) -> float:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return round((files.agg({"length": "sum"}).first()[0] or 0) / (1024 * 1024), 2)
