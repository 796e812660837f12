"""JSON scan and sink: records of objects, as JSON lines or inside one document.

Raw columns are variants, so one attribute can hold numbers, text and lists. An
attribute that an object lacks is NULL, which is not the same as a JSON null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.cells import ABSENT, quoted

# Most records that are written into one document; more go to part files beside it.
DOCUMENT_ROWS = 100_000


@dataclass(frozen=True)
class JsonRecords:
    """Records, the path of their list, the documents, and the text of what could not be read."""

    table: DataFrame
    path: str | None
    documents: DataFrame | None
    rejected: DataFrame | None = None


def step(name: str) -> str:
    """One object key as a path step; a key with a single quote stands in double quotes."""
    return f'["{name}"]' if "'" in name else f"['{name}']"


@F.pandas_udf(T.StringType())
def _first_list(texts: pd.Series) -> pd.Series:
    """Path of the first list, depth first in document order."""

    def find(node, path: str) -> str | None:
        if isinstance(node, list):
            return path
        if isinstance(node, dict):
            for key, child in node.items():
                found = find(child, path + step(key))
                if found:
                    return found
        return None

    def locate(text: str) -> str | None:
        try:
            return find(json.loads(text), "$")
        except ValueError:
            return None

    return texts.map(locate, na_action="ignore")


def locate_records(documents: DataFrame, column: str = "value") -> str | None:
    """Path of the record list; all documents must agree on it."""
    paths = [r[0] for r in documents.select(_first_list(column).alias("p")).filter("p is not null").distinct().take(2)]
    if len(paths) > 1:
        raise ValueError(f"documents keep their records in different places: {paths}")
    return paths[0] if paths else None


def attribute_counts(records: DataFrame, text: str = "value") -> DataFrame:
    """Attribute names over all objects, and how many objects have each."""
    return (
        records.select(F.explode(F.json_object_keys(text)).alias("attribute"))
        .groupBy("attribute")
        .agg(F.count(F.lit(1)).alias("n_objects"))
    )


def attribute_union(records: DataFrame, text: str = "value") -> list[str]:
    """All attribute names, sorted: the header of the table to be."""
    return sorted(r["attribute"] for r in attribute_counts(records, text).select("attribute").collect())


def spread(records: DataFrame, attributes: list[str], compat: bool = False) -> DataFrame:
    """One variant column per attribute from a variant column ``record``.

    ``compat`` marks absent attributes with the text ``_ext_`` instead of NULL.
    """
    out = []
    for a in attributes:
        c: Column = F.try_variant_get("record", "$" + step(a), "variant")
        if compat:
            c = F.coalesce(c, F.parse_json(F.lit(json.dumps(ABSENT))))
        out.append(c.alias(a))
    return records.select(*out)


def read_json_lines(spark: SparkSession, path: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines source, and the lines that hold no object."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    good = parsed.filter(is_object)
    return spread(good, attribute_union(good), compat), parsed.filter(~is_object).select("value")


def read_json_document(spark: SparkSession, path: str, compat: bool = False) -> JsonRecords | None:
    """Records of whole JSON documents; None if there is no list of objects.

    Documents without the list and list elements that are no objects are kept as
    rejected text. A document is one row and so one task: large inputs should be JSON lines.
    """
    documents = spark.read.text(path, wholetext=True)
    where = locate_records(documents)
    if where is None:
        return None
    lists = documents.select(F.try_variant_get(F.try_parse_json("value"), where, "variant").alias("list"))
    records = lists.lateralJoin(
        spark.tvf.variant_explode(F.col("list").outer()).select(F.col("value").alias("record"))
    ).select("record")
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), where, "variant")).startswith("ARRAY"), F.lit(False))
    odd = records.filter(F.col("record").isNotNull() & ~is_object).select(F.to_json("record").alias("value"))
    rejected = documents.filter(~listed).unionByName(odd)
    records, documents = records.filter(is_object), documents.filter(listed)
    attributes = attribute_union(records.select(F.to_json("record").alias("value")))
    if not attributes:
        return None
    return JsonRecords(spread(records, attributes, compat), where, documents, rejected)


def to_json_text(df: DataFrame) -> DataFrame:
    """One JSON object per row; ``_ext_`` cells and NULLs leave no key."""
    fields = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != ABSENT, c)
        elif isinstance(f.dataType, T.VariantType):
            c = F.when(F.to_json(c) != json.dumps(ABSENT), c)
        fields.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_json_text(df).write.mode(mode).text(path)


def write_json_document(
    df: DataFrame, path: str, records: JsonRecords | None = None, max_rows: int = DOCUMENT_ROWS
) -> None:
    """One document: the records in their old place, all other keys kept.

    A document is one value. More than ``max_rows`` records, or records of several
    documents, go to part files in ``<path>/records`` instead, and each document
    without its list is a line of ``<path>/envelopes``.
    """
    several = records is not None and records.documents is not None and records.documents.limit(2).count() > 1
    if several or df.limit(max_rows + 1).count() > max_rows:
        write_json_lines(df, f"{path.rstrip('/')}/records")
        if records is not None and records.path != "$" and records.documents is not None:
            _envelopes(records).write.text(f"{path.rstrip('/')}/envelopes")
        return
    body = to_json_text(df).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("body"))
    if records is None or records.path == "$" or records.documents is None:
        body.select(F.col("body").alias("value")).write.text(path)
        return
    key = records.path
    top = _top_level_key(key)
    outer = records.documents.limit(1)
    names = outer.select(F.explode(F.json_object_keys("value")).alias("k")).collect()
    variant = F.parse_json("value")
    parts = []
    for r in names:
        child = body.select("body").scalar() if r["k"] == top else F.to_json(F.variant_get(variant, "$" + step(r["k"]), "variant"))
        parts.append(F.concat(F.lit(json.dumps(r["k"]) + ":"), child))
    outer.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value")).write.text(path)


def _envelopes(records: JsonRecords) -> DataFrame:
    """Each document without the key that leads to its list."""
    top = _top_level_key(records.path)
    keys = F.filter(F.json_object_keys("value"), lambda k: k != F.lit(top))
    children = F.try_variant_get(F.parse_json("value"), "$", "map<string,variant>")
    held = records.documents.select(F.monotonically_increasing_id().alias("id"), children.alias("children"), keys.alias("names"))
    parts = held.select("id", "children", F.posexplode_outer("names").alias("i", "k"))
    child = F.to_json(F.col("children")[F.col("k")])
    name = F.to_json(F.array("k"))
    pair = F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":"), child)
    lines = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("i", pair.alias("p"))))).alias("ps"))
    return lines.select(F.concat(F.lit("{"), F.array_join("ps.p", ","), F.lit("}")).alias("value"))


def _top_level_key(path: str) -> str:
    """The first key of a path such as ``$['data']['rows']``."""
    return path[3 : path.index(path[2] + "]", 3)]
