"""CSV scan and sink: header row, every cell text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.session import materialise

CORRUPT = "_corrupt_record"


def csv_columns(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names from the header row."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', encoding=encoding).columns


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    multi_line: bool = True,
    columns: list[str] | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """All cells as text; an empty cell is NULL.

    Quoted line breaks need ``multi_line``, which reads a file in one task. Large
    files without such cells should turn it off, so that Spark can split them.
    With ``keep_corrupt`` the raw text of rows with too few or too many cells
    goes to ``_corrupt_record``. Passing the columns saves reading the header.
    """
    names = columns or csv_columns(spark, path, encoding)
    fields = [T.StructField(c, T.StringType()) for c in names]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return spark.read.csv(
        path,
        schema=T.StructType(fields),
        header=True,
        multiLine=multi_line,
        quote='"',
        escape='"',
        encoding=encoding,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
        enforceSchema=True,
    )


def quarantine(df: DataFrame, corrupt: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """Good rows without the corrupt column, and the raw text of the bad ones.

    The scan is parsed and stored once; both parts read the stored rows.
    """
    df = materialise(df, "parsed")
    good = df.filter(F.col(corrupt).isNull()).drop(corrupt)
    bad = df.filter(F.col(corrupt).isNotNull()).select(corrupt)
    return good, bad


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files, each with the header; ``_ext_`` cells are kept."""
    df.write.csv(path, header=True, mode=mode, quote='"', escape='"', emptyValue="", nullValue="")
