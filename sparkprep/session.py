"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(app: str = "sparkprep", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with its executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="sparkprep-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/sparkprep/{name}-{uuid.uuid4().hex}"


def rebalanced(df: DataFrame) -> DataFrame:
    """Spread a table whose scan has fewer tasks than the session has cores over all of them.

    Larger tables are left as they are: they need no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pinned(row: DataFrame) -> DataFrame:
    """A one-row frame of finished numbers instead of the jobs behind them."""
    return row.sparkSession.createDataFrame([row.first()], row.schema)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a shuffled or costly result feeds several later passes: the passes
    then prune columns from Parquet instead of repeating the work, and the files
    outlive any executor. The folder is the caller's to clear between runs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries run inside, then the former ones again."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Scratch:
    """Steps of one operator, written like ``materialise`` does, each dropped when nothing reads it any more.

    A written step needs the shuffles behind it no longer, so their files go with the
    write. Python workers get batches bounded by rows and bytes: rows that hold whole
    texts are few at a time, however many a task has. Dropping a step is for its
    writer to decide, when the steps that read it are written themselves; what is
    not dropped stays in the shared folder.
    """

    SETTINGS = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    }

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The step under a name that no other kept step has."""
        if name in self._paths:
            raise ValueError(f"step {name} is still kept")
        path = scratch_path(self.spark, name)
        with settings(self.spark, self.SETTINGS):
            df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
