"""Sessions, tables and written intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mnemospark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where unset, a local one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not yet in use in the shared folder."""
    return f"{shared_folder(spark)}/mnemospark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written to the shared folder: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def broadcast_if_small(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """`df` written down, and marked for broadcast if it has no more than so many rows; beyond that joins with it are left to the planner."""
    out = materialize(df, name)
    return F.broadcast(out) if out.limit(rows + 1).count() <= rows else out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialize that nothing reads any more."""
    for df in tables:
        remove_folder(df.sparkSession, df._written_to)
    for df in tables[:1]:
        release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that have run: it waits for the driver's garbage collection, which may be long in coming."""
    spark.sparkContext._jvm.System.gc()


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def version(spark: SparkSession, path: str) -> str:
    """Size and newest change of a file or of the files of a folder."""
    fs, target = _path(spark, path)
    status = fs.getFileStatus(target)
    files = fs.listStatus(target) if status.isDirectory() else [status]
    return f"{sum(f.getLen() for f in files)} {max((f.getModificationTime() for f in files), default=0)}"


def move(spark: SparkSession, source: str | None, target: str) -> None:
    """Renames a folder; without a source makes an empty one."""
    fs, to = _path(spark, target)
    if source is None:
        fs.mkdirs(to)
    else:
        fs.rename(_path(spark, source)[1], to)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever it lies."""
    fs, target = _path(spark, path)
    fs.delete(target, True)


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings (with __ for each dot) for the time of a block."""
    before = {key: spark.conf.get(key.replace("__", "."), None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key.replace("__", "."), value)
    try:
        yield
    finally:
        for key, value in before.items():
            name = key.replace("__", ".")
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

