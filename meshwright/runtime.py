"""Session services: the shared folder, written intermediate tables and lineage cuts.

Intermediate tables are written as Parquet into the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read them after another one is lost. A folder
of our own is made only where the setting is missing, as in local tests.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = getattr(sc, "_meshwright_dir", None)
    if made is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        local = tempfile.mkdtemp(prefix="meshwright-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        made = sc._meshwright_dir = "file://" + local
    return made


def session_dir(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark)}/meshwright/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet written are lost."""
    where = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lay_out(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` laid out by some keys once and kept by the executors, for loops that join it on these
    keys again and again: only the other side moves then. What an executor loses is laid out again
    from ``df``, which should be a short plan over written tables. The caller unpersists it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).persist(StorageLevel.MEMORY_AND_DISK)


class Workspace:
    """Written tables of one run; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage and survives lost executors."""
        path = f"{self.base}/{self.count:03d}-{label}"
        self.count += 1
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        back._meshwright_path = path
        return back

    def write_counted(self, df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
        """``write`` and the number of rows ``n``, with further sums over them, from one job."""
        seen = Observation()
        table = self.write(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]), label)
        return table, seen.get

    def together(self, parts: list[DataFrame]) -> DataFrame:
        """Written tables of one schema read as one: the plan does not grow with their number."""
        paths = [part._meshwright_path for part in parts]
        return self.spark.read.schema(parts[0].schema).parquet(*paths).select(*parts[0].columns)

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_meshwright_path", None)
            if path is None:
                continue
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files behind some paths: names, lengths and times of change."""
    seen = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in sorted(fs.globStatus(where) or [], key=str):
            files = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            seen += sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def latest_version(spark: SparkSession, folder: str) -> int:
    """The greatest n of the folders ``v=<n>`` that were written whole, -1 if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return -1
    found = [-1]
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return max(found)


def session(app: str = "meshwright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the test-suite and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
