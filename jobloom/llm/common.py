"""Shared helpers of the training-data operators: columns, shared storage, shapes of input."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of plain words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, separators: str = SPACE) -> Column:
    """Non-empty parts of text between separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() also changes other letters)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def indexes(n: Column) -> Column:
    """0 .. n-1 as an array, empty if n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def prefix_sums(values: Column, block: int = 1000) -> Column:
    """Sums of all values before each place. In blocks, so that the cost stays near linear."""

    def within(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            part,
            start,
            lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
        )["out"]

    def whole(v: Column) -> Column:
        parts = F.transform(indexes(F.ceil(F.size(v) / block)), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        add = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
        return let(
            parts,
            lambda p: let(
                F.transform(p, add),
                lambda sums: F.flatten(F.transform(p, lambda part, b: within(part, add(F.slice(sums, F.lit(1), b))))),
            ),
        )

    return let(values.cast("array<int>"), whole)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of its own is made only where none is named and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: With this set, Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and the shuffles behind it go (from the
    first call on, for the whole session). free() removes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, None) != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, as --py-files would."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="jobloom-"), "jobloom.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(x for x in files if x.endswith(".py")):
                path = os.path.join(folder, f)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(to)
    _shipped[app] = True
