"""The landed table: responses by source and day, so that a run reads the directories of its own sources and days only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a landed response; source and run_date are the table's partitions.
SCHEMA = "company string, key string, phrase_no int, seq int, body string, source string, run_date string"


def write_landing(responses: DataFrame, path: str) -> None:
    """Adds responses (source, run_date, body and others) to the table. Rows of one partition go to one task a shuffle partition, not to one file a task and partition."""
    responses.repartition("source", "run_date", "company").write.mode("append").partitionBy("source", "run_date").parquet(path)


def read_landing(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The table; with wanted (source, run_date; a row each), only their partitions: Spark evaluates the few wanted rows first and lists no other directory.
    They are sent to every task: shuffled by source and day, all that landed in a partition would go to one task."""
    found = spark.read.parquet(path).schema
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("source", "run_date") else f.dataType) for f in found])  # days stay texts, as they were landed
    table = spark.read.schema(texts).parquet(path)
    return table if wanted is None else table.join(F.broadcast(wanted.select("source", "run_date").distinct()), ["source", "run_date"], "left_semi")
