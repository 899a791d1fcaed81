"""Incremental runs over newly landed responses: a file stream, one batch at a time merged into the tracker."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import company_core, normalize_title
from jobloom.operators import tracker
from jobloom.operators.offers import Order, Profile, dedupe_best, reject_cascade
from jobloom.sources.adapters import normalise

LANDING = "source string, company string, body string"


def run_new(spark: SparkSession, landed: str, checkpoint: str, merge: Callable[[DataFrame, int], None], schema: str = LANDING):
    """Hands each new landed file's rows to merge(rows, batch id) once, then stops. The checkpoint remembers what was
    handed on; merge must give the same result if a batch comes again."""
    stream = spark.readStream.schema(schema).parquet(landed)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: What orders the rows of a batch, whatever the order of its files.
SEQ = ("company", "title", "location", "link")


def tracker_rows(offers: DataFrame) -> DataFrame:
    """Offers as the tracker takes them: key (core of the company and plain title) and link beside the rest."""
    key = F.concat_ws("/", company_core(F.col("company")), normalize_title(F.col("title")))
    return offers.select(key.alias("key"), F.col("url").alias("link"), "company", "title", "location", "work_mode", "salary", "source")


def read_batch(landed: DataFrame, sources: Sequence[str], profile: Profile) -> DataFrame:
    """Offers of a batch of responses: normalised by source, one of each posting, those that the cascade keeps."""
    parts = [normalise(landed, s, profile=profile).withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    best = dedupe_best(every, profile, Order(("_rank", "url"))).drop("_rank", "first_seq", "core", "norm_title")
    return reject_cascade(best, profile, min_score=False).where("reject_reason IS NULL")


def run_incremental(
    spark: SparkSession, landed: str, path: str, backup: str, checkpoint: str, list_name: str, sources: Sequence[str], run_date: str, profile: Profile = Profile(), schema: str = LANDING
) -> list[str]:
    """Merges what has landed since the last run into a list of the tracker; the problems met. A batch and its number are committed together, so
    a batch that comes again (a stop between the commit and the checkpoint) changes nothing, and one that was not committed is merged in full. A
    batch covers the companies whose responses it holds: offers of others are not gone."""
    problems: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = tracker_rows(read_batch(batch, sources, profile))
            scope = batch.select("company").distinct()
            _, told = tracker.update(spark, path, backup, list_name, rows, run_date, list(SEQ), batch=(checkpoint, number), scope=scope)
            problems.extend(told)
        finally:
            batch.unpersist()

    run_new(spark, landed, checkpoint, merge, schema)
    return problems
