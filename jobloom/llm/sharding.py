"""Sharding by extendible hashing.

Rows have a hash of their id and text; a shard is a prefix of its bits. Starting from one bucket, a bucket
that holds more bytes than the limit is split on its next bit, others stay. The sizes of all prefixes come from
one histogram at a fine depth, rolled up bit by bit; only buckets still too large there are split further.

Edge cases: null texts and ids count as empty strings and have 0 bytes; rows equal in id and text
cannot be told apart by a hash, and a text larger than the limit cannot be split: such a bucket stays at the
greatest depth with ``over_limit``. Other columns are not carried. No rows: no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60
#: Depths looked at in one round beyond what the total needs.
AHEAD = 6
#: The directory is broadcast up to so many shards (about 64 bytes each).
BROADCAST_SHARDS = 500_000


def hashed(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the MD5 of id and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(empty(id_col), F.lit("\x1f"), empty(text_col))), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, n_bytes: one row a shard, from rows (h, n_bytes)."""
    rows = stored(rows.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes")), "hashes")
    total = rows.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return rows.select(F.lit(0).alias("depth"), F.col("h").alias("prefix"), "n_bytes").limit(0)
    leaves, top = None, 0
    fine = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    while True:
        level = rows.groupBy(F.shiftright("h", BITS - fine).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"))
        level = stored(level, "histogram")
        levels = {fine: level}
        for depth in range(fine - 1, top - 1, -1):
            levels[depth] = levels[depth + 1].groupBy(F.shiftright("prefix", 1).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"))
        every = None
        for depth, x in levels.items():
            x = x.select(F.lit(depth).alias("depth"), "prefix", "n_bytes")
            every = x if every is None else every.unionByName(x)
        every = stored(every, "levels")
        # a leaf fits and its parent does not; the first bucket has no parent
        parent = every.where(F.col("n_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        fits = every.where((F.col("n_bytes") <= limit) | (F.col("depth") == BITS))
        new = fits.join(parent, ["depth", "prefix"], "left_semi")
        if top == 0:
            new = new.unionByName(fits.where("depth = 0"))
        leaves = new if leaves is None else leaves.unionByName(new)
        left = level.where(F.col("n_bytes") > limit).select("prefix")
        if fine == BITS or left.isEmpty():
            return leaves
        rows = stored(rows.withColumn("prefix", F.shiftright("h", BITS - fine)).join(left, "prefix", "left_semi").drop("prefix"), "hashes")
        top, fine = fine, min(BITS, fine + 2 * AHEAD)


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, shard (its bits), depth, and over_limit, for each row."""
    rows = docs.select(F.col(id_col), hashed(id_col, text_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    leaves = stored(directory(rows.select("h", "n_bytes"), limit), "directory")
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most 61 numbers
    # a row looks up its prefix at each depth that has shards; just one of them is there
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths] or [F.lit(None).cast("struct<depth:int,prefix:bigint>")]))
    asked = rows.withColumn("_at", at).select(id_col, "n_bytes", "_at.depth", "_at.prefix")
    known = leaves.select("depth", "prefix", (F.col("n_bytes") > limit).alias("over_limit"))
    if leaves.count() <= BROADCAST_SHARDS:
        known = F.broadcast(known)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.bin("prefix"), BITS, "0"), BITS + 1 - F.col("depth"), F.col("depth")))
    return asked.join(known, ["depth", "prefix"]).select(id_col, "n_bytes", bits.alias("shard"), F.col("depth"), "over_limit")


#: Of the registered query, in bytes of text.
LIMIT = 1 << 20


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return shards(read(spark, sf_dir, "documents"), LIMIT)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
             ('0x' || md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, ''))[1:15])::BIGINT AS h FROM {{docs}}),
p AS (SELECT d.*, depth, h >> ({BITS} - depth) AS prefix FROM d, (SELECT unnest(range(0, {BITS + 1}))::INTEGER AS depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS total FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS first FROM s WHERE total <= {LIMIT} OR depth = {BITS})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, total > {LIMIT} AS over_limit
FROM f WHERE first = 1
"""
