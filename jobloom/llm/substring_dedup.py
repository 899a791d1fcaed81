"""Removal of long passages that occur more than once, found by difference-cover anchors.

A cover of a period p is a set of residues such that any two places have a common shift under p after
which both fall on the set. So if only windows that start at cover places are hashed, two equal
passages of L words still share one whose width is L - p + 1. Anchors that occur once are done with.
The others extend: every window of L words around one is compared by a 96-bit hash, and words in
windows that occur twice or more go. No pairs are made: both steps count equal hashes.

A batch counts its own equal hashes first and sends each only once, so that a passage that a third of all
documents share is a row for each batch, not for each document.

Edge cases: a null text has no words; equal texts (repeated rows too) are copies of one another, so all
words of those with L or more go; texts shorter than L keep all. Rows come back one for one, with the
id they had, null or not; an empty table gives none. Very long texts are one row's memory, about 40 times
a megabyte of them at a time. Other columns are not carried, so names cannot clash. A 96-bit key stands for each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import partitions, release, stored

WINDOW = 35
#: Perfect difference sets by period.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}


def plan(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor width) for a window: the widest period up to six tenths of it."""
    period = max((p for p in COVERS if p <= max(3, 0.6 * window)), default=3)
    if window < 3:
        raise ValueError("a window needs three words or more")
    return period, COVERS[period], window - period + 1


def _keys(text: str):
    t = F.col(text)
    return F.xxhash64(t).alias("t1"), F.hash(t, F.lit(7)).alias("t2")


def _once(keys: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct key, how often each place's key occurs, 2 at most)."""
    both = keys if others is None else hashing.mix(keys ^ hashing.mix(others))
    _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return first, np.minimum(count, 2)[inverse]


def anchors(docs: DataFrame, window: int, text: str) -> DataFrame:
    """k (hash of an anchor), t1 (its text), pm (4 * its place + how often the batch has it, 2 at most).
    A further occurrence in the batch comes with a key of its own: that it repeats is known."""
    period, cover, width = plan(window)
    on = np.isin(np.arange(period), cover)

    def run(batches):
        for b in batches:
            texts, keys = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for i, j in hashing.chunks(texts):
                w = hashing.Words(texts[i:j])
                h = hashing.window_hashes(w.hash, width)
                n = len(h)
                use = np.flatnonzero(on[w.at[:n] % period] & (w.at[:n] + width <= w.count[w.doc[:n]]) & (w.count[w.doc[:n]] >= window))
                if not len(use):
                    continue
                h, doc, at = h[use], w.doc[use], w.at[use]
                first, times = _once(h)
                again = np.ones(len(h), bool)
                again[first] = False
                t1 = keys[i:j][doc]
                k = np.where(again, hashing.mix(t1.view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(t1), pa.array(at * 4 + times)], ["k", "t1", "pm"])

    return docs.select(F.col(text), _keys(text)[0]).mapInArrow(run, "k bigint, t1 bigint, pm bigint")


def repeated_anchors(docs: DataFrame, window: int, text: str) -> DataFrame:
    """t1 and the places of its anchors that occur anywhere else."""
    a = anchors(docs, window, text)
    hot = a.withColumn("n", F.sum(F.col("pm") % 4).over(Window.partitionBy("k"))).where("n >= 2")
    return hot.groupBy("t1").agg(F.sort_array(F.collect_set((F.col("pm") / 4).cast("int"))).alias("places"))


def windows(docs: DataFrame, hot: DataFrame, window: int, text: str) -> DataFrame:
    """A row for each window around a repeated anchor: k and c (its hashes), t1 and t2 (its text), pm as in anchors()."""
    _, _, width = plan(window)
    near = window - width

    def run(batches):
        for b in batches:
            texts, places = b.column(0).to_pylist(), b.column(3)
            t1, t2 = (b.column(x).to_numpy(zero_copy_only=False) for x in (1, 2))
            offsets, flat = places.offsets.to_numpy(), places.values.to_numpy(zero_copy_only=False)
            # copies lie side by side: the first stands for all
            same = np.concatenate([[False], (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1])])
            copied = same | np.concatenate([same[1:], [False]])
            one = np.flatnonzero(~same)
            kept = [texts[x] for x in one]
            for i, j in hashing.chunks(kept):
                w = hashing.Words(kept[i:j])
                n = len(w.hash) - window + 1
                if n <= 0:
                    continue
                rows = one[i:j]
                spots = [flat[offsets[r] : offsets[r + 1]] + f for r, f in zip(rows, w.first[:-1], strict=True)]
                spots = np.concatenate(spots)
                step = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(step, np.maximum(spots - near, w.first[:-1][w.doc[spots]]), 1)
                np.add.at(step, spots + 1, -1)
                ok = (np.cumsum(step[:n]) > 0) & (w.at[:n] + window <= w.count[w.doc[:n]])
                use = np.flatnonzero(ok)
                if not len(use):
                    continue
                k, c = hashing.window_hashes(w.hash, window)[use], hashing.window_hashes(w.hash, window, True)[use]
                doc, at = w.doc[use], w.at[use]
                first, times = _once(k, c)
                times = np.maximum(times, 1 + copied[rows][doc])
                again = np.ones(len(k), bool)
                again[first] = False
                x1, x2 = t1[rows][doc], t2[rows][doc]
                k = np.where(again, hashing.mix(x1.view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array((c >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(x1), pa.array(x2), pa.array(at * 4 + times)],
                    ["k", "c", "t1", "t2", "pm"],
                )

    texts = docs.select(F.col(text).alias("text"), *_keys(text)).where(F.col("text").isNotNull())
    asked = texts.join(hot.select(F.col("t1").alias("h1"), "places"), F.col("t1") == F.col("h1")).select("text", "t1", "t2", "places")
    return asked.mapInArrow(run, "k bigint, c int, t1 bigint, t2 int, pm bigint")


def repeated_windows(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """t1, t2 (the text) and the sorted places where a window starts that also starts anywhere else."""
    spark = docs.sparkSession
    hot = stored(repeated_anchors(docs, window, text), "anchors")
    release(spark)
    w = windows(docs, hot, window, text)
    twice = w.withColumn("n", F.sum(F.col("pm") % 4).over(Window.partitionBy("k", "c"))).where("n >= 2")
    found = stored(twice.groupBy("t1", "t2").agg(F.sort_array(F.collect_set((F.col("pm") / 4).cast("int"))).alias("starts")), "windows")
    release(spark)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept: the words that stay, joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, starts = b.column(1).to_pylist(), b.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for t, s in zip(texts, starts, strict=True):
                w = (t or "").encode().split()
                n_words.append(len(w))
                if s is not None and len(s):
                    step = np.zeros(len(w) + 1, np.int32)
                    np.add.at(step, np.array(s), 1)
                    np.add.at(step, np.array(s) + window, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    w = [w[i] for i in np.flatnonzero(~gone)]
                n_removed.append(n_words[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"]
            )

    found = repeated_windows(docs, window, text).select(F.col("t1").alias("f1"), F.col("t2").alias("f2"), "starts")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *_keys(text))
    joined = keyed.join(found, (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")), "left").select("id", "text", "starts")
    return joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    r = remove_repeats(read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
g AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n >= 2),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM rep),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.rid, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS s FROM word LEFT JOIN gone ON gone.rid = word.rid AND gone.p = word.p
         WHERE gone.p IS NULL GROUP BY word.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid
"""
