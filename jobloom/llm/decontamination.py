"""Benchmark decontamination: a broadcast set of normalised test n-grams against training token windows.

A window is ``size`` consecutive words of a benchmark item (the whole item if it is shorter). Training
documents are scanned once: a place is a candidate if all words of its window fall on marks of a bitmap that the words of
the benchmark set (of a fixed size, whatever the benchmark: it lets more through the more words there are); candidates are joined
with the set on the words themselves, so a hit is a verified hit. Spans or whole documents are then removed.

Edge cases: null texts have no words; items without words have no windows; the windows of items with a null id count for
hits, but give no id; equal items share their windows and each counts; repeated documents rows are each returned;
documents without words are never contaminated; very long texts are read whole, in one row; an empty benchmark hits nothing, an empty table gives an empty
one. verdicts() carries no other columns; remove_documents() keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_struct, indexes, let, lower_ascii, words

#: What is not a word, once A-Z is lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
#: The set is broadcast up to this many bytes of words; beyond, Spark joins by a shuffle, with the same rows.
BROADCAST_BYTES = 64 << 20
#: Bytes of the bitmap of benchmark words, and the marks in each: seven, so that each byte is a character.
BITMAP, MARKS = 1 << 18, 7


def tokens(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)  # lower() is much faster, and the same there
    return words(F.when(ascii_only, F.lower(t)).otherwise(lower_ascii(t)), BREAKS)


def test_windows(bench: DataFrame, size: int = SIZE) -> DataFrame:
    """win (array of words), its length, and the ids of the items that have it; one row a window."""
    items = bench.select(F.col("item_id").alias("_item"), tokens(F.col("text")).alias("_w"))
    length = F.least(F.lit(size), F.size("_w"))
    return (
        items.where(F.size("_w") > 0)
        .select(
            "_item",
            F.explode(F.transform(indexes(F.size("_w") - length + 1), lambda i: F.slice("_w", i + 1, length))).alias("win"),
        )
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("_item")).alias("items"))
    )


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITMAP * MARKS))


def bitmap(windows: DataFrame) -> bytes:
    """The bitmap of all words of the windows; the driver gets at most a number for each of its marks."""
    made = bytearray(BITMAP)
    for (slot,) in windows.select(F.explode("win").alias("w")).select(_slot(F.col("w"))).distinct().collect():
        made[slot // MARKS] |= 1 << slot % MARKS
    return bytes(made)


def _marked(words_: Column, marks: bytes) -> Column:
    """Of each word, whether the bitmap has its mark."""
    byte = lambda n: F.ascii(F.substring(F.lit(marks), F.floor(n / MARKS).cast("int") + 1, F.lit(1)).cast("string"))
    return F.transform(words_, lambda w: let(_slot(w), lambda n: F.call_function("shiftright", byte(n), (n % MARKS).cast("int")).bitwiseAND(1) == 1))


def scan(docs: DataFrame, bench: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, spans (array of start, end in words, of all hits), items (ids hit)."""
    windows = test_windows(bench, size)
    facts = windows.agg(
        F.sum(F.char_length(F.array_join("win", " "))).alias("bytes"),
        F.sort_array(F.collect_set(F.size("win"))).alias("lengths"),  # at most ``size`` numbers
    ).first()
    lengths, total = facts["lengths"] or [], facts["bytes"] or 0
    # equal rows have equal keys and are counted, so that each comes back
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_h"), F.hash(F.col(text_col), F.lit(1)).alias("_h2"),
        tokens(F.col(text_col)).alias("_w"),
    )
    least = min(lengths, default=size)
    keyed = keyed.withColumn("_in", _marked(F.col("_w"), bitmap(windows)))
    keyed = keyed.withColumn(
        "_starts",
        F.filter(
            indexes(F.size("_w") - (least - 1)),
            lambda i: F.get("_in", i) & F.get("_in", i + (least - 1)) & F.forall(F.slice("_in", i + 1, F.lit(least)), lambda x: x),
        ),
    )

    def places(n: int) -> Column:
        return F.transform(
            F.filter("_starts", lambda i: i + n <= F.size("_w")),
            lambda i: as_struct(start=i, end=i + n, win=F.slice("_w", i + 1, F.lit(n))),
        )

    candidates = [places(n) for n in lengths]
    none = F.array().cast("array<struct<start:int,end:int,win:array<string>>>")
    found = keyed.select(
        "_id", "_h", "_h2", F.size("_w").cast("long").alias("n_words"),
        F.posexplode_outer(F.concat(*candidates) if candidates else none).alias("_pos", "_c"),
    ).select("_id", "_h", "_h2", "n_words", "_pos", F.col("_c.start").alias("_start"), F.col("_c.end").alias("_end"), F.col("_c.win").alias("_win"))
    right = windows.select(F.col("win").alias("_win"), "items")
    hits = found.join(F.broadcast(right) if total <= BROADCAST_BYTES else right, "_win", "left")
    span = F.when(F.col("items").isNotNull(), as_struct(start=F.col("_start"), end=F.col("_end")))
    return (
        hits.groupBy("_id", "_h", "_h2", "n_words")
        .agg(
            F.sum(F.when(F.coalesce(F.col("_pos"), F.lit(0)) == 0, 1).otherwise(0)).alias("_rows"),
            F.sort_array(F.collect_set(span)).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_row"))
        .select(F.col("_id").alias(id_col), "_h", "_h2", "n_words", "spans", "items")
    )


def covered(spans: Column) -> Column:
    """How many words sorted spans cover."""
    start = as_struct(end=F.lit(0), n=F.lit(0).cast("long"))
    step = lambda a, s: as_struct(
        end=F.greatest(a["end"], s["end"]),
        n=a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"])),
    )
    return F.aggregate(spans, start, step)["n"]


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A hit, and hits over a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def verdicts(docs: DataFrame, bench: DataFrame, size: int = SIZE) -> DataFrame:
    """scan() with n_hit and contaminated."""
    return scan(docs, bench, size).withColumn("n_hit", covered(F.col("spans"))).withColumn(
        "contaminated", contaminated(F.col("n_hit"), F.col("n_words"))
    )


def remove_documents(docs: DataFrame, bench: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without contaminated documents; all columns and clean rows stay."""
    bad = verdicts(docs, bench, size).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("_h").alias("__h"), F.col("_h2").alias("__h2")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__i"), F.xxhash64("text").alias("__k"), F.hash(F.col("text"), F.lit(1)).alias("__k2"))
    same = F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__h")) & (F.col("__k2") == F.col("__h2"))
    return rows.join(bad, same, "left_anti").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def remove_spans(docs: DataFrame, bench: DataFrame, size: int = SIZE) -> DataFrame:
    """id and the normalised words that no hit covers, joined by one space."""
    hit = verdicts(docs, bench, size).select(F.col("doc_id").alias("_i"), "_h", "_h2", "spans").distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_k"), F.hash(F.col("text"), F.lit(1)).alias("_k2"), tokens(F.col("text")).alias("_w"))
    joined = keyed.join(hit, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_h")) & (F.col("_k2") == F.col("_h2")))
    free = F.filter("_w", lambda x, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    return joined.select("doc_id", F.array_join(free, " ").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    v = verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return v.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {docs}),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
plc AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, i, plc.n, item_id FROM plc JOIN win ON plc.s = win.s AND plc.n = win.n),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(x) AS n, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov ON cov.rid = d.rid LEFT JOIN its ON its.rid = d.rid
"""
