"""A trie of conversations by common first turns, from intervals of a sorted list.

Each conversation becomes the digests of its turns (16 bytes of SHA-256 over role and text) in a row, and
equal ones become one row with their number. The rows are sorted over the whole table and cut into blocks. A block
holds the lengths of the prefixes that neighbours share (LCPs) and a sparse table of their minima over runs of 2^j. Every
prefix of every row is a candidate: it looks for its left and its right extent by binary search, independently of
all others and without a stack; the candidate whose row is its left extent stands for the node. What a node adds up
(members, leaves, saved code points) comes from prefix sums over its interval. Prefixes that reach over an edge
of their block are pieces; those of one digest are added up by a grouping.

Edge cases: a null role or text counts as empty; rows without a conversation id are left out; turns are ordered by turn,
null first, those of equal number by role, then by digest; repeated rows are repeated turns; an empty table has no
nodes; other columns are not carried. The turns of one conversation meet in one row, as about 30 bytes each. Members of a
node are never gathered: their ids are joined in runs of 4096 numbers, and the runs are hashed one after another.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, let, read, stored

#: Bytes of a turn's digest; bits of the ids in one run; distinct conversations in a block (about).
WIDTH, RUN, BLOCK = 16, 12, 20_000
#: What holds of no conversation: the digest of no ids.
NONE = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ``turns`` in order, as structs of digest (hex) and n (code points of the text)."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = turns["turn"]
    item = F.struct(turn.isNotNull().alias("a"), turn.alias("b"), role.alias("c"), digest.alias("d"), F.length(text).alias("n"))
    rows = turns.where(turns["conv_id"].isNotNull()).select(turns["conv_id"].cast("long").alias("conv_id"), item.alias("item"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return grouped.select("conv_id", F.transform("items", lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def shared_starts(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % every, h = crc32(c) % most."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    made = let(h, lambda n: F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), n), F.slice(F.col("turns"), n + 1, F.greatest(F.size("turns"), F.lit(1)))))
    return convs.withColumn("base", base).join(heads, "base", "left").select("conv_id", made.alias("turns"))


def _runs(convs: DataFrame) -> DataFrame:
    """Ids of equal conversations, joined in runs of 2^RUN numbers."""
    part: Column = F.shiftright("conv_id", RUN)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    rows = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"), part.alias("part"))
    ids = F.sort_array(F.collect_list("conv_id"))
    return rows.groupBy("key", "sizes", "part").agg(ids.alias("ids")).select("key", "sizes", "part", F.col("ids")[0].alias("low"), F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_EQUAL = "key binary, sizes array<int>, n bigint, low bigint, sha string"


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of key and part to one row a key; ids go into the digest run by run."""
    schema = pa.schema([("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("low", pa.int64()), ("sha", pa.string())])
    now, digest, done = None, None, []

    def closed():
        return dict(zip(schema.names, [*now, digest.hexdigest()], strict=True))

    for b in batches:
        for key, sizes, low, n, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if now is not None and now[0] == key:
                digest.update(b"," + ids.encode())
                now[2] += n
                continue
            if now is not None:
                done.append(closed())
            now, digest = [key, sizes, n, low], hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def _common(a: bytes | None, b: bytes | None) -> int:
    """How many turns two keys share; -1 if one is absent."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k, np.uint8, n * WIDTH).reshape(n, WIDTH) for k in (a, b))
    return int(np.append((x != y).any(axis=1), True).argmax())


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        block, prior, first, last, later = (c.to_pylist() for c in b.columns)
        before = [_common(x, y) for x, y in zip(prior, first, strict=True)]
        after = [_common(x, y) for x, y in zip(last, later, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["block", "before", "after"])


class RangeMin:
    """Minima over any run of a list: a table of the minima of all runs of 2^j."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of low..high (both counted), which must not be empty."""
        out, j = np.empty(len(low), self.levels[0].dtype), np.log2(high - low + 1).astype(int)
        for level in np.unique(j):
            k = np.flatnonzero(j == level)
            out[k] = np.minimum(self.levels[level][low[k]], self.levels[level][high[k] + 1 - (1 << level)])
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest i <= at so that all values at i+1..at are at least ``least``."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << j)
            ok = start >= 0
            ok[ok] = self.levels[j][start[ok] + 1] >= least[ok]
            at[ok] = start[ok]
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest i >= at so that all values at at+1..i are at least ``least``."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            ok = at + 1 < len(self.levels[j])
            ok[ok] = self.levels[j][at[ok] + 1] >= least[ok]
            at[ok] += 1 << j
        return at


def _lcps(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the one before it (0 for the first)."""
    most = np.minimum(size[1:], size[:-1])
    where = np.repeat(np.arange(len(most)), most)
    at = np.arange(len(where)) - np.repeat(np.cumsum(most) - most, most)
    differ = (flat[start[1:][where] + at] != flat[start[:-1][where] + at]).any(axis=1)
    out = np.concatenate([[0], most])
    np.minimum.at(out, where[differ] + 1, at[differ])
    return out


_NODE = "block int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, sha string, digest binary, parent_digest binary"


def _nodes(table: pa.Table) -> pa.Table:
    """The nodes of a block. A node with a digest is a piece, whose other pieces are in other blocks."""
    table = table.take(pc.sort_indices(table["key"])).combine_chunks()
    key, sizes = table["key"].combine_chunks(), table["sizes"].combine_chunks()
    n = len(key)
    ends = np.frombuffer(key.buffers()[1], np.int32)[key.offset : key.offset + n + 1] // WIDTH
    flat = np.frombuffer(key.buffers()[2] or b"", np.uint64).reshape(-1, 2)
    start, size = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
    points = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())]).astype(np.int64)
    base = start - start[0]  # the lists of sizes begin at 0
    count, low = (table[c].to_numpy().astype(np.int64) for c in ("n", "low"))
    before, after = int(table["before"][0].as_py()), int(table["after"][0].as_py())

    lcp = _lcps(flat, start, size)
    lcp[0] = before
    index = RangeMin(lcp)
    row = np.repeat(np.arange(n), size + 1)
    first = np.cumsum(size + 1) - (size + 1)
    depth = np.arange(len(row)) - first[row]
    left, right = index.left(row, depth), index.right(row, depth)

    total = points[base + size] - points[base]
    upto = lambda i, d: points[base[i] + d] - points[base[i]]  # noqa: E731  code points of the first d turns
    fresh = total - upto(np.arange(n), np.maximum(lcp, 0))  # of nodes that no earlier row has
    sums = lambda v: np.concatenate([[0], np.cumsum(v)])
    members, text, new, leaf = sums(count), sums(count * total), sums(fresh), sums(np.append(lcp[1:], after) < size)
    children = np.zeros(len(row), np.int64)
    branch = np.flatnonzero(lcp >= 0)  # the child that begins at this row hangs on the prefix shared with the last
    np.add.at(children, first[left[first[branch] + lcp[branch]]] + lcp[branch], 1)

    k = np.flatnonzero(left == row)  # each node once: at its first row
    i, d, r = row[k], depth[k], right[k]
    from_before, to_after = (i == 0) & (d <= before), (r == n - 1) & (d <= after)
    children = children[k] + np.where(~from_before & (size[i] > d), 1, 0)
    over = lambda s: s[r + 1] - s[i]
    above = upto(i, np.maximum(d - 1, 0))
    first_new = np.where(from_before, fresh[i], total[i] - above)
    saved = over(text) - over(members) * above - (over(new) - fresh[i] + first_new)
    lowest = RangeMin(low).over(i, r)
    is_open = from_before | to_after
    place = np.full(len(row), -1)
    place[k] = np.arange(len(k))
    up = place[first[left[first[i] + np.maximum(d - 1, 0)]] + np.maximum(d - 1, 0)]

    digests: list[bytes | None] = [None] * len(k)
    for r0 in {0, n - 1}:  # only prefixes of the first and the last row reach over an edge
        running, raw = hashlib.sha256(), key[r0].as_py()
        for at in range(int(size[r0]) + 1):
            if at:
                running.update(raw[(at - 1) * WIDTH : at * WIDTH])
            node = place[first[left[first[r0] + at]] + at]
            if is_open[node]:
                digests[node] = running.digest()[:WIDTH]
    open_parent = is_open[up] & (d > 0)
    parent = pa.array(lowest[up], mask=open_parent | (d == 0))
    shas = pc.if_else(pa.array(size[i] == d), table["sha"].take(pa.array(i)), pa.scalar(None, pa.string()))
    arrays = [
        pa.array(np.full(len(k), table["block"][0].as_py(), np.int32)), pa.array(lowest), pa.array(d), parent, pa.array(over(members)),
        pa.array(children), pa.array(over(leaf)), pa.array(saved), shas, pa.array(digests, pa.binary()),
        pa.array([digests[u] if o else None for u, o in zip(up.tolist(), open_parent.tolist(), strict=True)], pa.binary()),
    ]
    return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in _NODE.split(", ")])


def trie(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a node of the trie of ``convs`` (conv_id, turns): see the contract of query()."""
    runs = _runs(convs).repartition("key").sortWithinPartitions("key", "part")
    rows = stored(runs.mapInArrow(_equal, _EQUAL), "trie-rows")
    blocks = max(1, math.ceil(rows.count() / block))
    ordered = stored(rows.repartitionByRange(blocks, "key").sortWithinPartitions("key").withColumn("block", F.spark_partition_id()), "trie-sorted")
    ends = ordered.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    by = Window.orderBy("block")  # a row a block
    edges = ends.select("block", F.lag("last").over(by).alias("prior"), "first", "last", F.lead("first").over(by).alias("later"))
    edges = edges.mapInArrow(_edges, "block int, before int, after int")
    nodes = stored(ordered.join(edges, "block").groupBy("block").applyInArrow(_nodes, _NODE), "trie-nodes")
    free(rows, ordered)

    pieces = nodes.where("digest IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    facts = [F.min("conv_id").alias("conv_id"), F.max("sha").alias("sha"), F.max("parent_digest").alias("parent_digest")]
    whole = pieces.groupBy("digest", "depth").agg(*sums, *facts)
    lows = whole.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("found"))
    near = pieces.select("block", "digest").distinct().join(whole.select("digest", F.col("conv_id").alias("found")), "digest").withColumnRenamed("digest", "parent_digest")
    inside = nodes.where("digest IS NULL").join(near, ["block", "parent_digest"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    across = whole.join(lows, "parent_digest", "left").withColumn("parent_conv_id", F.col("found"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NONE)).alias("ends_sha256")]
    return inside.select(*columns).unionByName(across.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations whose first turns are shared with those of their hundred."""
    return trie(shared_starts(conversations(read(spark, sf_dir, "conversations"))))


#: CRC-32 of a list of bytes ``{bytes}``, with ``t``, its table of 256 values.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"
CRC = "xor(4294967295, list_reduce({bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"
BYTES = "list_transform(range(octet_length(encode({text})) ), lambda i: ('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::BIGINT)"

SQL = f"""
WITH tab AS ({CRC_TABLE}),
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM {{conversations}} WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT o.conv_id, o.turns, {CRC.format(bytes=BYTES.format(text="conv_id::VARCHAR"))} % 6 AS h FROM own AS o, tab),
made AS (SELECT h.conv_id AS c, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN own AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
seen AS (SELECT c, d, turns[1:d] AS p, len(turns) = d AS here FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM made)),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE here), '')) AS ends FROM seen GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * length(n.p[n.d].x) END AS s FROM node AS n LEFT JOIN kids AS c ON c.d = n.d AND c.p = n.p),
sub AS (SELECT d, p, count(*) FILTER (WHERE k = 0) AS leaves, sum(s)::BIGINT AS saved FROM (SELECT unnest(range(v.d + 1)) AS d, v.p[1:unnest(range(v.d + 1))] AS p, k, s FROM full_node AS v) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, n.k AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, n.ends AS ends_sha256
FROM full_node AS n JOIN sub ON sub.d = n.d AND sub.p = n.p LEFT JOIN node AS up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
