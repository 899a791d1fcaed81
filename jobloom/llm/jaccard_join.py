"""Self-join of documents by the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

Shingles have a global order, rare first. Of two sets that are similar enough, the smaller one's first
(size - least overlap with anything larger + m) shingles and the larger one's first (size - least overlap + m)
share m, so only those are indexed. A document whose prefix looks costly lengthens it, and then m shared
shingles are asked for instead of one; a pair needs the smaller m of the two. Such candidates are verified on
their whole texts. The order comes from a sketch: how often each of a fixed number of slots is hit by the
shingles of all documents. It shapes costs only; results are exact whatever it says.

A shingle that many sets have in their prefix makes no pairs. Its sets are compared with their consensus: the
shingles that more than half of them have. Two sets whose distances from it add up to no more than similar sets may
differ in are similar for sure, and all such pairs are connected by links to the one set that is nearest for its size.
Any other two similar sets share one of the first shingles in which they differ from the consensus (by the same rule
of prefixes, applied to these differences), so those make the next groups, each of half the sets at most. Before that, all
links so far are drawn together, and only sets that are not connected yet are asked about: groups within one component
go, where few sets are outside the largest component these meet the others in pairs, and the other groups get a
consensus of their own. Nothing is lost, depth is logarithmic, and a group of near copies costs a row or so each.

Equal sets are one node before anything is grouped. Edge cases: null texts, and texts without words, are empty sets, linked
with nothing; a text of fewer words than a shingle is one shingle of all its words; very long texts are read whole,
one at a time; repeated rows and ids come back one for one; a null id is never a component's smallest; ids may be of any
type that has an order; an empty table gives no rows. Other columns are not carried by join() and are all kept, whatever
their names, by keep_one(). A node is a 64-bit digest of the set with its size; a text is told by 96 bits and its id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import free, release, ship, stored

SHINGLE, PERCENT = 3, 90
#: Logarithm of the slots of the sketch, and of the slots that are sent as one row.
SLOTS, BLOCK = 21, 16
#: A group with up to so many sets makes pairs at once; so does one with up to so many pairs a set.
SMALL = 16
MOST_MATCHES = 4
WORD = r"[^\x20\x09-\x0D]"


def shingles(texts: list, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in the order of their hashes."""
    w = hashing.Words(texts, lower=True)
    full = hashing.window_hashes(w.hash, size)
    short = [hashing.window_hashes(w.hash, k) for k in range(1, size)]
    out = []
    for first, n in zip(w.first[:-1], w.count, strict=True):
        if n >= size:
            out.append(np.unique(full[first : first + n - size + 1]))
        else:
            out.append(short[n - 1][first : first + 1] if n else full[:0])
    return out


def _node(s: np.ndarray) -> int:
    return int(np.add.reduce(hashing.mix(s ^ np.uint64(0x2545F4914F6CDD1D))).view(np.int64)) if len(s) else 0


def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b; both are sorted."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _similar(n_a: int, n_b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n_a + n_b - both)


def _probe(n: int, percent: int) -> int:
    """The prefix of a set in which any similar set that is not larger has a shingle of its index prefix."""
    return n - -(-percent * n // 100) + 1


def _index(n: int, percent: int) -> int:
    """The prefix of a set from which any similar set that is not smaller has a shingle in its probe prefix."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _most(n: int, percent: int) -> int:
    """In how many shingles a set of n and a similar one differ at most."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def sets(docs: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """id, t and u (hashes of the text), s and n (the node: digest and size of its set) for each row; and, in rows with a
    ``block``, ``counts``: how often the shingles of some rows hit each of its slots."""
    kind = docs.schema[id_col].dataType
    kinds = f"id {kind.simpleString()}, t bigint, u int, s bigint, n bigint, block int, counts binary"

    def run(batches):
        hits, id_kind = np.zeros(1 << SLOTS, np.int64), None
        names = ["id", "t", "u", "s", "n", "block", "counts"]
        for b in batches:
            id_kind = b.schema.field(0).type
            texts = b.column(1).to_pylist()
            s, n = [], []
            for i, j in hashing.chunks(texts):
                found = shingles(texts[i:j], size)
                for x in found:
                    s.append(_node(x))
                    n.append(len(x))
                np.add.at(hits, (np.concatenate(found) >> np.uint64(64 - SLOTS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(s), pa.int32()), pa.nulls(len(s), pa.binary())], names
            )
        if id_kind is not None:
            blocks = hits.reshape(-1, 1 << BLOCK)
            use = np.flatnonzero(blocks.any(axis=1))
            bare = lambda t: pa.nulls(len(use), t)
            counts = [np.minimum(blocks[k], 65535).astype("<u2").tobytes() for k in use]
            yield pa.RecordBatch.from_arrays(
                [bare(id_kind), bare(pa.int64()), bare(pa.int32()), bare(pa.int64()), bare(pa.int64()), pa.array(use, pa.int32()), pa.array(counts, pa.binary())], names
            )

    return docs.select(F.col(id_col), F.col(text), *_text_key(F.col(text))).mapInArrow(run, kinds)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.hash(text, F.lit(7))]


def sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all ``counts``, added up in two steps by block. Its size is fixed, whatever the data."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, f"<u{len(counts) >> BLOCK}").astype(np.uint64)
                held[block] = held[block] + more if block in held else more
        sums = [np.minimum(v, (1 << 32) - 1).astype("<u4").tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(sums, pa.binary())], ["block", "counts"])

    some = rows.where("block is not null").select("block", "counts", (F.spark_partition_id() % 8).alias("part"))
    half = some.repartition("block", "part").select("block", "counts").mapInArrow(add, "block int, counts binary")
    whole = half.repartition("block").mapInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros((1 << (SLOTS - BLOCK), 1 << BLOCK), np.int64)
    for block, counts in zip(whole["block"].to_pylist(), whole["counts"].to_pylist(), strict=True):
        out[block] += np.frombuffer(counts, "<u4")
    return np.minimum(out.reshape(-1), (1 << 31) - 1).astype(np.int32)


def _hits(counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    return counts[(x >> np.uint64(64 - SLOTS)).astype(np.int64)]


def prefixes(docs: DataFrame, size: int, percent: int, text: str, shared) -> DataFrame:
    """token, s, w: the prefix of each set, lengthened for m matches; w packs n, m and whether the token is in the index prefix.
    The order: by hits of the sketch, then by hash."""

    def run(batches):
        counts = shared.value
        load = counts.sum() / len(counts)
        noise = load + 2 * load**0.5  # what a slot has without any frequent shingle
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in hashing.chunks(texts):
                tokens, nodes, packed, seen = [], [], [], set()
                for x in shingles(texts[i:j], size):
                    n, s = len(x), _node(x)
                    if not n or (s, n) in seen:
                        continue
                    seen.add((s, n))
                    cost, length = _hits(counts, x), _probe(n, percent)
                    order = np.lexsort((x, cost))[: length + MOST_MATCHES - 1]
                    scanned = np.cumsum(np.maximum(cost[order] - noise, 0))
                    # entries of the index to read, and candidates to verify if so many matches are asked for
                    asked = np.arange(1, len(order) - length + 2)
                    m = int(asked[np.argmin(scanned[length - 2 + asked] * (1 + (8 + n / 16) / asked))])
                    order = order[: length + m - 1]
                    tokens.append(x[order])
                    nodes.append(np.full(len(order), s, np.int64))
                    packed.append((n * 16 + m * 2 + (np.arange(len(order)) < _index(n, percent) + m - 1)).astype(np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (tokens, nodes, packed)], ["token", "s", "w"])

    return docs.select(F.col(text)).mapInArrow(run, "token bigint, s bigint, w bigint")


PAIR = ["a_s", "a_n", "b_s", "b_n"]


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda p: texts.select(F.col("s").alias(f"{p}_s"), F.col("n").alias(f"{p}_n"), F.col("text").alias(f"{p}_text"))
    both = pairs.select(*PAIR).join(side("a"), ["a_s", "a_n"]).join(side("b"), ["b_s", "b_n"])
    return both.select(*PAIR, "a_text", "b_text")


def _each(b: pa.RecordBatch, size: int):
    """(place, set of a, set of b) of each pair of a batch; a b that comes again is not read again."""
    ta, tb = b.column(4).to_pylist(), b.column(5).to_pylist()
    last, held = None, None
    for i, j in hashing.chunks(ta, hashing.BLOCK // 2):
        for k, left in zip(range(i, j), shingles(ta[i:j], size), strict=True):
            if tb[k] != last:
                last, held = tb[k], shingles([tb[k]], size)[0]
            yield k, left, held


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs that are similar, by their whole texts."""

    def run(batches):
        for b in batches:
            yield b.select(PAIR).filter(pa.array([_similar(len(x), len(y), int(_inside(x, y).sum()), percent) for _, x, y in _each(b, size)], pa.bool_()))

    return _with_texts(pairs, texts).mapInArrow(run, ", ".join(f"{c} bigint" for c in PAIR))


def _of_groups(level: DataFrame, texts: DataFrame) -> DataFrame:
    return level.join(texts, ["s", "n"])


def consensus(level: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """g and ``common``: the shingles that more than half of the ``sets`` of each group have."""

    def run(batches):
        for b in batches:
            g, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            texts = b.column(2).to_pylist()
            for i, j in hashing.chunks(texts):
                found = shingles(texts[i:j], size)
                of = np.repeat(np.arange(i, j), [len(x) for x in found])
                token, group = np.concatenate(found).view(np.int64), g[of]
                order = np.lexsort((token, group))
                token, group, of = token[order], group[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))[: len(token)]
                times = np.diff(np.append(new, len(token)))
                yield pa.RecordBatch.from_arrays([pa.array(group[new]), pa.array(n[of[new]]), pa.array(token[new]), pa.array(times)], ["g", "sets", "token", "times"])

    counts = _of_groups(level, texts).select("g", "sets", "text").mapInArrow(run, "g bigint, sets bigint, token bigint, times bigint")
    most = counts.groupBy("g", "sets", "token").agg(F.sum("times").alias("times")).where("2 * times > sets")
    return most.groupBy("g").agg(F.sort_array(F.collect_list("token")).alias("common"))


def differences(level: DataFrame, texts: DataFrame, common: DataFrame, size: int, percent: int, shared) -> DataFrame:
    """g, s, n, x: in how many shingles each set differs from the consensus of its group; delta: the first of them in an order common to
    the group, its probe prefix."""

    def run(batches):
        counts = shared.value
        for b in batches:
            n, texts, held = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            starts, flat = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False).view(np.uint64)
            x, delta = [], []
            for i, j in hashing.chunks(texts, hashing.BLOCK // 2):
                for k, mine in zip(range(i, j), shingles(texts[i:j], size), strict=True):
                    theirs = np.sort(flat[starts[k] : starts[k + 1]])
                    own, lacked = mine[~_inside(mine, theirs)], theirs[~_inside(theirs, mine)]
                    d = np.concatenate([own, lacked])
                    # what few sets differ in comes first: what a set has, rare first, then what it lacks, frequent first
                    rank = np.concatenate([_hits(counts, own).astype(np.int64), (1 << 40) - _hits(counts, lacked).astype(np.int64)])
                    x.append(len(d))
                    delta.append(d[np.lexsort((d, rank))[: _most(n[k], percent) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(x, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], ["g", "s", "n", "x", "delta"]
            )

    both = _of_groups(level, texts).join(common, "g", "left").select("g", "s", "n", "text", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))
    return both.mapInArrow(run, "g bigint, s bigint, n bigint, x bigint, delta array<bigint>")


def _item(*cols: str) -> list[Column]:
    """Two sums over the rows of a key that tell which rows they are."""
    item = F.xxhash64(*cols)
    return [F.bit_xor(item).alias("_h"), F.bit_xor(F.xxhash64(item)).alias("_k")]


def _merged(rows: DataFrame, live: DataFrame, key: list[str], cols: list[str], facts: list[str]) -> DataFrame:
    """rows of the keys in ``live``. Keys with the same rows (as the shingles of one passage have) become one group g of that ``weight``."""
    same = [k for k in key if k != "token"]
    one = rows.join(live, key).groupBy("_h", "_k", *facts, *same, *cols).agg(F.count("*").alias("weight"))
    return one.withColumn("g", F.xxhash64("_h", "_k", *facts, *same)).drop("_h", "_k")


def _index_of(percent: int) -> Column:
    """The index prefix of a set that differs in x shingles from the consensus, for pairs of sets that are not both similar to the nearest
    set o for sure: similar ones share more than ``least`` of the shingles in which they differ from the consensus."""
    both, half = 2 * (100 + percent), _floor((100 - percent) * (F.col("n") + _floor(100 * F.col("n"), percent)), 100 + percent)
    star = (100 + percent) * (F.col("x") - F.col("o.x")) - (100 - percent) * (F.col("n") - F.col("o.n"))
    other = 2 * percent * F.col("x") - 200 * F.col("o.x")
    least = _floor(F.greatest(F.lit(0), F.when(F.col("star"), star).otherwise(other)), both)
    return F.least(F.col("x") - least, _floor(half, 2) + 1)


def _floor(a: Column, b: int) -> Column:
    """a / b without its fraction, for whole numbers from 0."""
    return (a - F.pmod(a, F.lit(b))) / b


def by_token(rows: DataFrame) -> DataFrame:
    """rows (token, s, w, i) in groups of tokens that two sets or more have, one of them by its index prefix; ``sets`` and ``index`` count
    them. Counts are made before rows meet them, so that no token is one task's."""
    counts = rows.groupBy("token").agg(F.count("*").alias("sets"), F.count_if("i").alias("index"), *_item("s", "w"))
    return _merged(rows, counts.where("sets >= 2 and index >= 1"), ["token"], ["s", "w", "i"], ["sets", "index"])


def by_difference(rows: DataFrame) -> DataFrame:
    """rows (of, token, s, n, x, i, label) in groups like those of by_token(), of sets from two components at least. ``apart`` and
    ``apart_index`` count those outside the largest, and ``near`` tells who is in it."""
    counts = rows.groupBy("of", "token", "label").agg(F.count("*").alias("c"), F.count_if("i").alias("ci"), *_item("s", "n"))
    largest = F.max(F.struct("c", "ci", "label"))
    every = counts.groupBy("of", "token").agg(F.sum("c").alias("sets"), F.sum("ci").alias("index"), F.bit_xor("_h").alias("_h"), F.bit_xor("_k").alias("_k"), largest.alias("t"))
    live = every.where("sets >= 2 and index >= 1 and t.c < sets").select(
        "of", "token", "sets", "index", "_h", "_k", (F.col("sets") - F.col("t.c")).alias("apart"), (F.col("index") - F.col("t.ci")).alias("apart_index"), F.col("t.label").alias("top")
    )
    r = _merged(rows, live, ["of", "token"], ["s", "n", "x", "i", "label"], ["sets", "index", "apart", "apart_index", "top"])
    return r.withColumn("near", F.col("label") == F.col("top")).drop("top")


def outermost(level: DataFrame) -> DataFrame:
    """Groups (g, s, n, sets) but those whose sets all are in another, larger one, as the later shingles of a passage are in the first: what is
    done with the larger one covers them. The candidate is the smallest of what is largest for each set."""
    size = F.struct("sets", "g")
    largest = level.groupBy("s", "n").agg(F.max(size).alias("top"))
    asked = level.join(largest, ["s", "n"]).groupBy("g").agg(F.min("top").alias("low")).select("g", F.col("low.g").alias("c")).where("g <> c")
    member = level.select(F.col("g").alias("c"), "s", "n")
    inside = level.join(asked, "g").join(member, ["c", "s", "n"]).groupBy("g", "sets").count().where("count = sets").select("g")
    return level.join(inside, "g", "left_anti")


def _met(a: DataFrame, b: DataFrame, keep: list[str], fits: Column, percent: int) -> DataFrame:
    """Pairs of rows of one group, as PAIR with the lower set first; sizes let them be similar."""
    side = lambda df, p: df.select("g", *[F.col(c).alias(f"{p}_{c}") for c in keep])
    x, y = F.col("a_n"), F.col("b_n")
    return side(a, "a").join(side(b, "b"), "g").where(fits & ((F.col("a_s") != F.col("b_s")) | (x != y)) & (100 * F.least(x, y) >= percent * F.greatest(x, y)))


def _ordered(pairs: DataFrame, *more: Column) -> DataFrame:
    low, high = F.struct(F.col("a_n").alias("n"), F.col("a_s").alias("s")), F.struct(F.col("b_n").alias("n"), F.col("b_s").alias("s"))
    p = pairs.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"), *more)
    names = [c for c in p.columns if c not in ("a", "b")]
    return p.select(F.col("a.s").alias("a_s"), F.col("a.n").alias("a_n"), F.col("b.s").alias("b_s"), F.col("b.n").alias("b_n"), *names)


def distinct_sets(known: DataFrame) -> DataFrame:
    """s, n, label (the least id) and one row of each set (its id and text hashes)."""
    first = F.min(F.struct("id", "t", "u"))
    return known.where("n > 0").groupBy("s", "n").agg(F.min("id").alias("label"), first.alias("one"))


def links(docs: DataFrame, raw: DataFrame, own: DataFrame, size: int, percent: int, id_col: str, text: str) -> DataFrame:
    """What components() gives for all links. raw: of sets(); own: of distinct_sets()."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(raw))
    p = stored(prefixes(docs, size, percent, text, shared).distinct(), "prefixes")
    release(spark)
    r = by_token(p.withColumn("i", F.col("w") % 2 == 1))
    rows = stored(r.withColumn("n", F.shiftright("w", 4)).withColumn("m", F.shiftright("w", 1) % 8).drop("w"), "rows")
    free(p)
    release(spark)

    nodes = stored(rows.select("s", "n").distinct().join(own, ["s", "n"]).select("s", "n", "one.*"), "nodes")
    one = nodes.select("s", "n", F.col("id").alias("_i"), F.col("t").alias("_t"), F.col("u").alias("_u"))
    # copies have ids of their own, so that they do not meet in one task
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *[c.alias(k) for k, c in zip(("t", "u"), _text_key(F.col(text)), strict=True)])
    found = keyed.join(one, (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u")) & F.col("id").eqNullSafe(F.col("_i")))
    texts = stored(found.groupBy("s", "n").agg(F.first("text").alias("text")), "texts")
    release(spark)

    few = (F.col("sets") <= SMALL) | (F.col("index") <= 2)
    small = rows.where(few)
    first = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & ((F.col("a_s") < F.col("b_s")) | ~F.col("b_i")))
    pairs = _met(small.where("i"), small, ["s", "n", "m", "i", "weight"], first, percent)
    pairs = _ordered(pairs, F.least("a_m", "b_m").alias("m"), F.col("a_weight").alias("weight"))
    asked = pairs.groupBy(*PAIR, "m").agg(F.sum("weight").alias("shared")).where("shared >= m")
    edges = [stored(verify(asked, texts, size, percent), "links")]

    level = stored(outermost(rows.where(~few).select("g", "s", "n", "sets")), "level")
    free(rows, nodes)
    while not level.isEmpty():
        common = stored(consensus(level, texts, size), "consensus")
        d = stored(differences(level, texts, common, size, percent, shared), "differences")
        free(level, common)
        # (100 + percent) * distance <= (100 - percent) * both sizes: y of two sets add up to 0 at most
        y = (100 + percent) * F.col("x") - (100 - percent) * F.col("n")
        nearest = d.groupBy("g").agg(F.min(F.struct(y.alias("y"), "x", "n", "s")).alias("o"))
        d_near = stored(d.join(nearest, "g").withColumn("star", y + F.col("o.y") <= 0), "nearest")
        star = d_near.where("star and (s <> o.s or n <> o.n)")
        edges.append(star.select(F.col("s").alias("a_s"), F.col("n").alias("a_n"), F.col("o.s").alias("b_s"), F.col("o.n").alias("b_n")))
        best = components(edges, own)
        edges = [best.select(F.col("s").alias("a_s"), F.col("n").alias("a_n"), F.col("best.s").alias("b_s"), F.col("best.n").alias("b_n")).where("a_s <> b_s or a_n <> b_n")]
        root = best.select("s", "n", F.struct(F.col("best.s").alias("s"), F.col("best.n").alias("n")).alias("root"))
        named = d_near.join(root, ["s", "n"], "left").withColumn("label", F.coalesce("root", F.struct("s", "n"))).drop("root")
        several = named.groupBy("g").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("g")
        each = named.join(several, "g", "left_semi").select(F.col("g").alias("of"), "s", "n", "x", "label", _index_of(percent).alias("index"), F.posexplode("delta").alias("at", "token"))
        r = stored(by_difference(each.withColumn("i", F.col("at") < F.col("index")).drop("at", "index")), "groups")
        free(d, d_near)
        release(spark)
        few = (F.col("sets") <= SMALL) | (F.col("apart_index") * F.col("sets") + F.col("apart") * F.col("index") <= SMALL * F.col("sets"))
        keep, some = ["s", "n", "x", "label"], r.where(few)
        alone = some.where("not near")
        pairs = _met(alone.where("i"), some, keep, F.col("a_x") <= F.col("b_x"), percent).unionByName(_met(alone, some.where("i"), keep, F.col("a_x") >= F.col("b_x"), percent))
        # two distances from the consensus differ by no more than two similar sets do
        fits = (100 + percent) * F.abs(F.col("a_x") - F.col("b_x")) <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
        asked = _ordered(pairs.where(fits & (F.col("a_label") != F.col("b_label")))).distinct()
        edges.append(stored(verify(asked, texts, size, percent), "links"))
        level = stored(outermost(r.where(~few).select("g", "s", "n", "sets")), "level")
        free(r)
        release(spark)
    best = components(edges, own)
    free(texts, level)
    return best


def components(edges: list[DataFrame], own: DataFrame) -> DataFrame:
    """s, n, best: (label is null, label, s, n) of the node with the least label of its component, for nodes with edges. Each round takes
    the least of the neighbours' and adds an edge to whoever had it, so that paths shorten fast."""
    spark = own.sparkSession
    every = reduce(DataFrame.unionByName, edges)
    ends = every.union(every.select("b_s", "b_n", "a_s", "a_n"))
    e = stored(ends.toDF("s", "n", "o_s", "o_n").distinct(), "edges")
    start = e.select("s", "n").distinct().join(own.select("s", "n", "label"), ["s", "n"])
    now = stored(start.select("s", "n", best_of(F.col("label")).alias("best")), "labels")
    while True:
        seen = e.join(now.select(F.col("s").alias("o_s"), F.col("n").alias("o_n"), F.col("best").alias("new")), ["o_s", "o_n"])
        least = seen.groupBy("s", "n").agg(F.min("new").alias("new"))
        step = now.join(least, ["s", "n"]).select("s", "n", F.least("best", "new").alias("best"), (F.col("new") < F.col("best")).alias("moved"))
        step = stored(step, "labels")
        free(now)
        if step.where("moved").isEmpty():
            free(e)
            return step.select("s", "n", "best")
        hop = step.where("moved").select("s", "n", F.col("best.s").alias("o_s"), F.col("best.n").alias("o_n"))
        both = hop.union(hop.select("o_s", "o_n", "s", "n").toDF("s", "n", "o_s", "o_n"))
        more = stored(e.union(both).where("s <> o_s or n <> o_n").distinct(), "edges")
        free(e)
        e, now = more, step
        now = step.drop("moved")
        now.stored_at = step.stored_at
        release(spark)


def best_of(label: Column) -> Column:
    return F.struct(label.isNull().alias("none"), label.alias("label"), F.col("s").alias("s"), F.col("n").alias("n"))


def _classes(docs: DataFrame, size: int, percent: int, id_col: str, text: str) -> DataFrame:
    """id, t, u, s, n and best (of components(); null for empty sets) for each row."""
    ship(docs.sparkSession)
    raw = stored(sets(docs, size, id_col, text), "sets")
    known = raw.where("block is null").drop("block", "counts")
    own = stored(distinct_sets(known), "distinct")
    moved = links(docs, raw, own, size, percent, id_col, text)
    best = own.join(moved, ["s", "n"], "left").select("s", "n", F.coalesce("best", best_of(F.col("label"))).alias("best"))
    return known.join(best, ["s", "n"], "left").select("id", "t", "u", "s", "n", "best")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) for each row."""
    return _classes(docs, size, percent, id_col, text).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("best.label", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, the one whose id (then text hash) is least, nulls last; rows without words all stay."""
    rows = _classes(docs, size, percent, id_col, text).where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t", "u")).alias("w")
    kept = rows.groupBy("best.s", "best.n").agg(first).select(F.col("w.id").alias("_i"), F.col("w.t").alias("_t"), F.col("w.u").alias("_u"))
    kept = stored(kept, "kept")
    # every row as a struct, so that its names cannot clash
    key = [F.col(id_col).alias("id"), *[c.alias(k) for k, c in zip(("t", "u"), _text_key(F.col(text)), strict=True)]]
    keyed = docs.select(F.struct("*").alias("row"), *key, F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("full"))
    same = F.col("id").eqNullSafe(F.col("_i")) & (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u"))
    full = keyed.where("full").join(kept, same, "left_semi")
    again = stored(docs.select(*key).join(kept, same, "left_semi").groupBy("id", "t", "u").count().where("count > 1").toDF("_i", "_t", "_u", "_c"), "again")
    if not again.isEmpty():  # rows that repeat another's id and text
        full = full.join(again, same, "left_anti").unionByName(full.join(again, same, "left_semi").dropDuplicates(["id", "t", "u"]))
    return full.unionByName(keyed.where("not full")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return join(read(spark, sf_dir, "documents"))
