"""Language-model scores from a probabilistic suffix tree over words.

Contexts are the last one to three words. A context is a candidate if it occurs often enough; it is kept if its
next-word distribution diverges enough from that of its suffix, or if a longer kept context needs it. Next words
are explicit where context and word occur together often enough; each kept context mixes its discounted counts
with its suffix's distribution, down to the smoothed word frequencies. A text is scored from the longest kept
suffix at each place.

A next word that a context has, its suffix has too. So the logarithm of a token's probability is a sum of parts that need not
know of each other: one of its word, and for each kept context before it one of the context (its suffix's weight) and
one of the next word (what that adds to the suffix's part). A text's score adds up the parts of all its keys.

All counts cover every training text, and the tree grows with them: least counts are fixed numbers, and
words, contexts and next words are a stored table of keys and parts. A fixed number of the most frequent is
broadcast as a cache; what a text needs beyond that is joined, a row a key. A bitmap of fixed size tells most of what is in no table;
what it cannot tell is joined as well, so it changes no result.

Edge cases: a null text is one end token; a null id counts as an empty string when the fold is drawn; rows
and ids may repeat and each row is scored; other columns are not carried. An empty table gives no rows; a very
long text is a block by itself. Words and contexts are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import free, partitions, release, ship, stored

#: A context with its next word is explicit from this count on.
JOINT_LEAST = 2
#: A context is a candidate from this count on.
CONTEXT_LEAST = 8
DEPTH = 3
DISCOUNT = 0.5
#: Nats an occurrence that a context must gain over its suffix, and half a logarithm of the tokens in all.
DIVERGENCE = 0.01
PRIOR = 0.1
#: Stands for the end token among word hashes.
END = np.uint64(0x5EED00000000E0D1)
#: Tokens that are counted at once, and rows of counts that are summed before they leave Python.
GATHER, MERGE = 1 << 21, 1 << 22
#: The first bits of a key that name its bucket. Counts travel as one row a bucket, a bucket's counts are added up at once.
BUCKETS = 13
#: The most words, and contexts and next words of a depth, in a tree; score() has so many times ``SHARE`` in its cache, of all kinds.
CACHED = 1 << 20
SHARE = 5
#: Keys that a task of the join holds.
HELD = 1 << 20
#: Bits of a bitmap for each key, and the logarithm of the most bits.
BITS_A_KEY, BITS = 32, 28
#: A class of counts that no row reaches: 16 times the logarithm of a 64-bit number is less.
NOTHING = 1 << 11
#: Tells keys of contexts from those of next words (which are contexts one longer), and both from words.
_CONTEXT, _NEXT = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def tokens(texts: list | pa.Array):
    """(word hashes with an end after each text, the text of each token, how many each text has)."""
    w = hashing.Words(texts, lower=True)
    count = w.count + 1
    out = np.empty(count.sum(), np.uint64)
    ends = np.cumsum(count) - 1
    here = np.ones(len(out), bool)
    here[ends] = False
    out[ends], out[here] = END, w.hash
    return out, np.repeat(np.arange(len(texts)), count), count


def join_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context and a word after it, which is that of the context one longer."""
    return hashing.mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def before(hashes: np.ndarray, doc: np.ndarray, depth: int = DEPTH):
    """For each depth: the context before each token, whether it has one, and the hash of both."""
    last = hashes
    for k in range(1, depth + 1):
        context, ok = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
        context[1:] = last[:-1]
        ok[k:] = doc[k:] == doc[:-k]
        last = join_key(context, hashes)
        yield context, ok, last


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for the first bits of each ``key``: keys without one are not in the table. Its size goes with the table's, up to a bound."""
    size = min(BITS, max(6, (BITS_A_KEY * keys.count()).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - size)
    word = F.shiftright(slot, 6).alias("at")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int))")
    found = keys.select(word, bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def following(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The word of a context's key: join_key() the other way round."""
    return hashing.unmix(key) - context * np.uint64(0x9E3779B97F4A7C15)


def _summed(context: np.ndarray, key: np.ndarray, n: np.ndarray | None = None) -> tuple:
    """context, key and how often each key comes (or the sum of its n), by key."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    sums = np.diff(first, append=len(key)) if n is None else np.add.reduceat(n[order], first) if len(key) else n
    return context[order[first]], key[first], sums


def _counted(docs: DataFrame, make, text: str) -> DataFrame:
    """ctx, word, key, n: how often make(tokens), contexts and keys, gives each key, from JOINT_LEAST on (all of those under END).
    Summed in Python by task, then by buckets of keys that Spark has dealt and sorted; a row has the counts of a bucket from a task."""
    shift = np.uint64(64 - BUCKETS)

    def count(batches):
        held, size, sums = [], 0, []
        joined = lambda rows: [np.concatenate(c) for c in zip(*rows, strict=True)]

        def table(*columns):
            bucket = (columns[1] >> shift).astype(np.int32)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            offsets = pa.py_buffer((np.append(first, len(bucket)) * 8).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(c))]) for c in columns]
            rows = pa.RecordBatch.from_arrays([pa.array(bucket[first]), *packed], ["bucket", "ctx", "key", "n"])
            return [rows.slice(i, 1024) for i in range(0, len(first), 1024)]

        for b in batches:
            for i, j in hashing.slices(b.column(0)):
                held.append(make(*tokens(b.column(0)[i:j])))
                size += len(held[-1][0])
                if size >= GATHER:
                    sums.append(_summed(*joined(held)))
                    held, size = [], 0
                    if sum(len(x[0]) for x in sums) >= MERGE:
                        sums = [_summed(*joined(sums))]
                        if len(sums[0][0]) >= MERGE // 2:
                            yield from table(*sums.pop())
        if held:
            sums.append(_summed(*joined(held)))
        if sums:
            yield from table(*_summed(*joined(sums)))

    def add(batches):
        def table(context, key, n):
            on = (n >= JOINT_LEAST) | (context == END)
            context, key, n = context[on], key[on], n[on]
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (context, following(context, key), key)), pa.array(n)], ["ctx", "word", "key", "n"])

        def values(column, kind):
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
            return np.frombuffer(column.buffers()[2], kind)[offsets[0] : offsets[-1]]

        kinds = np.uint64, np.uint64, np.int64
        last = [np.zeros(0, k) for k in kinds]
        for b in batches:
            if b.num_rows:
                rows = [np.concatenate([x, values(c, k)]) for x, c, k in zip(last, b.columns[1:], kinds, strict=True)]
                bucket = rows[1] >> shift
                cut = np.flatnonzero(bucket != bucket[-1])
                cut = cut[-1] + 1 if len(cut) else 0  # the last bucket may go on
                yield table(*_summed(*(x[:cut] for x in rows)))
                last = [x[cut:] for x in rows]
        yield table(*_summed(*last))

    rows = docs.select(F.col(text)).mapInArrow(count, "bucket int, ctx binary, key binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(add, "ctx bigint, word bigint, key bigint, n bigint")


def _keyed(rows: DataFrame, a: str, b: str, name: str, tag: np.uint64 = np.uint64(0)) -> DataFrame:
    """rows with the hash of two columns."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), f"{name} bigint"])

    def run(batches):
        for t in batches:
            view = lambda c, t=t: t.column(t.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(np.uint64)
            key = join_key(view(a), view(b)) ^ tag
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(key.view(np.int64))], [*t.schema.names, name])

    return rows.mapInArrow(run, schema)


class Index:
    """Finds keys in a sorted table of hashes by their first bits: a bucket holds about one of them. Made anew where it arrives, so it is never sent."""

    def __init__(self, hashes: np.ndarray):
        bits = max(1, len(hashes).bit_length())
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, -1 if it has none."""
        bucket = (x >> self.shift).astype(np.int64)
        at, end, out = self.start[bucket], self.start[bucket + 1], np.full(len(x), -1)
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            hit = self.hashes[place] == x[left]
            out[left[hit]] = place[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Level:
    """Kept contexts of one depth. ``entries``: context * width + word in the order of their hashes, with ``p``: the discounted share of each."""

    keys: np.ndarray  # sorted hashes
    kept: np.ndarray
    rest: np.ndarray  # the weight of the suffix's distribution
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    p: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.contexts, self.places = Index(self.keys), Index(hashing.mix(self.entries.view(np.uint64)))

    def __reduce__(self):
        return Level, (self.keys, self.kept, self.rest, self.entries, self.p)


@dataclass
class Tree:
    """The most frequent words, contexts and next words: all of them if they are few."""

    words: np.ndarray  # sorted hashes
    prior: np.ndarray  # probability of each by frequency alone
    levels: list[Level]
    none: float = 0.0  # probability of a word that does not occur

    def __post_init__(self):
        self.places = Index(self.words)

    def __reduce__(self):
        return Tree, (self.words, self.prior, self.levels, self.none)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return self.places.find(hashes)

    def share(self, level: Level, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each context and word among the entries, -1 if there is none."""
        code = hashing.mix((context * len(self.words) + word).view(np.uint64))
        return np.where((context >= 0) & (word >= 0), level.places.find(code), -1)

    def log10(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Log-probability of each token by the cache alone; for words outside it, only the factor of their frequency's."""
        known = ids >= 0
        p = np.where(known, self.prior[np.maximum(ids, 0)], 1.0)
        hashes = np.where(known, self.words[np.maximum(ids, 0)], np.uint64(0))
        for (context, ok, _), level in zip(before(hashes, doc), self.levels, strict=True):
            at = np.where(ok, level.contexts.find(context), -1)
            on = np.flatnonzero(at >= 0)
            where = self.share(level, at[on], ids[on])
            p[on] *= level.rest[at[on]]
            p[on[where >= 0]] += level.p[where[where >= 0]]
        return np.log10(p)


@dataclass
class Parts:
    """The most frequent keys with their parts."""

    keys: np.ndarray  # sorted
    values: np.ndarray

    @cached_property
    def places(self) -> Index:
        return Index(self.keys)

    def __reduce__(self):
        return Parts, (self.keys, self.values)


@dataclass
class Model:
    """``counts``: key, n. For each depth, ``contexts``: ctx, occurs, rest of those kept; ``entries`` under them: ctx, word, n, occurs, p, key
    and ``adds``, the logarithm of what the entry makes of its suffix's part. ``files``: the stored tables behind each depth."""

    counts: DataFrame
    total: int
    distinct: int
    contexts: list[DataFrame]
    entries: list[DataFrame]
    files: list[list[DataFrame]]

    def prior(self, n: Column) -> Column:
        return (n + PRIOR) / (self.total + PRIOR * (self.distinct + 1))


def _first(hashes: np.ndarray, doc: np.ndarray, count: np.ndarray):
    """Words (under END, which is no context) and pairs of words."""
    context, ok, key = next(before(hashes, doc))
    top = np.full(len(hashes), END)
    return np.concatenate([top, context[ok]]), np.concatenate([join_key(top, hashes), key[ok]])


def build(docs: DataFrame, text: str = "text") -> Model:
    """All counts and the kept contexts, by joins."""
    spark = docs.sparkSession
    end = int(END.view(np.int64))
    word = F.col("ctx") == end
    grams = stored(_counted(docs, _first, text), "pairs")
    release(spark)
    counts = stored(grams.where(word).select(F.col("word").alias("key"), "n"), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = Model(counts, total, distinct, [], [], [])
    candidates = counts.where((F.col("n") >= CONTEXT_LEAST) & (F.col("key") != end)).select(F.col("key").alias("ctx"), F.col("n").alias("occurs"), F.lit(0).cast("long").alias("suffix"))
    below = counts.select(F.col("key").alias("word"), model.prior(F.col("n")).alias("below"))
    on, pairs = ["word"], grams.where(~word)
    every, judged = [], []
    for depth in range(1, DEPTH + 1):
        if depth > 1:
            shared = spark.sparkContext.broadcast(bitmap(candidates.select(F.col("ctx").alias("key"))))

            def make(hashes, doc, count, depth=depth, shared=shared):
                *_, (context, ok, key) = before(hashes, doc, depth)
                here = ok & marked(shared.value, context)
                return context[here], key[here]

            pairs = grams = stored(_counted(docs, make, text), "pairs")
            shared.destroy()
            release(spark)
        sums = pairs.groupBy("ctx").agg(F.sum("n").alias("explicit"), F.count("*").alias("kinds"))
        facts = candidates.join(sums, "ctx").withColumn("rest", 1 - (F.col("explicit") - DISCOUNT * F.col("kinds")) / F.col("occurs")).drop("kinds")
        facts = stored(facts, "facts")
        made = pairs.join(facts, "ctx").join(below, on).withColumn("mixed", (F.col("n") - DISCOUNT) / F.col("occurs") + F.col("rest") * F.col("below"))
        entries = stored(made.select("ctx", "word", "key", "n", *["suffix"] * (1 < depth < DEPTH), "below", "mixed"), "entries")
        free(grams)
        release(spark)
        told = entries.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("mixed") / F.col("below"))).alias("told"))
        gain = F.col("told") + (F.col("occurs") - F.col("explicit")) * F.log(F.greatest(F.col("rest"), F.lit(1e-12)))
        enough = gain >= F.greatest(DIVERGENCE * F.col("occurs"), F.lit(0.5 * math.log(max(total, 2))))
        judged.append(stored(facts.join(told, "ctx").select("ctx", "occurs", "suffix", "rest", enough.alias("enough")), "contexts"))
        free(facts, *([candidates] if depth > 1 else []))
        every.append(entries)
        below, on = entries.select(F.col("ctx").alias("suffix"), "word", F.col("mixed").alias("below")), ["suffix", "word"]
        if depth < DEPTH:
            longer = entries.where((F.col("n") >= CONTEXT_LEAST) & (F.col("word") != end))
            if depth > 1:
                longer = _keyed(longer.select("key", "word", "suffix", "n"), "suffix", "word", "shorter")
            shorter = F.col("shorter" if depth > 1 else "word")
            candidates = stored(longer.select(F.col("key").alias("ctx"), F.col("n").alias("occurs"), shorter.alias("suffix")), "candidates")
    needed = None
    for depth in range(DEPTH, 0, -1):
        kept = judged[depth - 1]
        if needed is not None:
            kept = kept.join(needed, "ctx", "left").where(F.col("enough") | F.col("needed"))
        else:
            kept = kept.where("enough")
        kept = stored(kept.select("ctx", "occurs", "rest", "suffix"), "kept")
        needed = kept.select(F.col("suffix").alias("ctx")).distinct().withColumn("needed", F.lit(True))
        under = every[depth - 1].select("ctx", "word", "key", "n", F.log10(F.col("mixed") / F.col("below")).alias("ratio"))
        under = under.join(kept.select("ctx", "occurs", "rest"), "ctx")
        under = under.select("ctx", "word", "n", "occurs", ((F.col("n") - DISCOUNT) / F.col("occurs")).alias("p"), "key", (F.col("ratio") - F.log10("rest")).alias("adds"))
        model.contexts.insert(0, kept)
        model.entries.insert(0, under)
        model.files.insert(0, [kept, every[depth - 1]])
        free(judged[depth - 1])
    release(spark)
    return model


def _size(n: str) -> Column:
    """Classes of counts, sixteen to a doubling."""
    return F.floor(F.log2(n) * 16)


def hottest(table: DataFrame, n: str, most: int | None = None) -> int:
    """The least class of counts such that no more than ``most`` rows (CACHED) have it or a larger one; 0 if that is all rows."""
    classes = sorted(((r[0], r[1]) for r in table.groupBy(_size(n).alias("c")).count().collect()), reverse=True)
    least, size = NOTHING, 0
    for c, rows in classes:
        size += rows
        if size > (CACHED if most is None else most):
            return least
        least = c
    return 0


def cache(model: Model) -> Tree:
    """The hottest part of the model as a tree."""
    hot = hottest(model.counts, "n")
    rows = model.counts.where(_size("n") >= hot).toArrow()
    words, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(words)
    tree = Tree(words[order], (n[order] + PRIOR) / (model.total + PRIOR * (model.distinct + 1)), [], PRIOR / (model.total + PRIOR * (model.distinct + 1)))
    for contexts, entries in zip(model.contexts, model.entries, strict=True):
        least, own = hottest(contexts, "occurs"), hottest(entries, "n")
        rows = contexts.where(_size("occurs") >= least).select("ctx", "rest").toArrow()
        keys = rows["ctx"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, rest = keys[order], rows["rest"].to_numpy()[order]
        # a word occurs as often as it does after a context, or more: all words of these are in the cache
        cached = (_size("n") >= max(own, hot)) & (_size("occurs") >= least)
        rows = entries.where(cached).select("ctx", "word", "p").toArrow()
        context, word = Index(keys).find(rows["ctx"].to_numpy().view(np.uint64)), tree.ids(rows["word"].to_numpy().view(np.uint64))
        code = context * len(tree.words) + word
        order = np.argsort(hashing.mix(code.view(np.uint64)))
        tree.levels.append(Level(keys, np.ones(len(keys), bool), rest, code[order], rows["p"].to_numpy()[order]))
    return tree


def learn(docs: DataFrame, text: str = "text") -> tuple[Tree, DataFrame, int, int]:
    """The cache of the tree, the table of all counts (key, n), and how many tokens and distinct tokens the training texts have."""
    model = build(docs, text)
    return cache(model), model.counts, model.total, model.distinct


def parts(model: Model) -> list[DataFrame]:
    """Stored tables key, part, heat of words and of each depth: the logarithms that a token's probability is the sum of (a word's beyond that of a word that does not occur),
    and how often the training texts ask for each. The model's own tables are freed."""
    made = [stored(model.counts.select("key", F.log10((F.col("n") + PRIOR) / PRIOR).alias("part"), F.col("n").alias("heat")), "parts")]
    free(model.counts)
    context, after = (F.lit(int(t.view(np.int64))) for t in (_CONTEXT, _NEXT))
    for contexts, entries, files in zip(model.contexts, model.entries, model.files, strict=True):
        rows = contexts.select(F.col("ctx").bitwiseXOR(context).alias("key"), F.log10("rest").alias("part"), F.col("occurs").alias("heat"))
        made.append(stored(rows.unionByName(entries.select(F.col("key").bitwiseXOR(after).alias("key"), F.col("adds").alias("part"), F.col("n").alias("heat"))), "parts"))
        free(*files)
    return made


#: Kinds of rows that score() adds up: keys of words and others that are open, and what is known of a text without them.
_WORD, _OTHER, _TOKENS, _KNOWN, _BASE, _SCORE = range(6)


def _look_up(cached: Parts, bits: np.ndarray, none: float, texts: pa.Array) -> tuple:
    """What the cache tells of some texts: tokens, known tokens, base and score of each; and the text, kind and key of each part that is open."""
    hashes, doc, count = tokens(texts)
    asked = []

    def look(on, keys, kind):
        """Which of these tokens have the key or may have it; those that have it get its part."""
        at = cached.places.find(keys)
        has = at >= 0
        score[on[has]] += cached.values[at[has]]
        miss = np.flatnonzero(~has)
        miss = miss[marked(bits, keys[miss])]
        asked.append((doc[on[miss]], np.full(len(miss), kind), keys[miss]))
        may = has.copy()
        may[miss] = True
        return has, may

    score = np.full(len(hashes), none)
    here = np.arange(len(hashes))
    known, may = look(here, hashes, _WORD)
    base = score.copy()
    for context, ok, key in before(hashes, doc):
        here = here[ok[here]]  # the suffix of a kept context is kept
        here = here[look(here, context[here] ^ _CONTEXT, _OTHER)[1]]
        on = here[may[here]]  # a next word is one of the suffix too
        may = np.zeros(len(hashes), bool)
        may[on[look(on, key[on] ^ _NEXT, _OTHER)[1]]] = True
    add = lambda x: np.bincount(doc, x, len(texts))
    return count, add(known), add(base), add(score), *(np.concatenate(c) for c in zip(*asked, strict=True))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row, learning from rows not held out."""
    spark = docs.sparkSession
    ship(spark)
    model = build(docs.where(~held_out(id_col)), text)
    tables = parts(model)
    release(spark)
    table = reduce(DataFrame.unionByName, tables)
    hot = hottest(table, "heat", SHARE * CACHED)
    keys, values = [], []
    for t in tables:
        rows = t.where(_size("heat") >= hot).select("key", "part").toArrow()
        keys.append(rows["key"].to_numpy().view(np.uint64).copy())
        values.append(rows["part"].to_numpy().copy())
        del rows
        pa.default_memory_pool().release_unused()
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    cached = Parts(keys[order], values[order])
    del keys, values, order
    cold = table.where(_size("heat") < hot).select("key", F.col("part").alias("found"))
    none = math.log10(PRIOR / (model.total + PRIOR * (model.distinct + 1)))
    shared = spark.sparkContext.broadcast((cached, bitmap(cold), none))
    del cached
    pa.default_memory_pool().release_unused()
    release(spark)

    def run(batches):
        for b in batches:
            for i, j in hashing.slices(b.column(2)):
                *told, at, kind, key = _look_up(*shared.value, b.column(2)[i:j])
                row, size = b.column(0)[i:j].to_numpy(), j - i
                of = np.concatenate([*[row * 8 + k for k in (_TOKENS, _KNOWN, _BASE, _SCORE)], row[at] * 8 + kind])
                keys = np.concatenate([hashing.mix(of[: 4 * size].view(np.uint64)), key]).view(np.int64)  # the first are dealt evenly
                ids = pa.concat_arrays([b.column(1)[i:j], pa.nulls(len(of) - size, b.column(1).type)])
                value = pa.concat_arrays([pa.array(np.concatenate(told).astype(float)), pa.nulls(len(at), pa.float64())])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(keys), ids, value], ["of", "key", "id", "value"])

    made = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text))
    made = made.mapInArrow(run, f"of bigint, key bigint, id {docs.schema[id_col].dataType.simpleString()}, value double")
    n = max(partitions(spark), table.count() // HELD + 1)
    made = made.repartition(n, "key").join(cold.repartition(n, "key").hint("shuffle_hash"), "key", "left")
    made = made.where(F.col("value").isNotNull() | F.col("found").isNotNull())
    kind, x = F.col("of").bitwiseAND(7), F.coalesce("value", "found")
    added = lambda x, *kinds: F.sum(F.when(kind.isin(*kinds), x))
    sums = made.groupBy(F.shiftright("of", 3).alias("row")).agg(
        F.max("id").alias(id_col), added(x, _TOKENS).cast("long").alias("n_tokens"), added(F.coalesce("value", F.lit(1.0)), _KNOWN, _WORD).cast("long").alias("n_known"),
        added(x, _BASE, _WORD).alias("base_score"), added(x, _SCORE, _WORD, _OTHER).alias("score"),
    )
    return sums.select(id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return score(read(spark, sf_dir, "documents"))
