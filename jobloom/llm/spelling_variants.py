"""Spelling variants of the words of a corpus: pairs one edit apart, found in bidirectional FM-indexes.

A word that differs from another by one inserted, deleted or replaced code point shares one of its halves with it (pigeonhole).
Each word is registered under its halves; words of one half meet in one shard, which holds the text of its words between delimiters, the
suffixes of that text and of its reverse in order, and wavelet matrices over the symbols before them. A search keeps the intervals of both orders in step:
it matches the half exactly up to the delimiter, then turns and extends over the other half, where one symbol may differ or be added. Removed
symbols are added ones seen from the other word. All searches of a shard run side by side in numpy.

Where more than HOT words share a half, the zone of the error is halved once more for these words (the exact part then has two ends), until
each group is small or its zone is one symbol, which at most two words a letter share. No group is left out, and none is compared by pairs.

An added symbol counts at the place before a symbol that differs from it, so that each pair is found once. Words follow their forms to the last
by doubling pointers; a form is twice as frequent as its word at least, so a chain has at most 62 steps.

Edge cases: a null text has no words, a null id counts as empty; repeated rows count as often as they are there; very long words work, at a step a symbol;
an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, lower_ascii, read, stored
from .prefix_trie import BYTES, CRC, CRC_TABLE

#: Letters of a word after A-Z became a-z; least code points and occurrences of a word; one run in TYPO loses a letter.
LETTERS, SHORTEST, RAREST, TYPO = "[a-zÀ-ÿ]", 5, 3, 97
#: Registered words a shard (about); words of a group from which its zone is halved again.
SHARD, HOT = 40_000, 20_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, a row an occurrence: the runs of letters, in lower case, one in TYPO (by the hash of id and run) without one of its letters."""
    found = F.regexp_extract_all(lower_ascii(docs[text_col]), F.lit(f"{LETTERS}{{{SHORTEST},}}"), 0)
    made = docs.select(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return made.select(F.when(h % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, rarest: int = RAREST) -> DataFrame:
    """word and n of words that are long and frequent enough."""
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def _registered(words: DataFrame) -> DataFrame:
    """word, n, front and back (lengths of the exact parts at both ends) and the lengths of the words that search there."""
    size = F.length("word")

    def zone(front: Column, back: Column, *sizes: Column) -> Column:
        return F.struct(front.cast("int").alias("front"), back.cast("int").alias("back"), F.array(*sizes).alias("sizes"))

    zero, half, less = F.lit(0), F.floor(size / 2), F.floor((size - 1) / 2)
    odd = F.array(zone(half, zero, size, size - 1), zone(zero, size - half, size), zone(zero, size - 1 - less, size - 1))
    even = F.array(zone(half, zero, size), zone(less, zero, size - 1), zone(zero, size - half, size, size - 1))
    return words.select("word", "n", F.inline(F.when(size % 2 == 1, odd).otherwise(even)))


def _keyed(rows: DataFrame) -> DataFrame:
    ends = F.concat(F.substring("word", F.lit(1), F.col("front")), F.lit("_"), F.substring("word", F.length("word") - F.col("back") + 1, F.col("back")))
    return rows.withColumn("key", ends)


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of crowded groups with both halves of their zones, for each length of the words that search there; a zone of one symbol stays."""
    each = rows.withColumn("size", F.explode("sizes"))
    width = F.col("size") - F.col("front") - F.col("back")
    middle = F.col("front") + F.ceil(width / 2).cast("int")
    zone = lambda front, back: F.struct(front.alias("f"), back.alias("b"))
    both = F.array(zone(F.col("front"), F.col("size") - middle), zone(middle, F.col("back")))
    zones = F.when(width > 1, both).otherwise(F.array(zone(F.col("front"), F.col("back"))))
    made = each.withColumn("zone", F.explode(zones))
    return made.select("word", "n", F.col("zone.f").alias("front"), F.col("zone.b").alias("back"), F.array("size").alias("sizes"))


def registered(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Words under the keys of their exact parts, each key with ``hot`` words at most or a zone of one symbol."""
    rows = _keyed(_registered(words))
    done = None
    while True:
        wide = F.exists("sizes", lambda s: s - F.col("front") - F.col("back") > 1)
        crowded = stored(rows.groupBy("key").agg(F.count("*").alias("c"), F.max(wide).alias("wide")).where((F.col("c") > hot) & F.col("wide")).select("key"), "crowded-halves")
        rest = rows.join(crowded, "key", "left_anti")
        if not crowded.limit(1).count():
            free(crowded)
            return rows if done is None else done.unionByName(rows)
        done = rest if done is None else done.unionByName(rest)
        rows = stored(_keyed(_halved(rows.join(crowded, "key", "left_semi"))), "halved-zones")


class Wavelet:
    """Symbols of a list, for counting one symbol, and all smaller ones, in any run of it."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.split, now = [], [], symbols
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            now = np.concatenate([now[~one], now[one]])
        sizes = np.bincount(symbols, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]  # of suffixes that begin with a symbol
        every = np.arange(1 << self.bits)
        self.base, _, _ = self._down(np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), every)
        self.symbols = symbols

    def _down(self, low: np.ndarray, high: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            z = self.zeros[level]
            a, b = z[low], z[high]
            one = (c >> bit & 1).astype(bool)
            less += np.where(one, b - a, 0)
            low, high = np.where(one, self.split[level] + low - a, a), np.where(one, self.split[level] + high - b, b)
        return low, high, less

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval (and that of the other order) of a pattern with c before it; size 0 if there is none."""
        a, b, less = self._down(low, low + size, c)
        return self.first[c] + a - self.base[c], other + less, b - a


def _suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Rotations of a text in order, by doubling."""
    n, take = len(text), max(1, min(62 // bits, len(text)))
    key = np.zeros(n, np.int64)
    for i in range(take):
        key = key << bits | np.roll(text, -i)
    while True:
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])
        if step.sum() == n - 1 or take >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        key, take = rank * n + np.roll(rank, -take), take * 2


class BiIndex:
    """Both FM-indexes of the text of some different words, each after a delimiter (symbol 0)."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, top: int):
        at = np.arange(len(codes)) + np.repeat(np.arange(len(start)) + 1, size)
        text = np.zeros(len(codes) + len(start), np.int64)
        text[at] = codes
        bits = int(top).bit_length() or 1
        self.n, self.order = len(text), _suffixes(text, bits)
        self.word = np.repeat(np.arange(len(start)), size + 1)
        self.left = Wavelet(text[self.order - 1], top)
        back = text[::-1].copy()
        self.right = Wavelet(back[_suffixes(back, bits) - 1], top)
        self.top = top

    def words(self, low: np.ndarray) -> np.ndarray:
        """Which word stands after the delimiter of each of these suffixes."""
        return self.word[self.order[low]]


def _others(index: Wavelet, low: np.ndarray, size: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(state, symbol) of all symbols but the delimiter before the suffixes of each interval; some of wide intervals may be absent there."""
    wide = size > top
    who = np.repeat(np.flatnonzero(~wide), size[~wide])
    at = np.arange(len(who)) - np.repeat(np.cumsum(size[~wide]) - size[~wide], size[~wide])
    pairs = np.unique(who * (top + 1) + index.symbols[low[who] + at])
    w = np.flatnonzero(wide)
    pairs = np.concatenate([pairs, (w[:, None] * (top + 1) + np.arange(1, top + 1)).ravel()])
    who, c = pairs // (top + 1), pairs % (top + 1)
    return who[c > 0], c[c > 0]


def search(index: BiIndex, codes: np.ndarray, start: np.ndarray, size: np.ndarray, front: np.ndarray, back: np.ndarray, rightward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, added) of the indexed words that differ from a query by one symbol replaced (added is 0) or added (1)
    between its first ``front`` and its last ``back`` symbols. rightward: front > 0, and the exact part is matched there first; else back > 0 = front."""
    first, then = (index.left, index.right) if rightward else (index.right, index.left)
    q = np.arange(len(start))
    low, other, left = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.n)
    exact = front if rightward else back
    step = 0
    while len(q):  # the exact part away from its error, and the delimiter at its end
        at = start[q] + (front[q] - 1 - step if rightward else size[q] - back[q] + step)
        c = np.where(step < exact[q], codes[np.clip(at, 0, len(codes) - 1)], 0)
        low, other, left = first.extend(low, other, left, c)
        if step == 0:
            done = [np.zeros(0, np.int64) for _ in range(4)]
        end = (step == exact[q]) & (left > 0)
        done = [np.concatenate([d, v[end]]) for d, v in zip(done, (q, other, low, left), strict=True)]
        go = (step < exact[q]) & (left > 0)
        q, low, other, left = q[go], low[go], other[go], left[go]
        step += 1
    if not len(start):
        return q, q, q
    q, low, other, left = done  # low is now of the order in which the search goes on
    zone = size - front - back
    last = size - front if rightward else zone + front  # symbols up to the end of the word, the delimiter not counted
    i, err = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)  # err: 0 none yet, 1 replaced, 2 added
    found: list[tuple[np.ndarray, ...]] = []

    def symbol(q: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = start[q] + (front[q] + i if rightward else size[q] - back[q] - 1 - i)
        return np.where(i < last[q], codes[np.clip(at, 0, len(codes) - 1)], 0)

    while len(q):
        parts = []
        clean = np.flatnonzero(err == 0)
        if len(clean):
            s, c = _others(then, low[clean], left[clean], index.top)
            s = clean[s]
            a, b, m = then.extend(low[s], other[s], left[s], c)
            ok = m > 0
            s, c, a, b, m = s[ok], c[ok], a[ok], b[ok], m[ok]
            qs, at = q[s], i[s]
            swap = (at < zone[qs]) & (c != symbol(qs, at))
            if rightward:
                add = ((at < zone[qs]) | ((at == zone[qs]) & (back[qs] == 0))) & (c != symbol(qs, at))
            else:
                add = (at >= 1) & (at <= zone[qs]) & (c != symbol(qs, np.maximum(at - 1, 0)))
            parts += [(qs[swap], at[swap] + 1, np.ones(swap.sum(), np.int64), a[swap], b[swap], m[swap]), (qs[add], at[add], np.full(add.sum(), 2), a[add], b[add], m[add])]
        # nothing can differ any more once the zone is past
        open_ = (err > 0) | (i < zone[q])
        q, i, err, low, other, left = (v[open_] for v in (q, i, err, low, other, left))
        low, other, left = then.extend(low, other, left, symbol(q, i))
        whole = (i == last[q]) & (left > 0) & (err > 0)
        found.append((q[whole], (other if rightward else low)[whole], err[whole] - 1))
        go = (i < last[q]) & (left > 0)
        parts.append((q[go], i[go] + 1, err[go], low[go], other[go], left[go]))
        q, i, err, low, other, left = (np.concatenate(v) for v in zip(*parts, strict=True))
    if not found:
        return q, q, q
    q, low, added = (np.concatenate(v) for v in zip(*found, strict=True))
    return q, index.words(low), added


_PAIR = "word string, n bigint, near string, near_n bigint"


def _pairs(table: pa.Table) -> pa.Table:
    """Pairs of near words of a shard, both ways."""
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    kinds, where, which = np.unique(np.array(words, dtype=object), return_index=True, return_inverse=True)
    kinds = kinds.tolist()
    flat = np.frombuffer("".join(kinds).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(flat, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    size = np.array([len(w) for w in kinds], np.int64)
    start = np.cumsum(size) - size
    index = BiIndex(codes, start, size, len(letters))
    count = n[where]
    front, back = (table[c].to_numpy().astype(np.int64) for c in ("front", "back"))
    asks = table["asks"].to_numpy(zero_copy_only=False)
    left, right = [], []
    for rightward in (True, False):
        k = np.flatnonzero(asks & ((front > 0) == rightward))
        w = which[k]
        q, x, added = search(index, codes, start[w], size[w], front[k], back[k], rightward)
        a = w[q]
        left += [a, x[added == 1]]
        right += [x, a[added == 1]]
    a, b = np.concatenate(left), np.concatenate(right)
    names = pa.array(kinds, pa.string())
    return pa.Table.from_arrays([names.take(pa.array(a)), pa.array(count[a]), names.take(pa.array(b)), pa.array(count[b])], names=["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, n, near, near_n of all pairs of words (word, n; different words) one edit apart, each pair both ways."""
    shards = max(1, math.ceil(3 * words.count() / shard))
    asks = F.array_contains("sizes", F.length("word"))
    rows = registered(words, hot).select("word", "n", "front", "back", asks.alias("asks"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").applyInArrow(_pairs, _PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form: where the chain of forms ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        made = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = made.where("moved").limit(1).count()
        free(now)
        now = made.select("word", "root")
        now.stored_at = made.stored_at
        if not moved:
            return now


def variants(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the words (word, n; different words)."""
    pairs = near_pairs(words, shard, hot)
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))))
    grouped = pairs.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    strong = -F.col("best.m") >= 2 * F.col("n")
    forms = stored(grouped.select("word", "n", "n_near", F.when(strong, F.col("best.w")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "forms")
    last = roots(forms.where("form IS NOT NULL"))
    return forms.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(vocabulary(runs(read(spark, sf_dir, "documents"))), "vocabulary"))


SQL = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM {{docs}}),
many AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS u, r, count(*) AS n FROM run GROUP BY 1, 2),
hashed AS (SELECT r, n, {CRC.format(bytes=BYTES.format(text="u"))} AS h FROM many, tab),
kept AS (SELECT CASE WHEN h % {TYPO} = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS w, n FROM hashed),
voc AS (SELECT w, sum(n)::BIGINT AS n FROM kept WHERE length(w) >= {SHORTEST} GROUP BY w HAVING sum(n) >= {RAREST}),
less AS (SELECT DISTINCT w, n, left(w, i::INT) || substr(w, i::INT + 2) AS d, i FROM (SELECT w, n, unnest(range(length(w))) AS i FROM voc)),
near AS (SELECT DISTINCT a.w, a.n, b.w AS x, b.n AS m FROM less AS a JOIN less AS b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
  UNION SELECT DISTINCT a.w, a.n, b.w, b.n FROM less AS a JOIN voc AS b ON a.d = b.w
  UNION SELECT DISTINCT b.w, b.n, a.w, a.n FROM less AS a JOIN voc AS b ON a.d = b.w),
best AS (SELECT w, n, count(*) AS k, arg_min(x, (-m, x)) AS f, max(m) AS fm FROM near GROUP BY w, n),
form AS (SELECT voc.w, voc.n, coalesce(k, 0) AS k, CASE WHEN fm >= 2 * voc.n THEN f END AS f, CASE WHEN fm >= 2 * voc.n THEN fm END AS fm FROM voc LEFT JOIN best USING (w)),
walk AS (SELECT w, coalesce(f, w) AS at FROM form UNION SELECT walk.w, form.f FROM walk JOIN form ON form.w = walk.at WHERE form.f IS NOT NULL),
ends AS (SELECT walk.w, walk.at FROM walk JOIN form ON form.w = walk.at WHERE form.f IS NULL)
SELECT form.w AS word, form.f AS form, ends.at AS root, form.n, form.k AS n_near, form.fm AS form_n FROM form JOIN ends USING (w)
"""
