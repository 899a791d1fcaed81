"""Judges URLs by rules of host and path, and those that no rule fits by two character models.

The models are of variable order: one learns from URLs that a rule accepts, one from those that a rule rejects. A context of up
to ORDER characters is kept where it was seen LEAST times at least; what follows it is mixed with what follows the next shorter context
(Witten-Bell), down to a uniform choice of code points. A URL's score is the difference of its log10 likelihoods under the two models, divided by
the number of its characters and its end; it is accepted from a threshold on, which is set on labelled rows that the models have not seen.

Every labelled row counts: one in HELD, by the hash of id and URL, sets the threshold, all others are learnt from. judge() counts the URLs that hold a gram, so
that a long URL that repeats one does not outweigh the others. A gram is a character after the ORDER
before it, 21 bits a symbol in two numbers, so that none is mistaken for another. Its counts are made in tasks and summed by Spark; from the table of all
grams, those of shorter contexts follow by grouping, and the difference of both models at each gram by joins with the next shorter one. Nothing
of this goes through the driver. The most frequent grams (CACHED at most) are broadcast as a cache; what a URL needs beyond them is joined. A
difference is a whole number of units of 2^-32, so that its sums do not depend on their order.

Edge cases: a null URL or one without "://" has an empty host and path, no rule, and is judged by its whole text (empty for null); an empty text has
one character, its end; repeated rows each have a result; where the rules label no URL of one of the verdicts there is no model: what no rule
fits is accepted and has no score; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, lower_ascii, read, ship, stored
from .hashing import mix, slices
from .suffix_tree_lm import _size, hottest

ALLOW, BLOCK = "allow", "block"
#: Rules of the query: verdict, host and path.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
#: Characters of the longest context; least times a context is seen; one row in HELD sets the threshold.
ORDER, LEAST, HELD = 5, 2, 5
#: The most grams in the cache; units of a difference; ranges of scores that are summed apart for the threshold.
CACHED, UNIT, RANGES = 1 << 18, 1 << 32, 1024
#: Symbols before and after a URL; how many a URL could go on with.
START, END, SYMBOLS = 0x110000, 0x110001, 0x110001
_KEY = np.uint64(0x9E3779B97F4A7C15)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the text that the models read: what follows "://" with its host in lower case, or the whole URL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(url))
    return host, path, F.when(at > 0, F.concat(host, after)).otherwise(F.coalesce(url, F.lit("")))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict (both null where no rule fits) and the text to be judged."""
    host, path, text = parts(pages[url_col])
    made = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), text.alias("text"))
    fit = made.withColumn("fit", rule(F.col("host"), F.col("path"), rules))
    return fit.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), "text")


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER starts and before an end; and where the first of each is."""
    size = np.array([len(t or "") for t in texts])
    first = np.cumsum(size + ORDER + 1) - (size + 1)
    out = np.full(int((size + ORDER + 1).sum()), START, np.uint64)
    inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[inside] = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[first + size] = END
    return out, first


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character after the ORDER before it: the first three of these six symbols, and the last three."""
    at = np.flatnonzero(codes != START)
    front, back = ([codes[at - k] for k in ks] for ks in ((5, 4, 3), (2, 1, 0)))
    return tuple((x << np.uint64(42) | y << np.uint64(21) | z).view(np.int64) for x, y, z in (front, back))


def _counted(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    """verdict, front, back, n of rows of (verdict, text): how often they hold a gram, or how many hold it."""
    new = lambda *keys: np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    for b in batches:
        for low, high in slices(b.column(1)):
            verdicts, texts = (b.column(i)[low:high].to_pylist() for i in (0, 1))
            for v in set(verdicts):
                own = [t for t, w in zip(texts, verdicts, strict=True) if w == v]
                front, back = grams(symbols(own)[0])
                text = np.repeat(np.arange(len(own)), [len(t or "") + 1 for t in own])
                order = np.lexsort((text, back, front))
                front, back, text = front[order], back[order], text[order]
                if once:
                    kept = new(front, back, text)
                    front, back = front[kept], back[kept]
                first = new(front, back)
                n = np.diff(np.append(first, len(front)))
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(n), pa.string()), *map(pa.array, (front[first], back[first], n))], ["verdict", "front", "back", "n"])


def counted(rows: DataFrame, once: bool = False) -> DataFrame:
    """front, back, allow, block, times: how often each gram is in accepted and in rejected texts, and in those of no verdict (once a text at most, if so asked)."""
    ship(rows.sparkSession)
    counts = rows.select("verdict", "text").mapInArrow(lambda batches: _counted(batches, once), "verdict string, front bigint, back bigint, n bigint")
    kinds = {ALLOW: F.col("verdict") == ALLOW, BLOCK: F.col("verdict") == BLOCK, "times": F.col("verdict").isNull()}
    return counts.groupBy("front", "back").agg(*[F.sum(F.when(of, F.col("n")).otherwise(0)).alias(k) for k, of in kinds.items()])


def fit(rows: DataFrame, once: bool = False) -> DataFrame | None:
    """The stored grams of accepted and rejected texts with their counts, from all rows of verdict and text; None where there are none of one kind."""
    table = stored(counted(rows, once), "url-grams")
    return table if all(table.agg(F.sum(ALLOW), F.sum(BLOCK)).first()) else None


def _last(size: int) -> tuple[Column, Column]:
    """The last symbols of a gram."""
    mask = (1 << 21 * size) - 1
    return F.col("front").bitwiseAND(mask >> 63).alias("front"), F.col("back").bitwiseAND(mask & (1 << 63) - 1).alias("back")


def differences(table: DataFrame) -> DataFrame:
    """front, back, times of each gram, and delta: how much likelier it is accepted than rejected. No context has more rows than there are code points."""
    levels = [table]
    for size in range(ORDER, 0, -1):
        levels.insert(0, stored(levels[0].groupBy(*_last(size)).agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK)), "url-level"))
    made = None
    for size, level in enumerate(levels, 1):
        after = Window.partitionBy("front", F.shiftright("back", 21))
        sums = [c for v in (ALLOW, BLOCK) for c in (F.sum(v).over(after).alias(f"seen_{v}"), F.count_if(F.col(v) > 0).over(after).alias(f"kinds_{v}"))]
        level = level.select("*", *sums)
        if made is None:
            level = level.withColumns({f"p_{v}": F.lit(1 / SYMBOLS) for v in (ALLOW, BLOCK)})
        else:
            front, back = _last(size - 1)
            shorter = made.select(F.col("front").alias("_front"), F.col("back").alias("_back"), f"p_{ALLOW}", f"p_{BLOCK}")
            level = level.join(shorter, (front == F.col("_front")) & (back == F.col("_back"))).drop("_front", "_back")
        mixed = lambda v: (F.col(v) + F.col(f"kinds_{v}") * F.col(f"p_{v}")) / (F.col(f"seen_{v}") + F.col(f"kinds_{v}"))
        made = level.withColumns({f"p_{v}": F.when(F.col(f"seen_{v}") >= LEAST, mixed(v)).otherwise(F.col(f"p_{v}")) for v in (ALLOW, BLOCK)})
    delta = F.round((F.log10(f"p_{ALLOW}") - F.log10(f"p_{BLOCK}")) * UNIT).cast("long")
    out = stored(made.where("times > 0").select("front", "back", "times", delta.alias("delta")), "url-differences")
    free(*levels[:-1])
    return out


def _hash(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    return mix(mix(front.view(np.uint64) * _KEY) + back.view(np.uint64))


def cache(table: DataFrame) -> tuple[tuple[np.ndarray, ...], bool]:
    """Hash, front, back and delta of the most frequent grams of differences(), and whether these are all."""
    least = hottest(table, "times", CACHED)
    rows = table.where(_size("times") >= least).toArrow()
    front, back, delta = (rows[c].to_numpy() for c in ("front", "back", "delta"))
    known, first = np.unique(_hash(front, back), return_index=True)  # of two with one hash, one is joined
    return (known, front[first], back[first], delta[first]), least == 0 and len(first) == len(front)


def scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (with a column text) and their score."""
    spark = rows.sparkSession
    wanted = counted(rows.select(F.lit(None).cast("string").alias("verdict"), "text"))
    table = stored(wanted.unionByName(model).groupBy("front", "back").agg(*[F.sum(c).alias(c) for c in (ALLOW, BLOCK, "times")]), "url-all")
    deltas = differences(table)
    free(table)
    held, whole = cache(deltas)
    shared = spark.sparkContext.broadcast(held)
    place = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *own, delta = shared.value
        for b in batches:
            for low, high in slices(b.column(place), 1 << 18):
                part = b.slice(low, high - low)
                texts = part.column(place).to_pylist()
                front, back = grams(symbols(texts)[0])
                ends = np.cumsum([len(t or "") + 1 for t in texts])
                hit, units = np.zeros(len(front), bool), np.zeros(len(front), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, _hash(front, back)), len(known) - 1)
                    hit = (own[0][at] == front) & (own[1][at] == back)
                    units = np.where(hit, delta[at], 0)
                left = np.flatnonzero(~hit)
                offsets = pa.array(np.append(0, np.searchsorted(left, ends)).astype(np.int32))
                asked = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(front[left]), pa.array(back[left])], ["front", "back"]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.add.reduceat(units, np.append(0, ends[:-1]))), asked], [*b.schema.names, "_units", "_asked"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = rows.mapInArrow(run, f"{schema}, _units bigint, _asked array<struct<front:bigint,back:bigint>>")
    units = F.col("_units")
    if whole:
        free(deltas)
    else:
        made = stored(made.withColumn("_row", F.monotonically_increasing_id()), "url-scores")
        more = made.select("_row", F.inline("_asked")).join(deltas, ["front", "back"]).groupBy("_row").agg(F.sum("delta").alias("_more"))
        made, units = made.join(more, "_row", "left"), units + F.coalesce("_more", F.lit(0))
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    return made.select(*rows.columns, (units / F.lit(float(UNIT)) / size).alias("score"))


def threshold(rows: list[tuple[str, float]]) -> float:
    """The score from which to accept: that with the best mean of both verdicts' rates, of equals the nearest to 0."""
    good = np.sort([s for v, s in rows if v == ALLOW])
    bad = np.sort([s for v, s in rows if v == BLOCK])
    if not len(good) or not len(bad):
        return 0.0
    every = np.unique(np.concatenate([good, bad]))
    cuts = np.unique(np.concatenate([[0.0], every, (every[1:] + every[:-1]) / 2]))
    rate = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[rate >= rate.max() - 1e-12]
    return float(best[np.abs(best).argmin()])


def best_cut(rows: DataFrame) -> float:
    """threshold() of a table of verdict and score, whatever its size: RANGES of scores are summed, then each range by itself."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    good, bad, low, high = rows.agg(of(ALLOW), of(BLOCK), F.min("score"), F.max("score")).first()
    if not good or not bad:
        return 0.0
    part = F.floor((F.col("score") - low) / (high - low) * (RANGES - 1)) if high > low else F.lit(0).cast("long")
    scores = rows.groupBy("score").agg(of(ALLOW).alias("good"), of(BLOCK).alias("bad")).withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of RANGES rows
    sums = scores.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("top"))
    sums = sums.select("part", F.sum("good").over(before).alias("_good"), F.sum("bad").over(before).alias("_bad"), F.max("top").over(before).alias("_top"))
    here = Window.partitionBy("part").orderBy("score")
    less = lambda c: F.coalesce(F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))
    last = F.coalesce(F.lag("score").over(here), F.col("_top"))
    steps = scores.join(F.broadcast(sums), "part").select("score", less("good").alias("good"), less("bad").alias("bad"), last.alias("last"))
    # all cuts above the last score, up to this one, have the same rate
    cuts = F.filter(F.array("score", (F.col("score") + F.col("last")) / 2, F.lit(0.0)), lambda c: (c <= F.col("score")) & (F.col("last").isNull() | (c > F.col("last"))))
    near = F.array_max(F.transform(cuts, lambda c: F.struct((-F.abs(c)).alias("near"), (-c).alias("cut"))))
    rate, _, cut = steps.agg(F.max(F.struct(((good - F.col("good")) * bad + F.col("bad") * good).alias("rate"), near["near"], near["cut"])).alias("best")).first()["best"]
    return 0.0 if high < 0 and rate == good * bad else -cut


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and score (null without models) of each row."""
    rows = parsed(pages, rules, id_col, url_col).withColumn("held", F.pmod(F.xxhash64("id", "text"), F.lit(HELD)) == 0)
    model = fit(rows.where(F.col("verdict").isNotNull() & ~F.col("held")), once=True)
    if model is None:
        cut, out = 0.0, rows.withColumn("score", F.lit(None).cast("double"))
    else:
        out = stored(scored(rows, model).drop("text"), "url-judged")
        free(model)
        cut = best_cut(out.where(F.col("held") & F.col("verdict").isNotNull()))
    own = F.when(F.col("score") < cut, BLOCK).otherwise(ALLOW)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
