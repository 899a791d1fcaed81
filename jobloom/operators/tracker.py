"""The tracker: merging a run into the persistent list, statuses shared between lists, report order."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators import store

# Statuses in the order of the report; those done; the names of yes and no.
STATUSES = ("Nowa", "Obejrzana", "CV wysłane", "Rozmowa", "Odrzucona", "Nie interesuje mnie", "Błędnie dopasowana")
DONE = STATUSES[2:]
NEW, YES, NO = "Nowa", "Tak", "Nie"


def status_rank(status: Column) -> Column:
    """0 for new or blank, 2 for done, 1 for anything else."""
    s = F.coalesce(status, F.lit(""))
    return F.when(s.isin("", NEW), 0).when(s.isin(*DONE), 2).otherwise(1)


def scan(tracker: DataFrame) -> DataFrame:
    """Nulls become empty; rows without a link go."""
    return tracker.na.fill("").where("link <> ''")


def shared_status(rows: DataFrame, order: list[str]) -> DataFrame:
    """key and its strongest status over all lists; the earliest of equal ranks; new ones are not shared."""
    ranked = rows.withColumn("_r", status_rank(F.col("status"))).where("_r > 0")
    by = Window.partitionBy("key").orderBy(F.col("_r").desc(), *[F.col(c).asc() for c in order])
    return ranked.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("key", "status")


def match(previous: DataFrame, current: DataFrame, seq: list[str]) -> DataFrame:
    """current with prev_status and prev_first_seen of the previous row it claims, and is_new. A row looks up its
    link, else its key; the last previous row of a link or key stands; the first current row claims it."""
    last = lambda key: previous.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in seq]))).where("_n = 1")
    got = lambda key, name: last(key).select(F.col(key).alias(f"_{name}"), F.struct(*[F.col(c) for c in seq], "status", "first_seen").alias(name))
    both = current.join(got("link", "by_link"), F.col("link") == F.col("_by_link"), "left").join(got("key", "by_key"), F.col("key") == F.col("_by_key"), "left")
    found = both.withColumn("_hit", F.coalesce("by_link", "by_key")).drop("_by_link", "_by_key", "by_link", "by_key")
    claims = Window.partitionBy("_hit").orderBy(*[F.col(c).asc() for c in seq])
    mine = F.col("_hit").isNotNull() & (F.col("_claim") == 1)
    # rows without a hit never meet in one window
    hit = found.where("_hit is not null").withColumn("_claim", F.row_number().over(claims))
    rest = found.where("_hit is null").withColumn("_claim", F.lit(1))
    return hit.unionByName(rest).select(
        *current.columns,
        F.when(mine, F.coalesce(F.nullif(F.col("_hit.status"), F.lit("")), F.lit(NEW))).otherwise(NEW).alias("status"),
        F.when(mine, F.col("_hit.first_seen")).alias("prev_first_seen"),
        (~mine).alias("is_new"), F.when(mine, F.struct(*[F.col(f"_hit.{c}") for c in seq])).alias("claimed"),
    )


def gone(previous: DataFrame, matched: DataFrame, seq: list[str], in_scope: Column) -> DataFrame:
    """Previous rows that nobody claimed: no longer active where the run covered them."""
    claimed = matched.where("claimed is not null").select(*[F.col(f"claimed.{c}").alias(f"_{c}") for c in seq])
    on = [previous[c] == claimed[f"_{c}"] for c in seq]
    left = previous.join(claimed, on, "left_anti")
    return left.withColumn("active", F.when(in_scope | (F.col("active") == ""), NO).otherwise(F.col("active")))


def collapse(rows: DataFrame, seq: list[str]) -> DataFrame:
    """One row a key, with n_rows and all other columns. Rows are folded in order: a later one replaces the holder if (active, rank) is greater than
    the holder's with its status so far; the stronger status and the earlier first_seen pass on. Since the holder's two values are the greatest so
    far, running maxima over a sorted key tell every step: no key is collected."""
    along = Window.partitionBy("key").orderBy(*[F.col(c).asc() for c in seq])
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    a, r = (F.col("active") == YES).cast("int"), status_rank(F.col("status"))
    ranked = rows.select("*", F.coalesce(a, F.lit(0)).alias("_a"), r.alias("_r"))
    seen = ranked.select("*", F.coalesce(F.max("_a").over(before), F.lit(-1)).alias("_ma"), F.coalesce(F.max("_r").over(before), F.lit(-1)).alias("_mr"))
    wins = (F.col("_a") > F.col("_ma")) | ((F.col("_a") == F.col("_ma")) & (F.col("_r") > F.col("_mr")))
    told = seen.withColumn("_wins", wins).withColumn("_says", (F.col("_r") > F.col("_mr")) | (F.col("_wins") & (F.col("_r") == F.col("_mr"))))
    place = F.struct(*[F.col(c) for c in seq])
    rest = [c for c in rows.columns if c not in ("key", "status", "first_seen")]
    last = lambda flag, value: F.max(F.when(F.col(flag), F.struct(place.alias("p"), value.alias("v"))))
    made = told.groupBy("key").agg(
        F.count("*").alias("n_rows"), last("_wins", F.struct(*[F.col(c) for c in rest])).alias("w"), last("_says", F.col("status")).alias("s"), F.min(F.nullif("first_seen", F.lit(""))).alias("f"),
    )
    return made.select("key", "n_rows", *[F.col("w.v").getField(c).alias(c) for c in rest], F.col("s.v").alias("status"), F.coalesce("f", F.lit("")).alias("first_seen"))


def other_statuses(rows: DataFrame, list_name: str, order: list[str]) -> DataFrame:
    """kind (link or key), value and the strongest status of other lists than ``list_name``; the earliest of equal ranks; new ones are not shared."""
    ranked = rows.where(F.col("list_name") != list_name).withColumn("_r", status_rank(F.col("status"))).where("_r > 0")
    both = F.explode(F.array(F.struct(F.lit("link").alias("kind"), F.col("link").alias("value")), F.struct(F.lit("key").alias("kind"), F.col("key").alias("value"))))
    each = ranked.select("_r", "status", *order, both.alias("k")).select("_r", "status", *order, "k.kind", "k.value").where("value <> ''")
    by = Window.partitionBy("kind", "value").orderBy(F.col("_r").desc(), *[F.col(c).asc() for c in order])
    return each.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("kind", "value", "status")


def raised(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows with the status that other lists have for their link, else for their key, where it is stronger."""
    of = lambda kind: shared.where(F.col("kind") == kind).select(F.col("value").alias(f"_{kind}"), F.col("status").alias(f"_by_{kind}"))
    both = rows.join(of("link"), F.col("link") == F.col("_link"), "left").join(of("key"), F.col("key") == F.col("_key"), "left")
    other = F.coalesce("_by_link", "_by_key", F.lit(""))
    status = F.when(status_rank(other) > status_rank(F.col("status")), other).otherwise(F.col("status"))
    return both.withColumn("status", status).select(*rows.columns)


def merge(previous: DataFrame, current: DataFrame, run_date: str, seq: list[str], scope: DataFrame | None = None, shared: DataFrame | None = None, incomplete: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows, those new in this run). previous and current have key, link, company, source and seq; previous also status, first_seen, last_seen and
    active. scope (company): what the run looked at, all if not given; incomplete (source): what did not work in full, so it shows nothing gone."""
    matched = match(previous, current, seq)
    first = F.coalesce(F.nullif("prev_first_seen", F.lit("")), F.lit(run_date))
    now = matched.select(*current.columns, "status", first.alias("first_seen"), F.lit(run_date).alias("last_seen"), F.lit(YES).alias("active"), F.lit(0).alias("_part"))
    claimed = matched.where("claimed is not null").select(*[F.col(f"claimed.{c}").alias(f"_{c}") for c in seq])
    left = previous.join(claimed, [previous[c] == claimed[f"_{c}"] for c in seq], "left_anti")
    inside = F.lit(True)
    if scope is not None:
        left = left.join(scope.select(F.lower("company").alias("_c")).distinct().withColumn("_in", F.lit(True)), F.lower("company") == F.col("_c"), "left")
        inside = F.coalesce("_in", F.lit(False))
    if incomplete is not None:
        left = left.join(incomplete.select(F.col("source").alias("_s")).distinct().withColumn("_out", F.lit(True)), F.col("source") == F.col("_s"), "left")
        inside = inside & F.col("_out").isNull()
    ended = left.withColumn("active", F.when(inside | (F.coalesce("active", F.lit("")) == ""), NO).otherwise(F.col("active"))).withColumn("_part", F.lit(1)).select(*now.columns)
    every = collapse(now.unionByName(ended), ["_part", *seq]).drop("n_rows", "_part")
    if shared is not None:
        every = raised(every, shared)
    return every, matched.where("is_new").withColumn("first_seen", F.lit(run_date)).select(*current.columns, "status", "first_seen")


def order(rows: DataFrame, then: list[str]) -> DataFrame:
    """Active first, then what is not done, by status, latest first, as before."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0))
    place = F.when(place == 0, len(STATUSES)).otherwise(place - 1)
    return rows.orderBy((F.col("active") == YES).desc(), F.col("status").isin(*DONE).asc(), place.asc(), F.col("first_seen").desc(), *[F.col(c).asc() for c in then])


def placed(rows: DataFrame, then: list[str]) -> DataFrame:
    """Every row with its place in the order, from 0. Sorted by ranges and checkpointed, so that a lost executor cannot deal the ranges anew; the driver sees
    only the number of rows of each range, and hands their starts back as a table of that many rows."""
    spark = rows.sparkSession
    store.shared_dir(spark)
    at = order(rows, then).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for p, n in sorted(tuple(r) for r in at.groupBy(part.alias("p")).count().collect()):
        starts.append((p, before))
        before += n
    first = spark.createDataFrame(starts, "_part long, _first long")
    return at.withColumn("_part", part).join(first, "_part").withColumn("place", F.col("_first") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_first")


def sections(rows: DataFrame) -> DataFrame:
    """section: gone (not found in the last run, whatever its status), done or active."""
    return rows.withColumn("section", F.when(F.coalesce("active", F.lit("")) != YES, "gone").when(F.col("status").isin(*DONE), "done").otherwise("active"))


def section_counts(rows: DataFrame, run_date: str) -> DataFrame:
    """Rows of each section of each list, and how many of the active ones were seen first on run_date."""
    new = (F.col("section") == "active") & (F.col("first_seen") == run_date)
    return sections(rows).groupBy("list_name", "section").agg(F.count("*").alias("n"), F.count_if(new).alias("n_new"))


def seed_if_empty(lists: DataFrame, backup: DataFrame) -> DataFrame:
    """Rows of the backup join those lists that have none."""
    return lists.unionByName(backup.join(lists.select("list_name").distinct(), "list_name", "left_anti"))


def version(spark: SparkSession, path: str) -> int:
    """The number of the current version, 0 if there is none."""
    return store.latest(spark, path).version


def read_lists(spark: SparkSession, path: str, commit: store.Commit) -> DataFrame | None:
    """Rows of all lists of a version with their list_name, None if it has none. Each list is a folder of its own: a filter on list_name reads its folder only."""
    parts = [scan(spark.read.parquet(f"{path}/{folder}")).withColumn("list_name", F.lit(name)) for name, folder in sorted(commit.lists.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the current version, None if there is none."""
    return read_lists(spark, path, store.latest(spark, path))


def write(rows: DataFrame, path: str, version: int) -> str:
    """A snapshot of all lists in a folder of its own, which must not be there yet: its path."""
    to = f"{path}/v={version}"
    rows.write.partitionBy("list_name").parquet(to)
    return to


def _written(rows: DataFrame, path: str, base: store.Commit) -> str:
    """rows in a new data folder for the version after base; no version names it yet."""
    folder = f"v={base.version + 1}/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    return folder


def write_list(rows: DataFrame, path: str, list_name: str) -> int:
    """The next version, in which one list is replaced by rows and the others are as they are when it is published."""
    spark = rows.sparkSession
    folder = _written(rows.drop("list_name"), path, store.latest(spark, path))
    while True:
        done = store.publish(spark, path, store.latest(spark, path), {list_name: folder})
        if done is not None:
            return done.version


#: How often a run begins again because another writer was faster.
ATTEMPTS = 10


def _readable(rows: DataFrame) -> Exception | None:
    """What reading all of rows fails with. Footers alone do not tell: every page is read."""
    try:
        rows.write.format("noop").mode("overwrite").save()
    except Exception as error:
        return error
    return None


def _laid_out(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous in the columns of current and the four of the tracker: what it lacks is empty, what is unknown goes."""
    own = ("status", "first_seen", "last_seen", "active")
    kinds = {f.name: f.dataType for f in current.schema} | dict.fromkeys(own, T.StringType())
    empty = lambda kind: F.lit("" if isinstance(kind, T.StringType) else None).cast(kind)
    return previous.select(*[F.col(c) if c in previous.columns else empty(k).alias(c) for c, k in kinds.items()])


def update(
    spark: SparkSession, path: str, backup: str, list_name: str, current: DataFrame, run_date: str, seq: list[str], batch: tuple[str, int] | None = None, **more
) -> tuple[DataFrame | None, list[str]]:
    """Merges a run into a list of the stored tracker and commits it: (the new rows, problems). A tracker that cannot be read is never written: the run
    goes to the backup folder alone, and a problem says so. batch names a stream and its batch: one that a version holds already changes nothing
    and has no new rows. If another writer commits in between, the run is merged again into what that one wrote."""
    for _ in range(ATTEMPTS):
        before, rows = None, None
        try:
            base = store.latest(spark, path)
            if batch is not None and base.batches.get(batch[0], -1) >= batch[1]:
                return current.where("false"), []
            before = read_lists(spark, path, base)
            if before is None:
                before = _laid_out(current.where("false"), current).withColumn("list_name", F.lit(list_name))
            previous = _laid_out(before.where(F.col("list_name") == list_name), current)
            merged, new = merge(previous, current, run_date, seq, shared=other_statuses(before, list_name, seq), **more)
            rows = _written(merged, path, base)
        except Exception as error:
            cause = error if before is None else _readable(before)
            if cause is None:  # the tracker is sound, the run is not
                raise
            current.write.parquet(f"{backup}/{list_name}/run_date={run_date}/run={uuid.uuid4().hex}")
            return None, [f"{list_name}: the tracker could not be read ({type(cause).__name__}) and was left as it is; the run is in the backup"]
        if store.publish(spark, path, base, {list_name: rows}, dict([batch]) if batch else None) is not None:
            return new, []
        store.remove(spark, f"{path}/{rows}")
    raise RuntimeError(f"{list_name}: other writers were faster {ATTEMPTS} times")


def digest(lists: DataFrame, problems: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row a list (list_name, found, saved, active): its new rows and problems, the totals of all, and whether there is anything to send."""
    news = new_rows.groupBy("list_name").agg(F.count("*").alias("n_new"))
    bad = problems.groupBy("list_name").agg(F.count("*").alias("n_problems"))
    both = lists.join(news, "list_name", "left").join(bad, "list_name", "left").na.fill(0, ["n_new", "n_problems"])
    total = both.agg(F.sum("n_new").alias("total_new"), F.sum("n_problems").alias("total_problems"))
    joined = both.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.withColumn("send", (F.col("total_new") > 0) | (F.col("total_problems") > 0))


# The dash between company and title in a digest.
DASH = " – "


def digest_rows(new_rows: DataFrame, problems: DataFrame) -> DataFrame:
    """What a digest tells, a row a line: list_name, part (new or problem), line and link. New rows name company, title, place and mode; problems follow their
    list's name. Lines of a list are ordered by part and line: nothing is gathered here, as a list may have any number."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    label = F.concat(text("company"), F.lit(DASH), text("title"), F.lit(" ("), text("location"), F.lit(", "), text("work_mode"), F.lit(")"))
    news = new_rows.select("list_name", F.lit("new").alias("part"), label.alias("line"), text("link").alias("link"))
    return news.unionByName(problems.select("list_name", F.lit("problem").alias("part"), F.concat("list_name", F.lit(": "), "problem").alias("line"), F.lit("").alias("link")))
