"""Operators on offers: deduplication, reject cascade, salary assessment, scores, top lists."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.extract import NOT_GIVEN, contracts, extract_cities, extract_salary, salary_numbers, work_mode
from jobloom.functions.language import folded, foreign_languages, title_asks, work_profile
from jobloom.functions.text import company_core, fold_literal, fold_text, keyword_match, let, normalize_title, once, spaced, spaced_match, with_once


@dataclass(frozen=True)
class Profile:
    """What the user looks for; turned into literals when a plan is built. The defaults are those of a tester in one city."""

    city: str = "Wrocław"
    city_aliases: tuple[str, ...] = ("Breslau",)
    country: str = "Poland"
    allow_remote: bool = True
    allow_hybrid_elsewhere: bool = False
    include: tuple[str, ...] = ("tester", "qa", "quality assurance", "test engineer")
    automation_first: tuple[str, ...] = ("automation", "sdet")
    seniority: tuple[str, ...] = ("senior", "lead", "manager")
    manual: tuple[str, ...] = ("manual",)
    general: tuple[str, ...] = ("tester", "qa", "quality assurance", "test engineer")
    skills: tuple[tuple[str, int], ...] = (("SQL", 2), ("Jira", 1))
    min_employment: int = 9000
    min_b2b: int = 80
    preferred_b2b: int = 110
    without_salary: bool = True
    min_score: int = 1
    candidates: int = 30
    report: int = 30


#: Keys of a profile file, by its sections, and the fields they set.
PROFILE_KEYS = (
    ("location", "preferred_city", "city"), ("location", "city_aliases", "city_aliases"), ("location", "country", "country"), ("location", "allow_remote", "allow_remote"),
    ("location", "allow_hybrid_outside_preferred_city", "allow_hybrid_elsewhere"), ("salary", "min_uop_gross_pln", "min_employment"), ("salary", "min_b2b_hourly_pln", "min_b2b"),
    ("salary", "preferred_b2b_hourly_pln", "preferred_b2b"), ("salary", "include_offers_without_salary", "without_salary"), ("job_titles", "include", "include"),
    ("job_titles", "automation_first_exclude", "automation_first"), ("job_titles", "seniority_exclude", "seniority"), ("filtering", "min_match_score", "min_score"),
    ("filtering", "candidates_for_verification", "candidates"), ("filtering", "max_report_offers", "report"),
)


def load_profile(path: str) -> Profile:
    """A profile from a JSON file; what it leaves out keeps its default."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    found = {field: raw[section][key] for section, key, field in PROFILE_KEYS if key in raw.get(section, {})}
    if "matching_skills" in raw:
        found["skills"] = tuple((x["name"], int(x["points"])) for x in raw["matching_skills"])
    return Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


@dataclass(frozen=True)
class Order:
    """The order of input rows, which ties fall back to."""

    columns: tuple[str, ...] = field(default=("seq",))

    def asc(self) -> list[Column]:
        return [F.col(c).asc() for c in self.columns]


def _near(folded: Column, profile: Profile) -> Column:
    out = F.lit(False)
    for name in filter(None, (profile.city, *profile.city_aliases)):
        out = out | folded.contains(fold_literal(name))
    return out


def preferred_city(location: Column, profile: Profile) -> Column:
    return let(fold_text(location), lambda folded: _near(folded, profile))


def _allowed(mode: Column, near: Column, profile: Profile) -> Column:
    low, out = F.lower(mode), near
    if profile.allow_remote:
        out = out | (low == "remote")
    if profile.allow_hybrid_elsewhere:
        out = out | (low == "hybrid")
    return F.coalesce(out, F.lit(False))


def allowed_location(profile: Profile) -> Column:
    return _allowed(F.col("work_mode"), preferred_city(F.col("location"), profile), profile)


# Names and codes of countries, and regions that a remote job may cover.
COUNTRIES = (("poland", ("Poland", "Polska", "PL", "POL")), ("germany", ("Germany", "Deutschland", "DE", "DEU")))
REGIONS = ("europe", "emea", "anywhere", "worldwide", "global", "cee")
REMOTE_WORDS = ("remote", "zdalnie")


def target_country(location: Column, profile: Profile) -> Column:
    """Not given; or the preferred city, a name of the country or, for Poland, one of its cities; or a wide region together with a word for remote work."""
    here = fold_literal(profile.country)
    aliases = dict(COUNTRIES).get(here, (profile.country,))
    inside = preferred_city(location, profile) | keyword_match(location, aliases)
    if here == "poland":
        inside = inside | (F.size(extract_cities(location)) > 0)
    given = F.coalesce(location, F.lit(""))
    return (given == "") | (given == NOT_GIVEN) | inside | (keyword_match(location, REGIONS) & keyword_match(location, REMOTE_WORDS))


def board_relevant(offers: DataFrame, profile: Profile, keywords=()) -> DataFrame:
    """Offers of a board whose title has a keyword and whose place is in the country."""
    return offers.where(keyword_match(F.col("title"), list(keywords or profile.include)) & target_country(F.col("location"), profile))


def _least(offers: DataFrame, order: Order, before=(), last: bool = False) -> tuple[Column, list[Column]]:
    """An aggregate that picks one whole offer (the least, or the last) by ``before``, the order columns and then the others, and the columns that it is made of.
    Each column is in its struct once, as rank and as result: what sorts and shuffles carry is a row, not two."""
    maps = [c for c in offers.columns if isinstance(offers.schema[c].dataType, (T.MapType, T.VariantType))]  # without an order
    ranked = [*order.columns, *[c for c in offers.columns if c not in order.columns and c not in maps]]
    rank = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(before)], *[(F.xxhash64(c) if c == "description" and c not in order.columns else F.col(c)).alias(f"c{i}") for i, c in enumerate(ranked)])
    apart = [*maps, *(c for c in ("description",) if c in ranked and c not in order.columns)]  # not in the rank as they are
    whole = (F.max_by if last else F.min_by)(F.struct(rank.alias("rank"), *apart), rank) if apart else (F.max if last else F.min)(rank)
    at = "_best.rank" if apart else "_best"
    return whole, [F.col(f"_best.{c}" if c in apart else f"{at}.c{ranked.index(c)}").alias(c) for c in offers.columns]


def dedupe_best(offers: DataFrame, profile: Profile, order: Order) -> DataFrame:
    """One offer for each company and title: the richest, the earlier of equals, with ``first_seq``: the order columns of the first of its
    group, whose place it takes. One grouping gives both, and sends a row a task and key at most to its shuffle. Order columns may be null (first)
    or shared: what they leave open goes by the other columns, so that the whole row of one offer stands, whatever the partitions."""
    keyed = offers.withColumn("core", company_core(F.col("company"))).withColumn("norm_title", normalize_title(F.col("title")))
    rich = [allowed_location(profile).cast("int"), (F.coalesce("salary", F.lit("")) != "").cast("int"), F.size("skills"), F.size("contract_types"), (F.col("source") != "LinkedIn").cast("int")]
    best, restored = _least(offers, order, [(-F.coalesce(r, F.lit(-1))) for r in rich])
    made = keyed.groupBy("core", "norm_title").agg(best.alias("_best"), F.min(F.struct(*order.columns)).alias("first_seq"))
    return made.select("core", "norm_title", *restored, "first_seq")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All rows of several sources, with source_rank: the place of the source, which orders rows before their own order."""
    ranked = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def url_dedupe(offers: DataFrame, order: Order, last: bool = False) -> DataFrame:
    """One offer for each URL: the first, or the last; with ``first_seq``, the order columns of the first, whose place either takes. What the order leaves open goes by the other columns."""
    first = F.min(F.struct(*order.columns)).alias("first_seq")
    best, restored = _least(offers, order, last=last)
    if last:
        return offers.groupBy("url").agg(best.alias("_best"), first).select(*restored, "first_seq")
    # the first one's own order columns are those of its place
    return offers.groupBy("url").agg(best.alias("_best")).select(*restored).withColumn("first_seq", F.struct(*order.columns))


def phrase_cap(rows: DataFrame, cap: int, order: Order) -> DataFrame:
    """Up to ``cap`` rows a search phrase, then each URL under its first phrase."""
    capped = rows.withColumn("_n", F.row_number().over(Window.partitionBy("phrase").orderBy(*order.asc()))).where(F.col("_n") <= cap)
    return url_dedupe(capped.drop("_n"), Order(("phrase_no", *order.columns)))


# What the report says of a salary.
NO_SALARY, FOREIGN = "Brak widełek — pokaż ofertę", "Widełki w walucie obcej — do indywidualnej oceny"
UNREADABLE, UNKNOWN_KIND = "Nie udało się odczytać widełek — pokaż ofertę", "Nieznany typ umowy — pokaż ofertę"


def _grouped(n: Column) -> Column:
    """A whole number, half to even, with a space before each group of thousands."""
    return F.translate(F.format_number(F.bround(n), 0), ",", " ")


def assess_salary(offers: DataFrame, profile: Profile) -> DataFrame:
    """salary_ok, salary_class (none, foreign, unreadable, b2b_ok, b2b_consider, b2b_low, uop_ok, uop_low, unknown) and salary_assessment, the class in words with its rate."""
    offers = with_once(offers, _numbers=salary_numbers(F.col("salary")))
    low, numbers = F.lower(F.coalesce("salary", F.lit(""))), F.col("_numbers")
    top, kinds = F.array_max(numbers), F.col("contract_types")
    hourly = low.contains("/h") | low.contains("/hour") | low.contains("/day")
    value = F.when(low.contains("/year"), top / 12).otherwise(top)
    value = F.when(low.contains("/day"), value / 8).otherwise(value)
    named = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
    said_b2b, said_uop = named("B2B"), named("Permanent")
    neither = ~said_b2b & ~said_uop
    net = hourly | low.contains("netto") | F.array_contains(F.split(low, r"\s+"), "net") | low.contains("vat")
    b2b = said_b2b | (neither & net)
    uop = said_uop | (neither & ~net & (low.contains("brutto") | low.contains("gross")))
    rate = F.when(hourly, value).otherwise(value / 160)
    kind = (
        F.when(low == "", "none").when(~low.contains("pln"), "foreign").when(F.size(numbers) == 0, "unreadable")
        .when(b2b & (rate >= profile.preferred_b2b), "b2b_ok").when(b2b & (rate >= profile.min_b2b), "b2b_consider").when(b2b & ~uop, "b2b_low")
        .when(uop & (value >= profile.min_employment), "uop_ok").when(uop, "uop_low").otherwise("unknown")
    )
    out = offers.withColumn("salary_class", kind).withColumn("_rate", rate).withColumn("_value", value)
    is_ = lambda c: F.col("salary_class") == c
    ok = F.when(is_("none"), F.lit(profile.without_salary)).otherwise(~F.col("salary_class").isin("b2b_low", "uop_low"))
    hour = F.concat(F.bround("_rate").cast("long").cast("string"), F.lit(" zł/h)"))
    thousands = lambda n: f"{n:,.0f}".replace(",", " ")
    label = (
        F.when(is_("none"), NO_SALARY).when(is_("foreign"), FOREIGN).when(is_("unreadable"), UNREADABLE)
        .when(is_("b2b_ok"), F.concat(F.lit("B2B ok (ok. "), hour)).when(is_("b2b_consider"), F.concat(F.lit("B2B do rozważenia (ok. "), hour))
        .when(is_("b2b_low"), f"B2B poniżej {profile.min_b2b} zł/h").when(is_("uop_ok"), F.concat(F.lit("UoP ok (do "), _grouped(F.col("_value")), F.lit(" zł brutto)")))
        .when(is_("uop_low"), f"UoP poniżej {thousands(profile.min_employment)} zł brutto").otherwise(UNKNOWN_KIND)
    )
    return out.withColumn("salary_ok", ok).withColumn("salary_assessment", label).drop("_rate", "_value", "_numbers")


def _ready(offers: DataFrame, profile: Profile) -> DataFrame:
    """_title (folded and padded) and _near, made once a row for all rules."""
    return with_once(offers, _title=spaced(F.col("title")), _near=preferred_city(F.col("location"), profile))


#: Fixed value: the reason that a title about manual work gives.
MANUAL_REASON = "testy manualne"
#: Stands between joined texts.
_MARK = "\x00"


def _scored(offers: DataFrame, profile: Profile, extra=()) -> DataFrame:
    title, remote = F.col("_title"), F.coalesce(F.lower("work_mode") == "remote", F.lit(False))
    near = ~remote & F.col("_near")
    manual = spaced_match(title, profile.manual)
    total = F.when(manual, 6).otherwise(0) + F.when(spaced_match(title, [*profile.general, *(extra or profile.include)]), 3).otherwise(0)
    reasons = [F.when(manual, F.lit(MANUAL_REASON))]
    known = F.concat(F.lit(_MARK), F.lower(F.coalesce(F.array_join("skills", _MARK), F.lit(""))), F.lit(_MARK))
    for skill, points in profile.skills:
        has = F.contains(known, F.lit(f"{_MARK}{skill.lower()}{_MARK}"))
        total = total + F.when(has, points).otherwise(0)
        reasons.append(F.when(has, F.lit(skill)))
    total = total + F.when(remote, 3).when(near, 2).otherwise(0)
    total = total + F.when(F.col("salary_class").isin("b2b_ok", "uop_ok"), 2).when(F.col("salary_class") == "none", 1).otherwise(0)
    reasons += [F.when(remote, F.lit("100% remote")), F.when(near, F.lit(profile.city))]
    # the lambda in array_compact also keeps Spark from putting all rules into one method, too long for the JVM to compile
    listed = F.slice(F.array_distinct(F.array_compact(F.array(*reasons))), 1, 6)
    return offers.withColumn("match_score", total).withColumn("match_reasons", listed)


def score(offers: DataFrame, profile: Profile) -> DataFrame:
    """match_score and match_reasons (six at most) from title, skills, place and salary class."""
    return _scored(_ready(offers, profile), profile).drop("_title", "_near")


def reject_cascade(offers: DataFrame, profile: Profile, language: str | None = None, min_score: bool = True, extra_titles=(), extra_seniority=()) -> DataFrame:
    """reject_reason: the first rule that fails, null for those that stay. One chain of conditions, no shuffle. A title that names a foreign language
    asks for it; so does the text in the column ``language`` (description where there is one), which is read for titles that pass only."""
    language = language or ("description" if "description" in offers.columns else None)
    ready = _ready(offers, profile)
    title = F.col("_title")
    named = spaced_match(title, [*profile.include, *extra_titles])
    if language is None:
        ready = ready.withColumn("_foreign", title_asks(title))
    else:
        ready = foreign_languages(ready.withColumn("_text", F.when(named, F.col(language))), "title", "_text", "_languages")
        ready = ready.withColumn("_foreign", F.size("_languages") > 0).drop("_text", "_languages")
    made = _scored(assess_salary(ready, profile), profile, (*profile.include, *extra_titles))
    reason = (
        F.when(~named, "title").when(F.col("_foreign"), "language")
        .when(spaced_match(title, profile.automation_first) & ~spaced_match(title, profile.manual), "automation")
        .when(spaced_match(title, [*profile.seniority, *extra_seniority]), "seniority")
        .when(~_allowed(F.col("work_mode"), F.col("_near"), profile), "location")
        .when(~F.col("salary_ok"), "salary")
    )
    if min_score:
        reason = reason.when(F.col("match_score") < profile.min_score, "score")
    return made.withColumn("reject_reason", reason).drop("_title", "_near", "_foreign")


# What says that a posting has expired.
EXPIRED_MARKERS = ("offer expired", "oferta wygasła", "ogłoszenie wygasło", "oferta nieaktualna")
LONG_SOURCE, LONG_WORDS = "Pracuj.pl", 120


def complete(offers: DataFrame) -> DataFrame:
    """What a list left out, from the description: salary and contracts where blank, the mode where not given."""
    d = F.coalesce("description", F.lit(""))
    some = d != ""
    return offers.withColumns({
        "salary": F.when(some & (F.coalesce("salary", F.lit("")) == ""), extract_salary(d)).otherwise(F.coalesce("salary", F.lit(""))),
        "contract_types": F.when(some & (F.size("contract_types") == 0), contracts(d)).otherwise(F.col("contract_types")),
        "work_mode": F.when(some & (F.col("work_mode") == NOT_GIVEN), work_mode(d)).otherwise(F.col("work_mode")),
    })


def with_long_descriptions(offers: DataFrame, found: DataFrame, most: int | None = None) -> DataFrame:
    """offers with ``expired``, and the whole text of a posting (found: url, text) in place of a short description of one source; with ``most``, as many characters of it."""
    short = (F.col("source") == LONG_SOURCE) & (F.size(F.array_remove(F.split(F.coalesce("description", F.lit("")), r"(?U)\s+"), "")) < LONG_WORDS)
    low = F.lower("_text")
    gone = F.lit(False)
    for mark in EXPIRED_MARKERS:
        gone = gone | low.contains(mark)
    texts = found.groupBy("url").agg(F.max("text").alias("_text")).withColumnRenamed("url", "_url")
    both = offers.withColumn("_short", short).join(texts, F.col("_short") & (F.col("url") == F.col("_url")), "left")
    long = F.col("_text") if most is None else F.substring("_text", 1, most)
    text = F.when(F.coalesce("_text", F.lit("")) != "", long).otherwise(F.col("description"))
    return both.withColumn("expired", F.coalesce(gone, F.lit(False))).withColumn("description", text).drop("_short", "_text", "_url")


def analysis_cascade(offers: DataFrame, profile: Profile, long_descriptions: DataFrame | None = None, settled_too: bool = True, most: int | None = None) -> DataFrame:
    """After verification: reject_reason by the whole description (expired, salary, location, language, automation, score), with fields filled from
    it, and match_score (with a bonus for manual work), manual_share and work_summary. Without settled_too, the descriptions of rows that expiry, salary or
    place settles are not read for languages and work, which is what a run needs: their share stays null. most: as in with_long_descriptions()."""
    df = with_long_descriptions(offers, long_descriptions, most) if long_descriptions is not None else offers.withColumn("expired", F.lit(False))
    # reading a text costs far more than moving it: tasks of equal numbers of rows, whatever the files and however few the bytes
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = once(assess_salary(once(complete(df)), profile))
    cheap = (
        F.when(F.col("expired"), "expired").when(~F.col("salary_ok"), "salary")
        .when(~_allowed(F.col("work_mode"), preferred_city(F.col("location"), profile), profile), "location")
    )
    df = with_once(df, _cheap=cheap)
    text = F.col("description") if settled_too else F.when(F.col("_cheap").isNull(), F.col("description"))
    df = folded(df.withColumn("_text", text), "title", "_text")
    df = work_profile(foreign_languages(df, "title", "_text", "_languages"), "title", "_text", "_profile").drop("_text")
    share = F.col("_profile.manual_share")
    df = df.withColumn("match_score", F.coalesce("match_score", F.lit(0)) + F.coalesce(F.bround((share - 50) / 10).cast("int"), F.lit(0)))
    reason = F.coalesce(
        F.col("_cheap"),
        F.when(F.size("_languages") > 0, "language").when(F.col("_profile.automation_first"), "automation").when(F.col("match_score") < profile.min_score, "score"),
    )
    made = once(df).withColumn("reject_reason", reason).withColumn("manual_share", share).withColumn("work_summary", F.col("_profile.summary"))
    return once(made.drop("_cheap", "_languages", "_profile"))


def reject_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


#: Reasons of both cascades, as their counts name them.
REASONS = ("expired", "title", "language", "automation", "seniority", "location", "salary", "score")


def counted(judged: DataFrame, most: int | None = None) -> tuple[DataFrame, Observation]:
    """judged, and its counts by reason (and kept; and cut: kept rows beyond a report of ``most``), which come with the rows: any job over judged fills them."""
    seen = Observation("reasons")
    kept = F.count_if(F.col("reject_reason").isNull())
    counts = [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS] + [kept.alias("kept")]
    if most is not None:
        counts.append(F.greatest(F.lit(0), kept - most).alias("cut"))
    return judged.observe(seen, *counts), seen


def top(judged: DataFrame, n: int, order: Order) -> DataFrame:
    """The n best kept offers by score, remote first among equals."""
    kept = judged.where("reject_reason is null")
    return kept.orderBy(F.col("match_score").desc(), (F.lower("work_mode") == "remote").desc(), *order.asc()).limit(n)


def analysis_counts(judged: DataFrame, most: int) -> DataFrame:
    """Rows of each reason, those kept, and those of the kept that a report of ``most`` leaves out."""
    row = lambda reason, n: F.struct(reason.alias("reason"), n.alias("n"))
    own, cut = row(F.col("reason"), F.col("n")), row(F.lit("cut"), F.greatest(F.lit(0), F.col("n") - most).cast("long"))
    return reject_counts(judged).select(F.inline(F.when(F.col("reason") == "kept", F.array(own, cut)).otherwise(F.array(own))))  # judged once


# Priorities and what stands for no work summary, as the report shows them; the score from which to apply.
APPLY, CONSIDER, APPLY_FROM = "🟢 Aplikuj", "🟡 Warto rozważyć", 12
NO_SUMMARY = "brak danych w opisie"


def report_row(offers: DataFrame) -> DataFrame:
    """Offers as the report shows them: priority, score of ten, joined lists, and words for what is missing. Columns that earlier steps have not added count as empty."""
    tenth = F.greatest(F.lit(1), F.least(F.lit(10), F.bround(F.col("match_score") / 2).cast("int")))
    given = lambda c, otherwise: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(otherwise)) if c in offers.columns else F.lit(otherwise)
    return offers.select(
        F.when(F.col("match_score") >= APPLY_FROM, APPLY).otherwise(CONSIDER).alias("priority"), "company", "title", "location", "work_mode",
        F.coalesce(F.nullif(F.array_join("contract_types", ", "), F.lit("")), F.lit(NOT_GIVEN)).alias("contracts"), given("salary", NOT_GIVEN).alias("salary"),
        F.concat(tenth.cast("string"), F.lit("/10")).alias("fit"), given("work_summary", NO_SUMMARY).alias("work_summary"), given("salary_assessment", "").alias("salary_assessment"), "source", "url",
    )
