"""Landed responses to offers: a table of how each board's payload maps to the common columns.

A landing table has source, company and body (a response of a list request), and where a source needs them: key (of its board:
what its URLs are made with), company_categories (carried on), phrase_no and seq (which request, which response: their order), and run_date. Details are a landing table
of single postings with the path or id that their list names. JSON boards are read with an explicit schema and exploded; feeds and HTML
are read by cards.py. Nulls count as empty; a body that is no JSON gives no offers; an empty table gives none; rows of a list that repeat a
URL are kept but for sources whose policy says which one counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.extract import NOT_GIVEN, contracts, extract_salary, extract_skills, work_mode
from jobloom.functions.text import html_text, keyword_match, let, unescape
from jobloom.operators.offers import Profile, preferred_city


@dataclass(frozen=True)
class Board:
    """How to read one JSON board. ``rows`` is the path of the array of jobs ('' if the body is one);
    the others are SQL expressions over a job ``j``."""

    schema: str
    rows: str
    title: str
    url: str
    location: str
    description: str = "''"
    mode: str = "''"
    contract: str = "''"
    salary: str = "''"
    company: str = "company"
    #: Which job of a URL counts: "first", "last" or all ("").
    dedupe: str = ""
    where: str = "true"
    source: str = ""
    #: The mode of offers that give none.
    otherwise: str = ""
    #: Whether titles need a keyword.
    keywords: bool = False
    #: Until when an offer stands; offers of a board without it have no such column.
    expires: str = ""


#: The value of a field of an advert that is a list of fields; the names of what is an object or a list of objects.
_VALUE = "get(transform(filter(j.advert.values, v -> v.field_id = '{0}'), v -> v.value), 0)"
_NAMES = (
    "transform(CASE WHEN j.{0} LIKE '[%' THEN from_json(j.{0}, 'array<struct<name:string>>') WHEN j.{0} LIKE '{{%' THEN array(from_json(j.{0}, 'struct<name:string>')) "
    "ELSE cast(array() AS array<struct<name:string>>) END, x -> coalesce(x.name, ''))"
)



def _joined(texts: str) -> str:
    """Those of an array that are not blank."""
    return f"array_join(filter({texts}, x -> coalesce(x, '') <> ''), '; ')"


def _pair(a: str, b: str) -> str:
    return f"concat_ws(', ', nullif({a}, ''), nullif({b}, ''))"


def _flags(remote: str, hybrid: str) -> str:
    """Only these two modes are taken from flags; without them the mode is read from place and title."""
    return f"CASE WHEN {remote} THEN 'remote' WHEN {hybrid} THEN 'hybrid' ELSE '' END"


BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "jobs array<struct<title:string,absolute_url:string,location:struct<name:string>,content:string>>", "jobs",
        "j.title", "j.absolute_url", "j.location.name", "j.content",
    ),
    "lever": Board(
        "array<struct<text:string,hostedUrl:string,categories:struct<location:string,allLocations:array<string>,commitment:string>,"
        "workplaceType:string,descriptionPlain:string,salaryRange:struct<min:string,max:string,currency:string,interval:string>>>", "",
        "j.text", "j.hostedUrl", f"CASE WHEN size(j.categories.allLocations) > 0 THEN {_joined('j.categories.allLocations')} ELSE j.categories.location END",
        "concat(coalesce(j.descriptionPlain, ''), ' ', coalesce(j.categories.commitment, ''))", _flags("lower(j.workplaceType) = 'remote'", "lower(j.workplaceType) = 'hybrid'"), "''",
        "CASE WHEN coalesce(j.salaryRange.min, '0') NOT IN ('', '0', '0.0') AND coalesce(j.salaryRange.currency, '') <> '' "
        "THEN concat(j.salaryRange.min, ' - ', coalesce(j.salaryRange.max, j.salaryRange.min), ' ', j.salaryRange.currency, "
        "CASE j.salaryRange.interval WHEN 'per-hour-wage' THEN ' /h' WHEN 'per-month-salary' THEN ' /month' WHEN 'per-year-salary' THEN ' /year' ELSE '' END) END",
    ),
    "smartrecruiters": Board(
        "content array<struct<id:string,name:string,location:struct<city:string,fullLocation:string,remote:boolean,hybrid:boolean>>>", "content",
        "j.name", "concat('https://jobs.smartrecruiters.com/', key, '/', j.id)", "coalesce(nullif(j.location.fullLocation, ''), j.location.city)",
        mode="CASE WHEN j.location.remote THEN 'remote' WHEN j.location.hybrid THEN 'hybrid' ELSE '' END", dedupe="last",
    ),
    "workable": Board(
        "jobs array<struct<title:string,url:string,shortlink:string,city:string,country:string,locations:array<struct<city:string,country:string>>,telecommuting:boolean,employment_type:string,description:string>>", "jobs",
        "j.title", "coalesce(nullif(j.url, ''), j.shortlink)",
        f"CASE WHEN size(j.locations) > 0 THEN array_join(transform(j.locations, l -> {_pair('l.city', 'l.country')}), '; ') ELSE {_pair('j.city', 'j.country')} END", "j.description",
        "CASE WHEN j.telecommuting THEN 'remote' ELSE '' END", "j.employment_type",
    ),
    "recruitee": Board(
        "offers array<struct<title:string,careers_url:string,city:string,country:string,description:string,requirements:string,remote:boolean,hybrid:boolean,employment_type_code:string>>", "offers",
        "j.title", "j.careers_url", _pair("j.city", "j.country"), "concat_ws(' ', j.description, j.requirements)", _flags("j.remote", "j.hybrid"), "j.employment_type_code",
    ),
    "ashby": Board(
        "jobs array<struct<title:string,jobUrl:string,location:string,secondaryLocations:array<struct<location:string>>,isRemote:boolean,workplaceType:string,"
        "descriptionPlain:string,compensation:struct<compensationTierSummary:string>>>", "jobs",
        "j.title", "j.jobUrl", _joined("concat(array(j.location), transform(coalesce(j.secondaryLocations, array()), s -> s.location))"), "j.descriptionPlain",
        _flags("j.isRemote OR lower(j.workplaceType) = 'remote'", "lower(j.workplaceType) = 'hybrid'"), "''", "j.compensation.compensationTierSummary",
    ),
    "oracle_hcm": Board(
        "items array<struct<requisitionList:array<struct<Id:string,Title:string,PrimaryLocation:string,secondaryLocations:array<struct<Name:string>>,WorkplaceType:string,ShortDescriptionStr:string>>>>", "get(_b.items, 0).requisitionList",
        "j.Title", "concat('https://', split(key, '/')[0], '/hcmUI/CandidateExperience/en/sites/', split(key, '/')[1], '/job/', j.Id)",
        "array_join(filter(array_distinct(concat(array(coalesce(j.PrimaryLocation, '')), transform(coalesce(j.secondaryLocations, array()), s -> coalesce(s.Name, '')))), x -> x <> ''), '; ')",
        "j.ShortDescriptionStr", "CASE WHEN lower(j.WorkplaceType) LIKE '%remote%' THEN 'remote' WHEN lower(j.WorkplaceType) LIKE '%hybrid%' THEN 'hybrid' ELSE '' END", dedupe="first",
    ),
    "capgemini": Board(
        "data array<struct<title:string,apply_job_url:string,location:string,description:string,description_stripped:string,contract_type:string>>", "data", "j.title", "j.apply_job_url",
        "CASE WHEN coalesce(j.location, '') <> '' THEN concat(j.location, '; ', country) ELSE country END", "coalesce(nullif(j.description_stripped, ''), j.description)",
        "coalesce(nullif(j.description_stripped, ''), j.description)", "j.contract_type", dedupe="first", where="coalesce(j.apply_job_url, '') <> ''",
    ),
    "phenom": Board(
        "refineSearch struct<data:struct<jobs:array<struct<title:string,jobId:string,multi_location:array<string>,location:string,descriptionTeaser:string,ml_skills:array<string>>>>>",
        "refineSearch.data.jobs", "j.title", "concat(key, '/job/', j.jobId)", f"CASE WHEN size(j.multi_location) > 0 THEN {_joined('j.multi_location')} ELSE j.location END",
        "concat_ws(' ', j.descriptionTeaser, array_join(j.ml_skills, ', '))",
    ),
    "nabory_api": Board(
        "content array<struct<jobPosition:string,fullPagePath:string,voivodeship:string,submissionDeadline:string,intro:string,employmentForm:string,subjectName:string>>", "content",
        "j.jobPosition", "j.fullPagePath", "CASE WHEN near_intro THEN concat(city, ', Polska') WHEN coalesce(j.voivodeship, '') <> '' THEN concat(j.voivodeship, ', Polska') ELSE '' END",
        "j.intro", "j.intro", "j.employmentForm", dedupe="first", where="coalesce(j.submissionDeadline, '9999') >= run_date AND coalesce(j.fullPagePath, '') <> ''",
        company="j.subjectName", source="Budżetówka (gov.pl)", otherwise="Office", keywords=True, expires="coalesce(substring(j.submissionDeadline, 1, 10), '')",
    ),
    "workday": Board(
        "jobPostings array<struct<title:string,externalPath:string,locationsText:string,remoteType:string>>", "jobPostings",
        "j.title", "concat('https://', key, j.externalPath)", "j.locationsText", mode="j.remoteType", dedupe="first", where="coalesce(j.externalPath, '') <> ''",
    ),
    "traffit": Board(
        "array<struct<url:string,advert:struct<name:string,values:array<struct<field_id:string,value:string>>>,options:struct<remote:string,jobType:string>>>", "",
        "j.advert.name", "j.url", f"concat_ws(', ', nullif(get_json_object({_VALUE.format('geolocation')}, '$.locality'), ''), nullif(get_json_object({_VALUE.format('geolocation')}, '$.country'), ''))",
        _VALUE.format("description"), f"concat_ws(' ', {_VALUE.format('remote')}, j.options.remote)", "j.options.jobType",
    ),
    "epam": Board(
        "data struct<jobs:array<struct<name:string,seo:struct<url:string>,city:string,country:string,vacancy_type:string,description:string,text:string>>>", "data.jobs",
        "j.name", "concat('https://careers.epam.com', coalesce(j.seo.url, ''))", f"array_join(array_distinct(concat({_NAMES.format('city')}, {_NAMES.format('country')})), '; ')",
        "coalesce(nullif(j.description, ''), j.text)", "CASE WHEN lower(j.vacancy_type) LIKE '%remote%' THEN 'remote' WHEN lower(j.vacancy_type) LIKE '%hybrid%' THEN 'hybrid' ELSE '' END", dedupe="first",
    ),
}

_more: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_adapter(source: str, adapter: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a source: a function from its landed rows to offers."""
    _more[source] = adapter


def offer_columns(rows: DataFrame, source: str, otherwise: str = "", confirmed: bool = True, kept: tuple[str, ...] = ()) -> DataFrame:
    """The common columns from title, url, location, description, mode, contract, salary as the source has them, and the columns ``kept``. Where a source has
    read them itself, rows may bring _mode (null: not given) and _contracts, _skills (the text skills are looked for in), company_categories and expires_in."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    described = "description" in rows.columns  # cards have none, and nothing is looked for in it
    read = rows.withColumn("_d", html_text(unescape(text("description"))) if described else F.lit(""))  # read whole; only the stored column is cut
    mode = let(work_mode(text("mode")), lambda m: F.when(m != NOT_GIVEN, m).otherwise(F.lit(otherwise) if otherwise else work_mode(F.concat_ws(" ", text("location"), text("title")))))
    own = contracts(text("contract"))
    kinds = F.col("_contracts") if "_contracts" in rows.columns else let(own, lambda k: F.when(F.size(k) > 0, k).otherwise(contracts(F.col("_d")))) if described else own
    salary = F.when(text("salary") != "", text("salary")).otherwise(extract_salary(F.col("_d"))) if described else text("salary")
    return read.select(
        F.col("company"), F.trim(F.regexp_replace(text("title"), r"(?U)\s+", " ")).alias("title"), F.coalesce(F.nullif(F.trim(text("location")), F.lit("")), F.lit(NOT_GIVEN)).alias("location"),
        (F.coalesce("_mode", F.lit(NOT_GIVEN)) if "_mode" in rows.columns else mode).alias("work_mode"), kinds.alias("contract_types"), salary.alias("salary"),
        text("url").alias("url"), F.lit(source).alias("source"), extract_skills(F.col("_skills" if "_skills" in rows.columns else "_d")).alias("skills"),
        F.substring("_d", 1, 8000).alias("description"), F.lit(confirmed).alias("api_confirmed"), *[c for c in ("company_categories", "expires_in") if c in rows.columns],
        *kept,
    )


def first_or_last(rows: DataFrame, which: str, key=("company", "url"), by=("phrase_no", "seq", "place")) -> DataFrame:
    """One row of each url and company, by phrase_no, seq and place. A row number of one lets Spark trim groups before the shuffle."""
    if not which:
        return rows
    order = [F.col(c).asc() if which == "first" else F.col(c).desc() for c in by]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def _with_details(rows: DataFrame, source: str, details: DataFrame, profile: Profile, keywords) -> DataFrame:
    """What the pages of single postings add (details: company, path, body), for titles with a keyword."""
    wanted = keyword_match(F.col("title"), list(keywords or profile.include))
    if source == "workday":
        kind = "jobPostingInfo struct<location:string,additionalLocations:array<string>,country:struct<descriptor:string>,remoteType:string,jobDescription:string>"
        i = F.from_json("body", kind)["jobPostingInfo"]
        cities = F.array_join(F.filter(F.concat(F.array(F.coalesce(i["location"], F.lit(""))), F.coalesce(i["additionalLocations"], F.array().cast("array<string>"))), lambda c: c != ""), "; ")
        found = details.select(F.col("company").alias("_c"), F.col("path").alias("_p"), cities.alias("_cities"), F.coalesce(i["country"]["descriptor"], F.lit("")).alias("_country"), i["remoteType"].alias("_mode"), i["jobDescription"].alias("_text"))
        both = rows.withColumn("_path", F.regexp_replace("url", r"^https://[^/]+/[^/]+", "")).join(found, wanted & (F.col("company") == F.col("_c")) & (F.col("_path") == F.col("_p")), "left")
        place = F.coalesce(F.nullif("_cities", F.lit("")), F.col("location"), F.lit(""))
        named = F.when(F.coalesce("_country", F.lit("")).isin("") | F.contains(place, F.coalesce("_country", F.lit(""))), place).when(place == "", F.col("_country")).otherwise(F.concat(place, F.lit(", "), F.col("_country")))
        new = {"location": named, "mode": F.coalesce(F.nullif("_mode", F.lit("")), F.col("mode")), "description": F.coalesce("_text", "description")}
    else:
        texts = F.map_values(F.from_json("body", "struct<jobAd:struct<sections:map<string,struct<text:string>>>>")["jobAd"]["sections"])
        found = details.select(F.col("company").alias("_c"), F.col("path").alias("_p"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("_text"))
        both = rows.withColumn("_path", F.regexp_extract("url", r"([^/]*)$", 1)).join(found, wanted & (F.col("company") == F.col("_c")) & (F.col("_path") == F.col("_p")), "left")
        new = {"description": F.coalesce("_text", "description")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def _workday_mode(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("partially") | low.contains("hybrid"), "hybrid").when(low.contains("remote"), "remote").when(low.contains("on-site") | low.contains("onsite"), "on-site").otherwise("")


def normalise(landing: DataFrame, source: str, details: DataFrame | None = None, profile: Profile = Profile(), keywords=()) -> DataFrame:
    """Offers of one source; a body that is no JSON gives none."""
    own = landing.where(F.col("source") == source)
    if source in _more:
        return _more[source](own)
    b = BOARDS[source]
    given = lambda c, default: F.coalesce(F.col(c), default) if c in landing.columns else default
    kept_columns = [c for c in ("company_categories",) if c in landing.columns]
    parsed = own.select(
        "company", given("key", F.lit("")).alias("key"), given("phrase_no", F.lit(0)).alias("phrase_no"), given("seq", F.lit(0)).alias("seq"),
        given("run_date", F.lit("")).alias("run_date"), *kept_columns, F.from_json("body", b.schema).alias("_b"),
    )
    jobs = F.expr(b.rows if "(" in b.rows else f"_b.{b.rows}" if b.rows else "_b")
    each = parsed.select("company", "key", "phrase_no", "seq", "run_date", *kept_columns, F.posexplode(jobs).alias("place", "j")).withColumn("country", F.lit(profile.country)).withColumn("city", F.lit(profile.city))
    near = preferred_city(F.col("j.intro"), profile) if source == "nabory_api" else F.lit(False)
    kept = each.where(F.expr(b.where)).withColumn("near_intro", near)
    fields = ("company", "title", "url", "location", "description", "mode", "contract", "salary")
    until = [F.expr(b.expires).alias("expires_in")] if b.expires else []
    rows = kept.select(*[F.expr(getattr(b, f)).alias(f) for f in fields], "phrase_no", "seq", "place", *kept_columns, *until)
    rows = first_or_last(rows, b.dedupe)
    if details is not None:
        rows = _with_details(rows, source, details.where(F.col("source") == source), profile, keywords)
    if source == "workday":
        rows = rows.withColumn("mode", _workday_mode(F.col("mode")))
    if b.keywords:
        rows = rows.where(keyword_match(F.col("title"), list(keywords or profile.include)))
    return offer_columns(rows, b.source or f"Strona kariery ({source})", b.otherwise)


def extract_cards(pages: DataFrame, rules: list[tuple[str, str, str]], card: str) -> DataFrame:
    """Cards of HTML pages by rules (field, pattern, ...) in order of priority: the first pattern of a field that is found counts."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("place", "_card"))
    by_field: dict[str, list[Column]] = {}
    for name, pattern, *_ in rules:
        by_field.setdefault(name, []).append(F.nullif(html_text(F.regexp_extract("_card", pattern, 1)), F.lit("")))
    return each.select("page_id", "place", *[F.coalesce(*cs, F.lit("")).alias(name) for name, cs in by_field.items()])
