"""The registry of companies, and what a run over them reports: scans, methods, problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import fold_literal, fold_text

_ENTRY = "struct<name:string,careers_url:string,category:string,categories:array<string>,priority:string,location_hint:string,work_mode_hint:string,jobs_url:string,ats:string,enabled:boolean,render:boolean>"
_ATS = "array<struct<url:string,type:string>>"
# Names of categories.
CATEGORY_LABELS = (
    ("erp_wms", "ERP/WMS"), ("software_house", "Software house"), ("product", "Produkt"), ("enterprise", "Korporacja IT / consulting"), ("finance", "Bankowość / finanse"),
    ("logistics", "Logistyka / e-commerce"), ("automotive_industrial", "Automotive / przemysł"), ("public", "Sektor publiczny"),
)


def parse_registry(files: DataFrame, body: str = "body") -> DataFrame:
    """Companies of registry files (a JSON text each: an object with ``companies``, or the list itself). An ``ats`` that is neither a text, an
    object with a url nor a list of those fails the query, as do companies without a name or careers_url."""
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    entries = F.when(text.startswith("["), F.from_json(text, f"array<{_ENTRY}>")).otherwise(F.from_json(text, f"struct<companies:array<{_ENTRY}>>")["companies"])
    c = files.select(F.explode(entries).alias("c")).select("c.*")
    raw = F.trim(F.coalesce("ats", F.lit("")))
    parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.when(raw != "", F.array(raw)).otherwise(F.array().cast("array<string>")))
    one = lambda p: F.when(p.startswith("{"), F.from_json(p, "struct<url:string,type:string>")).otherwise(F.struct(p.alias("url"), F.lit("").alias("type")))
    ats = F.transform(F.transform(parts, one), lambda a: F.struct(a["url"].alias("url"), F.coalesce(a["type"], F.lit("")).alias("type")))
    bad = F.exists(ats, lambda a: F.coalesce(a["url"], F.lit("")) == "") | F.col("name").isNull() | F.col("careers_url").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad registry entry: "), F.coalesce("name", F.lit("?"))))).otherwise(ats)
    categories = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.coalesce("category", F.lit("Other"))))
    blank = lambda n: F.coalesce(n, F.lit("")).alias(n)
    return c.select(
        "name", "careers_url", categories.alias("categories"), F.upper(F.coalesce("priority", F.lit("B"))).alias("priority"), blank("location_hint"), blank("work_mode_hint"),
        blank("jobs_url"), checked.cast(_ATS).alias("ats"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("render", F.lit(False)).alias("render"),
    )


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark.read.text(path, wholetext=True), "value")


def select_companies(registry: DataFrame, names=(), tiers=(), categories=()) -> DataFrame:
    """Enabled companies: by a part of the name alone if names are given, else by category and tier."""
    on = registry.where("enabled")
    if names:
        folded = fold_text(F.col("name"))
        return on.where(F.exists(F.array(*[F.lit(fold_literal(n)) for n in names]), lambda n: F.contains(folded, n)))
    if categories:
        on = on.where(F.arrays_overlap(F.transform("categories", F.lower), F.array(*[F.lit(c.casefold()) for c in categories])))
    return on.where(F.col("priority").isin(*[t.upper() for t in tiers])) if tiers else on


def category_labels(categories: Column) -> Column:
    """Categories by their names; unknown ones stay."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS for x in pair])
    return F.transform(categories, lambda c: F.coalesce(F.try_element_at(known, c), c))


def with_company(offers: DataFrame, registry: DataFrame) -> DataFrame:
    """offers with the categories of their company, and its hint where no mode is given. Registries are small, but Spark's statistics decide on a broadcast."""
    known = registry.groupBy(F.col("name").alias("_name")).agg(F.first("categories").alias("company_categories"), F.max("work_mode_hint").alias("_hint"))
    both = offers.join(known, F.col("company") == F.col("_name"), "left")
    mode = F.when((F.col("work_mode") == "Nie podano") & (F.coalesce("_hint", F.lit("")) != ""), F.col("_hint")).otherwise(F.col("work_mode"))
    return both.withColumn("work_mode", mode).withColumn("company_categories", F.coalesce("company_categories", F.array().cast("array<string>"))).drop("_name", "_hint")


def scan_summary(scans: DataFrame) -> DataFrame:
    """Of scans (company, error, error_kind, n_offers): how many were selected, scanned, failed, blocked, outdated, and the offers found."""
    failed = F.coalesce("error", F.lit("")) != ""
    return scans.agg(
        F.count("*").alias("selected"), F.count_if(~failed).alias("scanned"), F.count_if(failed).alias("failed"), F.count_if(failed & (F.col("error_kind") == "blocked")).alias("blocked"),
        F.count_if(failed & (F.col("error_kind") == "outdated")).alias("outdated"), F.coalesce(F.sum(F.when(~failed, F.col("n_offers"))), F.lit(0)).cast("long").alias("discovered"),
    )


def scan_methods(found: DataFrame) -> DataFrame:
    """Of findings (company, step, method, url): the methods of each company that gave a URL no earlier step had, in order of their first such step,
    and how many URLs there are."""
    first = found.groupBy("company", "url").agg(F.min(F.struct("step", "method")).alias("f"))
    steps = first.groupBy("company", "f.method").agg(F.min("f.step").alias("step"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", "method"))), lambda x: x["method"])  # as many as there are methods
    return steps.groupBy("company").agg(ordered.alias("methods"), F.sum("n").alias("n_urls"))


# How problems are told.
PROBLEMS = (("blocked", "zablokowane: "), ("outdated", "nieaktualny adres: "), ("technical", "błąd: "))
WARNING, UNREACHABLE = "ostrzeżenie: ", "niedostępny"


def problems(scans: DataFrame) -> DataFrame:
    """Of scans (company, error, error_kind, warnings): a row for each failed company by the kind of its error, and each warning of an unreachable board."""
    label = F.lit(dict(PROBLEMS)["technical"])
    for kind, text in PROBLEMS[:2]:
        label = F.when(F.col("error_kind") == kind, text).otherwise(label)
    named = lambda c: F.concat("company", F.lit(": "), c)
    failed = scans.where("coalesce(error, '') <> ''").select("company", F.concat(label, named(F.col("error"))).alias("problem"))
    warned = scans.select("company", F.explode("warnings").alias("w")).where(F.contains("w", F.lit(UNREACHABLE))).select("company", F.concat(F.lit(WARNING), named(F.col("w"))).alias("problem"))
    return failed.unionByName(warned)


# Problems of sources that are no companies: one that fails, one that gives nothing.
SOURCE_FAILS, SOURCE_EMPTY = ": źródło nie działa (", ": 0 ofert - możliwa zmiana strony portalu"


def source_problems(runs: DataFrame) -> DataFrame:
    """Of runs of portals and public sources (source, error, warnings, n_offers): source, problem and incomplete. A source that failed has that problem alone; others have
    each of their warnings, and one more if they gave no offer. What failed or warned is incomplete: what it does not show is not gone."""
    failed = F.coalesce("error", F.lit("")) != ""
    fault = F.array(F.struct(F.concat("source", F.lit(SOURCE_FAILS), "error", F.lit(")")).alias("problem"), F.lit(True).alias("incomplete")))
    warned = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.struct(w.alias("problem"), F.lit(True).alias("incomplete")))
    empty = F.when(F.coalesce("n_offers", F.lit(0)) == 0, F.array(F.struct(F.concat("source", F.lit(SOURCE_EMPTY)).alias("problem"), F.lit(False).alias("incomplete"))))
    told = F.when(failed, fault).otherwise(F.concat(warned, F.coalesce(empty, F.array().cast("array<struct<problem:string,incomplete:boolean>>"))))
    return runs.select("source", F.inline(told))
