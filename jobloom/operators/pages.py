"""Operators on fetched pages: response classes, soft errors, verification, enrichment, links, boards.

Pages are reduced to what a rule needs before they meet other tables, so that no whole HTML is shuffled.
Nulls: a null page, title or status counts as missing; repeated rows each have a result; empty tables give empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import jsonld
from jobloom.functions.dom import link_parts
from jobloom.functions.extract import NOT_GIVEN, cities_first, contracts, extract_salary, extract_skills, has_any, work_mode
from jobloom.functions.text import (
    fold_literal, fold_text, html_text, keyword_match, let, once, page_main_text, site_key, titles_match, unescape, url_host, url_path,
)
from jobloom.operators.offers import Profile, preferred_city

# Marks of a closed posting.
CLOSED = (
    "no longer accepting applications", "nie przyjmujemy już aplikacji", "oferta wygasła", "offer expired", "this job is no longer available",
    "this position has been filled", "rekrutacja została zakończona", "ogłoszenie wygasło", "job not found", "nabór został zakończony", "ogłoszenie nieaktualne",
)
# Marks of an error page in its path and its title, and words of a host that is about careers.
ERROR_PATHS = ("404", "not-found", "notfound", "nie-znalez", "page-not-found", "strona-nie-istnieje")
ERROR_TITLES = ("404", "page not found", "nie znaleziono", "strona nie istnieje", "nie została znaleziona")
CAREER_HOST_WORDS = ("kariera", "karier", "career", "careers", "jobs", "praca", "rekrutacja", "work")
#: Characters of a stored description, of what a title is looked for in, and of what follows it.
DESCRIPTION, HEAD, AFTER_TITLE = 8000, 20000, 1500


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def response_class(status: Column, error: Column | None = None) -> Column:
    """ok, blocked, outdated or technical."""
    out = F.when(status.isin(401, 403, 429), "blocked").when(status.isin(404, 410), "outdated")
    if error is not None:
        out = out.when(error == "certificate_mismatch", "outdated")
    return out.when(status == 200, "ok").otherwise("technical")


def page_title(html: Column) -> Column:
    return html_text(F.regexp_extract(_text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def heading(html: Column) -> Column:
    return html_text(F.regexp_extract(_text(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def soft_404(requested: Column, final: Column, html: Column) -> Column:
    """Why a 200 response is an error page, or null: an error path, a redirect to the home page (or that of a language) that is no
    career host's and has no query, or an error title."""
    home = lambda u: F.lower(url_path(u)).rlike(r"^/?(?:[a-z]{2}(?:[-_][a-z]{2})?/?)?$")
    career = keyword_match(F.replace(url_host(final), F.lit("."), F.lit(" ")), CAREER_HOST_WORDS)
    query = F.regexp_extract(_text(final), r"\?([^#]*)", 1)
    title = fold_text(F.regexp_extract(F.substring(_text(html), 1, HEAD), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return (
        F.when(has_any(F.lower(url_path(final)), ERROR_PATHS), "error path")
        .when(~home(requested) & home(final) & (query == "") & ~career, "redirected home")
        .when(has_any(title, [fold_literal(t) for t in ERROR_TITLES]), "error title")
    )


def og_title(html: Column) -> Column:
    tag = F.regexp_extract(_text(html), r"""(?is)<meta\b[^>]*property\s*=\s*["']og:title["'][^>]*>""", 0)
    return html_text(F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\bcontent\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")], F.lit("")))


# Sources whose links go straight to an employer, and what a link of each portal has; '' is any source.
DIRECT = ("Kariera:", "Strona kariery", "Budżetówka")
OFFER_PATHS = (("", "/job-offer/"), ("LinkedIn", "/jobs/view/"), ("No Fluff Jobs", "/pl/job/"), ("RocketJobs", "/oferta-pracy/"), ("Pracuj.pl", ",oferta,"))


def offer_path(source: Column, url: Column) -> Column:
    """Whether an offer's source is direct, or its URL one of an offer of that portal."""
    out = F.lit(False)
    for prefix in DIRECT:
        out = out | source.startswith(prefix)
    for name, part in OFFER_PATHS:
        out = out | (F.contains(url, F.lit(part)) & (source == name if name else F.lit(True)))
    return F.coalesce(out, F.lit(False))


def asked_for(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages of the urls (url) only. Spark filters them before anything is read from their HTML."""
    return pages.join(urls.select("url").distinct(), "url", "left_semi")


def page_facts(pages: DataFrame) -> DataFrame:
    """One row a url: status and, of its html, only: whether it says it is closed, the titles it has, its longest embedded description, its main
    text, the first posting embedded, the first heading. Of several pages of a url the last counts: by ``place`` if there is one (nulls before all),
    then by status and by a hash of the page, so that the same page counts on every run and rows that repeat count once."""
    found = jsonld.postings(pages, "html", "_postings")
    described = F.transform("_postings", lambda p: html_text(jsonld.field(p, "description")))
    longest = F.aggregate(described, F.lit(""), lambda a, d: F.when(F.char_length(d) > F.char_length(a), d).otherwise(a))
    titles = F.concat(F.transform("_postings", jsonld.title), F.array(heading(F.col("html")), og_title(F.col("html")), page_title(F.col("html"))))
    place = [F.col("place")] if "place" in pages.columns else []
    facts = F.struct(
        F.lit(True).alias("read"), F.col("status").alias("status"), (F.col("final_url") if "final_url" in pages.columns else F.col("url")).alias("final_url"),
        has_any(F.lower(html_text(F.col("html"))), CLOSED).alias("closed"), titles.alias("titles"), longest.alias("embedded"), F.col("_main").alias("main_text"),
        F.get("_postings", F.lit(0)).alias("posting"), heading(F.col("html")).alias("heading"),
        F.coalesce(F.get(F.filter(F.transform("_postings", jsonld.organization), lambda n: n != ""), F.lit(0)), F.lit("")).alias("organization"),
    )
    each = found.withColumn("_main", page_main_text(F.col("html"))).select("url", F.struct(*place, "status", F.xxhash64("html")).alias("_order"), facts.alias("_facts"))
    return each.groupBy("url").agg(F.max_by("_facts", "_order").alias("_facts")).select("url", "_facts.*").drop("read")


def page_description(title: Column) -> Column:
    """Over page_facts(): the embedded description; if it has under 80 words, the main text if that is longer and holds the start of the title."""
    start = F.lower(F.substring(_text(title), 1, 40))
    usable = F.when((start == "") | F.contains(F.lower("main_text"), start), F.col("main_text")).otherwise("")
    words = F.size(F.array_remove(F.split("embedded", r"(?U)\s+"), ""))
    picked = F.when((words < 80) & (F.char_length(usable) > F.char_length("embedded")), usable).otherwise(F.col("embedded"))
    return F.substring(F.trim(F.regexp_replace(picked, r"(?U)\s+", " ")), 1, DESCRIPTION)


def verify_offers(offers: DataFrame, pages: DataFrame) -> DataFrame:
    """offers (url, title, api_confirmed, perhaps source and description) with verified, reason and the longer description, by their
    pages (url, status, html, perhaps final_url and place). First rule decides. Offers without a source column count as direct."""
    both = offers.join(page_facts(asked_for(pages, offers)), "url", "left")
    path = offer_path(F.col("source"), F.coalesce("final_url", "url")) if "source" in offers.columns else F.lit(True)
    confirmed = F.coalesce("api_confirmed", F.lit(False))
    matches = F.coalesce(F.exists("titles", lambda t: (t != "") & titles_match(F.col("title"), t)), F.lit(False))
    reason = (
        F.when(F.col("status").isNull(), "no page")
        .when(confirmed & F.col("status").isin(401, 403, 429), "confirmed, blocked")
        .when(F.col("status") != 200, "status")
        .when(~path, "path")
        .when(F.col("closed"), "closed")
        .when(confirmed, "confirmed")
        .when(matches, "title")
        .otherwise("other title")
    )
    made = both.withColumn("reason", reason)
    had = _text("description") if "description" in offers.columns else F.lit("")
    read = F.when(F.col("reason").isin("confirmed", "title", "other title"), page_description(F.col("title"))).otherwise("")
    longer = F.when(F.char_length(read) > F.char_length(had), read).otherwise(had)
    kept = [c for c in offers.columns if c != "description"]
    return made.select(*kept, "status", "reason", F.col("reason").isin("confirmed, blocked", "confirmed", "title").alias("verified"), longer.alias("description"))


def enrich_offers(offers: DataFrame, pages: DataFrame, profile: Profile, keywords: tuple[str, ...] = ()) -> DataFrame:
    """offers with what their own page says, where it was read (status 200): of the first posting embedded, else of what follows the title in
    the main text. Offers that an API confirmed and that have skills or a place are left as they are. A title changes only to one with a keyword."""
    words = [*(keywords or profile.include)]
    done = F.coalesce("api_confirmed", F.lit(False)) & ((F.size("skills") > 0) | (F.col("location") != NOT_GIVEN))
    facts = page_facts(asked_for(pages.where("status = 200"), offers.where(~done))).drop("status", "final_url", "closed", "titles", "embedded", "organization").withColumn("_page", F.lit(True))
    both = offers.join(facts, "url", "left")
    at = F.instr(F.lower("main_text"), F.lower(F.substring("title", 1, 40)))
    staged = both.select(
        "*", (F.coalesce("_page", F.lit(False)) & ~done & F.col("posting").isNotNull()).alias("_j"), (F.coalesce("_page", F.lit(False)) & ~done & F.col("posting").isNull() & (at > 0)).alias("_m"),
        html_text(jsonld.field(F.col("posting"), "description")).alias("_d"), F.substring("main_text", at, F.lit(AFTER_TITLE)).alias("_w"), jsonld.title(F.col("posting")).alias("_jt"),
        F.trim(F.regexp_replace("heading", r"^[\s|•-]+|[\s|•-]+$", "")).alias("_ht"),
    )

    def pick(embedded: Column, window: Column, name: str, blank=("", NOT_GIVEN)) -> Column:
        some = lambda c: F.when(~c.isin(*blank), c)
        return F.when(F.col("_j"), F.coalesce(some(embedded), F.col(name))).when(F.col("_m"), F.coalesce(some(window), F.col(name))).otherwise(F.col(name))

    p = F.col("posting")
    listed = lambda c: F.when(F.size(c) > 0, c)
    kinds = F.when(F.col("_j"), F.coalesce(listed(jsonld.contracts(p)), listed(contracts(F.col("_d"))), F.col("contract_types"))).when(
        F.col("_m"), F.coalesce(listed(contracts(F.col("_w"))), F.col("contract_types"))
    ).otherwise(F.col("contract_types"))
    mode = F.when(jsonld.work_mode(p) != NOT_GIVEN, jsonld.work_mode(p)).otherwise(work_mode(F.col("_d")))
    pay = F.coalesce(F.nullif(jsonld.salary(p), F.lit("")), extract_salary(F.col("_d")))
    titled = lambda c: F.when(keyword_match(c, words), c).otherwise("")
    more = F.when(F.col("_j"), extract_skills(F.col("_d"))).when(F.col("_m"), extract_skills(F.col("main_text"))).otherwise(F.array().cast("array<string>"))
    page_text = F.when(F.char_length("main_text") > F.char_length(_text("description")), F.substring("main_text", 1, DESCRIPTION)).otherwise("")
    new = {
        "title": pick(titled(F.col("_jt")), titled(F.col("_ht")), "title"),
        "location": pick(jsonld.location(p), cities_first(F.col("_w"), profile.city, preferred_city(F.col("_w"), profile)), "location"),
        "work_mode": pick(mode, work_mode(F.col("_w")), "work_mode"), "contract_types": kinds, "salary": pick(pay, extract_salary(F.col("_w")), "salary"),
        "skills": F.array_distinct(F.concat("skills", more)), "description": pick(F.col("_d"), page_text, "description"),
    }
    return staged.select(*[new[c].alias(c) if c in new else F.col(c) for c in offers.columns])


# -- links -------------------------------------------------------------------------------------------

# What marks the URL of a posting; hosts of posting systems; texts of links that are none; texts that say nothing; texts of links to lists.
JOB_URL_MARKERS = (
    "/job/", "/jobs/", "/job-", "/career/", "/careers/", "/kariera/", "/praca/", "/oferta", "/oferty", "/ogloszenia", "/vacancy", "/vacancies", "/position",
    "/opening", "/requisition", "/rekrutacj", "/o/", "/an/", "jobid=", "job_id=", "gh_jid=", "oid=",
)
ATS_HOSTS = (
    "greenhouse.io", "lever.co", "myworkdayjobs.com", "smartrecruiters.com", "teamtailor.com", "workable.com", "bamboohr.com", "ashbyhq.com", "recruitee.com",
    "jobvite.com", "traffit.com", "erecruiter.pl", "successfactors.com", "successfactors.eu", "personio.de", "personio.com", "softgarden.io", "join.com",
    "breezy.hr", "hrlink.pl", "elevato.net", "taleo.net", "icims.com", "oraclecloud.com", "eightfold.ai", "avature.net",
)
SKIP_LINK_TEXT = (
    "cookie", "privacy", "polityka", "regulamin", "linkedin", "facebook", "instagram", "newsletter", "kontakt", "contact", "blog", "strona główna", "see all",
    "zobacz wszystkie", "apply now", "aplikuj", "artykuł", "case study", "webinar", "podcast",
)
GENERIC_LINK_TEXT = ("zobacz więcej", "więcej", "szczegóły", "sprawdź", "read more", "see more", "learn more", "more", "details", "view job", "zobacz ofertę")
LISTING_LINK_TEXT = (
    "oferty pracy", "aktualne oferty", "aktualne rekrutacje", "otwarte rekrutacje", "prowadzone rekrutacje", "zobacz oferty", "wszystkie oferty",
    "ogłoszenia o pracę", "ogloszenia o prace", "open positions", "job openings", "current openings", "open roles", "all jobs", "see jobs", "see all jobs",
    "view jobs", "view all jobs", "browse jobs", "search jobs", "find jobs", "job offers", "job search", "vacancies", "join us", "dołącz do nas",
)


def absolute(href: Column, page: Column) -> Column:
    """href as seen from a page: whole, of the same scheme, host or folder."""
    origin = F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?", 0)
    base = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    bare = F.regexp_replace(page, r"[?#].*$", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?"), F.concat(bare, href)).when(href.startswith("#") | (href == ""), F.concat(bare, href))
        .otherwise(F.concat(base, href))
    )


def is_ats_host(url: Column) -> Column:
    return let(url_host(url), ats_host)


def ats_host(host: Column) -> Column:
    return reduce(lambda a, h: a | (host == h) | host.endswith(f".{h}"), ATS_HOSTS, F.lit(False))


def anchors(pages: DataFrame) -> DataFrame:
    """A row for each link of a page (page_id, url, html): page_id, page_url, place, href (whole), text, title (of its heading, else its
    text, else its label; for a link that says nothing, the heading of its card), context (the text of the largest card around it that is short and has
    few links). A row carries its own parts only, so that the work is linear in the page."""
    each = pages.select("page_id", F.col("url").alias("page_url"), link_parts(_text("html")).alias("_links")).select("page_id", "page_url", F.posexplode("_links").alias("place", "_a"))
    label = lambda name: F.coalesce(
        *[F.nullif(F.regexp_extract("_a.open", rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")], F.regexp_extract("_a.open", rf"""(?is)\s{name}\s*=\s*([^\s"'>]+)""", 1)
    )
    some = lambda c: F.nullif(c, F.lit(""))
    own = F.coalesce(some(html_text(F.col("_a.own"))), some(html_text(F.col("_a.bare"))), some(html_text(label("aria-label"))), html_text(label("title")))
    read = once(each.select(
        "page_id", "page_url", "place", absolute(F.trim(unescape(label("href"))), F.col("page_url")).alias("href"), F.trim(unescape(label("href"))).alias("_raw"), html_text(F.col("_a.bare")).alias("text"),
        own.alias("_own"), html_text(F.col("_a.card")).alias("_card"), F.trim(F.regexp_replace("_a.context", r"(?U)\s+", " ")).alias("context"),
    ))
    generic = keyword_match(F.col("_own"), GENERIC_LINK_TEXT) & (F.char_length("_own") < 30) & (F.col("_card") != "")
    return once(read.select("page_id", "page_url", "place", "href", "_raw", "text", F.when(generic, F.col("_card")).otherwise(F.col("_own")).alias("title"), "context"))


def links(pages: DataFrame) -> DataFrame:
    """A row for each anchor of a page: its place, target and text."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("place", "_a"))
    return each.select("page_id", "place", F.regexp_extract("_a", r'(?i)href="([^"]*)"', 1).alias("href"), html_text(F.col("_a")).alias("text"))


def _bare(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def job_links(pages: DataFrame, keywords, careers_url: str = "careers_url") -> DataFrame:
    """Links of pages (page_id, url, html, perhaps careers_url) to postings, each URL of a page once, at its first place: the title has a keyword
    and is no skipped text, the URL looks like a posting's and is of the same site, the careers page's site or a posting system."""
    a = anchors(pages)
    if careers_url in pages.columns:
        a = a.join(pages.select("page_id", F.col(careers_url).alias("_careers")).distinct(), "page_id")
    else:
        a = a.withColumn("_careers", F.col("page_url"))
    host = lambda c: url_host(F.col(c))
    told = a.select("*", F.trim(F.lower("title")).alias("_low"), host("href").alias("_host"), site_key(host("href")).alias("_site"), site_key(host("page_url")).alias("_page"), site_key(host("_careers")).alias("_home"))
    told = once(once(told).withColumn("_ats", ats_host(F.col("_host"))))
    skipped = ~F.char_length("_low").between(4, 150) | has_any(F.col("_low"), SKIP_LINK_TEXT)
    allowed = (F.col("_site") == F.col("_page")) | (F.col("_site") == F.col("_home")) | F.col("_ats")
    inside = (F.col("_raw") == "") | F.col("_raw").rlike(r"^(?:#|mailto:|tel:|javascript:)")
    kept = told.where(~inside & keyword_match(F.col("title"), keywords) & ~skipped & allowed & (F.col("_ats") | has_any(F.lower("href"), JOB_URL_MARKERS)) & (_bare(F.col("href")) != _bare(F.col("page_url"))))
    first = kept.groupBy("page_id", F.col("href").alias("url")).agg(F.min(F.struct("place", "title", "context")).alias("w"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("w.title", r"(?U)\s+", " "), r"^[ |•-]+|[ |•-]+$", ""))
    return first.select("page_id", "url", F.col("w.place").alias("place"), clean.alias("title"), F.col("w.context").alias("context"))


def listing_links(pages: DataFrame, most: int = 3) -> DataFrame:
    """The first links of each page to lists of postings: short texts that say so, to the same site or a posting system; each URL once."""
    a = anchors(pages).where(F.col("text").isNotNull() & (F.col("text") != "") & (F.char_length("text") <= 60))
    same = (site_key(url_host(F.col("href"))) == site_key(url_host(F.col("page_url")))) | is_ats_host(F.col("href"))
    kept = a.where(keyword_match(F.col("text"), LISTING_LINK_TEXT) & F.col("href").startswith("http") & same & (_bare(F.col("href")) != _bare(F.col("page_url"))))
    first = kept.groupBy("page_id", F.col("href").alias("url")).agg(F.min("place").alias("place"))
    # a page has few of them
    ranked = first.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "url"))), 1, most).alias("l"))
    return ranked.select("page_id", F.posexplode("l").alias("n", "l")).select("page_id", "n", "l.place", "l.url")


def offers_from_links(pages: DataFrame, profile: Profile, keywords=()) -> DataFrame:
    """Offers of career pages (page_id, url, html, company, perhaps careers_url and work_mode_hint) by their job links and the cards around them."""
    found = job_links(pages, list(keywords or profile.include))
    hint = F.col("work_mode_hint") if "work_mode_hint" in pages.columns else F.lit(None).cast("string")
    named = found.join(pages.select("page_id", "company", hint.alias("_hint")).distinct(), "page_id")
    c = F.col("context")
    mode = F.when(work_mode(c) != NOT_GIVEN, work_mode(c)).otherwise(F.coalesce(F.nullif(F.col("_hint"), F.lit("")), F.lit(NOT_GIVEN)))
    return named.select(
        "company", "title", cities_first(c, profile.city, preferred_city(c, profile)).alias("location"), mode.alias("work_mode"), contracts(c).alias("contract_types"), extract_salary(c).alias("salary"),
        "url", F.lit("Strona kariery").alias("source"), extract_skills(c).alias("skills"), "page_id", "place",
    )


def offers_from_jsonld(pages: DataFrame, profile: Profile, keywords=()) -> DataFrame:
    """Offers of pages (page_id, url, html, company, perhaps work_mode_hint) by the postings embedded in them: a title with a keyword and a whole URL."""
    hint = F.col("work_mode_hint") if "work_mode_hint" in pages.columns else F.lit(None).cast("string")
    each = jsonld.postings(pages).select("page_id", "company", hint.alias("_hint"), F.posexplode("postings").alias("place", "p"))
    p, some = F.col("p"), lambda c: F.nullif(c, F.lit(""))
    read = each.select(
        "page_id", "place", "company", "_hint", "p", jsonld.title(p).alias("title"), F.coalesce(some(jsonld.field(p, "url")), jsonld.field(p, "@id")).alias("url"), html_text(jsonld.field(p, "description")).alias("_d"),
    )
    kept = read.where(keyword_match(F.col("title"), list(keywords or profile.include)) & F.col("url").startswith("http"))
    d, listed = F.col("_d"), lambda c: F.when(F.size(c) > 0, c)
    mode = F.when(jsonld.work_mode(p) != NOT_GIVEN, jsonld.work_mode(p)).when(work_mode(d) != NOT_GIVEN, work_mode(d)).otherwise(F.coalesce(some(F.col("_hint")), F.lit(NOT_GIVEN)))
    return kept.select(
        "company", "title", F.coalesce(some(jsonld.location(p)), F.lit(NOT_GIVEN)).alias("location"), mode.alias("work_mode"), F.coalesce(listed(jsonld.contracts(p)), contracts(d)).alias("contract_types"),
        F.coalesce(some(jsonld.salary(p)), extract_salary(d)).alias("salary"), "url", F.lit("Strona kariery").alias("source"), extract_skills(d).alias("skills"), "page_id", "place",
    )


# -- boards ------------------------------------------------------------------------------------------

# How the addresses of posting boards name a board, and which of the groups makes the key; the first that fits counts.
BOARDS = (
    ("greenhouse", r"(?i)https?://(?:job-)?boards(?:-api)?(\.eu)?\.greenhouse\.io/(?:v1/boards/|embed/job_board\?for=)?([\w-]+)", (2,)),
    ("lever", r"(?i)https?://(?:jobs|api)(\.eu)?\.lever\.co/(?:v0/postings/)?([\w.-]+)", (2,)),
    ("smartrecruiters", r"(?i)https?://(?:careers|jobs)\.smartrecruiters\.com/(?:my-applications/)?([\w-]+)", (1,)),
    ("smartrecruiters", r"(?i)https?://api\.smartrecruiters\.com/v1/companies/([\w-]+)", (1,)),
    ("workable", r"(?i)https?://apply\.workable\.com/(?!j/|api/)([\w-]+)", (1,)),
    ("workday", r"(?i)https?://([\w-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([\w-]+)", (1, 2, 3)),
    ("recruitee", r"(?i)https?://([\w-]+)\.recruitee\.com", (1,)),
    ("ashby", r"(?i)https?://jobs\.ashbyhq\.com/([\w.-]+)", (1,)),
    ("traffit", r"(?i)https?://([\w-]+)\.traffit\.com/public/", (1,)),
    ("teamtailor", r"(?i)https?://([\w-]+)\.teamtailor\.com", (1,)),
    ("oracle_hcm", r"(?i)https?://([\w.-]+\.oraclecloud\.com)/hcmUI/CandidateExperience/[a-z]{2}(?:-[A-Za-z]{2})?/sites/(\w+)", (1, 2)),
    ("erecruiter", r"""(?i)https?://skk\.erecruiter\.pl/(?:Code|GetHtml|Offer)\.as[hp]x\?[^"'<>\s]*?cfg=([0-9a-f]{32})""", (1,)),
)
IGNORED_KEYS = ("www", "app", "api", "assets", "cdn", "static", "embed", "wday", "subscriptions", "login")
#: Boards on a host of their own, told by a hint.
OWN_HOST = ("teamtailor", "successfactors", "phenom", "epam", "capgemini")


def detect_board(url: Column, hint: Column | None = None) -> Column:
    """A struct of type and key of the posting board that a URL belongs to, or null. The first pattern that fits counts, even if its
    key is none. A hint names the type: for boards on hosts of their own the key is the host, else only its patterns are tried."""
    u = F.rtrim(F.replace(unescape(url), F.lit("\\/"), F.lit("/")), F.lit("\\"))
    hint = F.coalesce(hint, F.lit("")) if hint is not None else F.lit("")
    board = lambda t, k: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), k.alias("key"))
    none = F.lit(None).cast("struct<type:string,key:string>")
    out = F.when(hint.isin(*OWN_HOST), board(hint, url_host(u)))
    for kind, pattern, groups in BOARDS:
        g = [F.regexp_extract(u, pattern, k) for k in groups]
        if kind == "workday":
            key, named = F.concat(g[0], F.lit("."), g[1], F.lit(".myworkdayjobs.com/"), g[2]), g[2]
        elif kind == "oracle_hcm":
            key, named = F.concat(g[0], F.lit("/"), g[1]), F.lit("-")
        else:
            key, named = (F.lower(g[0]) if kind == "erecruiter" else g[0]), g[0]
        out = out.when(((hint == "") | (hint == kind)) & u.rlike(pattern), F.when(F.lower(named).isin(*IGNORED_KEYS), none).otherwise(board(kind, key)))
    return out.otherwise(none)


def boards_in_pages(pages: DataFrame) -> DataFrame:
    """page_id, type, key: each board that a page (page_id, url, html) names, once: by the addresses in its source, but for teamtailor; and by what is
    typical of systems that run under a company's own host, with that host as key."""
    raw = F.regexp_extract_all(_text("html"), F.lit(r"""https?:(?:\\?/){2}[^\s"'<>)]+"""), F.lit(0))
    named = pages.select("page_id", F.explode(F.array_distinct(raw)).alias("u")).select("page_id", detect_board(F.col("u")).alias("b")).where("b.type <> 'teamtailor'")
    low, host = F.lower(_text("html")), url_host(F.col("url"))
    cdn = low.contains("teamtailor-cdn") | low.contains("powered by teamtailor") | low.contains("utm_campaign=poweredby")
    own = {
        "teamtailor": (low.contains("teamtailor") & cdn) | host.endswith("teamtailor.com"),
        "phenom": low.contains("phenompeople.com") & low.contains('"refnum"'),
        "successfactors": low.contains("jobtitle-link") | (low.contains("rmkcdn.successfactors.com") & low.contains("/search/")),
    }
    hosted = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("type"), host.alias("key"))) for k, c in own.items()]))
    every = named.unionByName(pages.select("page_id", F.explode(hosted).alias("b")))
    return every.select("page_id", "b.type", "b.key").distinct()


#: Schema of board rules: their order; the type of board; the end of its hosts, whole labels; the pattern of its addresses; the key, with the pattern's groups as $1,
#: $2...; the group that tells keys which are none; whether keys are lower-cased.
BOARD_RULES = "no int, type string, suffix string, pattern string, key string, named string, lower boolean"


def board_rules(spark) -> DataFrame:
    """The rules of BOARDS as a table, to which others can be added."""
    suffix = {"greenhouse": "greenhouse.io", "lever": "lever.co", "smartrecruiters": "smartrecruiters.com", "workable": "workable.com", "workday": "myworkdayjobs.com", "recruitee": "recruitee.com",
              "ashby": "ashbyhq.com", "traffit": "traffit.com", "teamtailor": "teamtailor.com", "oracle_hcm": "oraclecloud.com", "erecruiter": "erecruiter.pl"}
    key = {"workday": "$1.$2.myworkdayjobs.com/$3", "oracle_hcm": "$1/$2"}
    named = {"workday": "$3", "oracle_hcm": "-"}
    rows = [(i, kind, suffix[kind], pattern, key.get(kind, f"${g[0]}"), named.get(kind, f"${g[0]}"), kind == "erecruiter") for i, (kind, pattern, g) in enumerate(BOARDS)]
    return spark.createDataFrame(rows, BOARD_RULES)


def detect_boards(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with the type and key of the board that each belongs to (null: none), by rules in a table. Rules meet URLs by the ends of the hosts that a
    URL names, so each URL is tried against its few candidates only; the first rule that fits counts, even if its key is none. Each distinct URL is tried once."""
    whole = lambda c: F.rtrim(F.replace(unescape(c), F.lit("\\/"), F.lit("/")), F.lit("\\"))
    each = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("_url")).distinct().withColumn("_u", whole(F.col("_url")))
    hosts = F.regexp_extract_all(F.lower("_u"), F.lit(r"https?://([^/?#\s]+)"), F.lit(1))

    def ends(host: Column) -> Column:
        labels = F.split(host, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    tried = each.withColumn("suffix", F.explode(F.array_distinct(F.flatten(F.transform(hosts, ends))))).join(rules, "suffix").where(F.expr("_u RLIKE pattern"))
    hit = "regexp_extract(_u, pattern, 0)"
    key, named = F.expr(f"regexp_replace({hit}, pattern, key)"), F.expr(f"regexp_replace({hit}, pattern, named)")
    found = F.struct("no", "type", F.when(F.col("lower"), F.lower(key)).otherwise(key).alias("key"), F.lower(named).isin(*IGNORED_KEYS).alias("none"))
    first = tried.groupBy("_url").agg(F.min(found).alias("_b")).where("NOT _b.none").select("_url", "_b.type", "_b.key")
    return urls.join(first, F.col(url) == F.col("_url"), "left").drop("_url")
