"""Queries of the sources: offers wrapped in the shape of each, read by its adapter, and the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.plans.catalogue import OFFERS, PROFILE, _keyword, _queries, _sql, query, read
from jobloom.sources import adapters, cards
from jobloom.sources.tables import card_landing, in_pages, landing, numbered

_id = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
#: Rows with an id; k: one row of each id, as the sources keep one of a URL.
N = f"WITH {OFFERS}, n AS (SELECT *, {_id} AS id FROM o)"
_remote_title = "CASE WHEN contains(title, 'Remote') OR contains({0}, 'Remote') THEN 'Remote' ELSE 'Nie podano' END"
_cities = "location IN ('Wrocław', 'Warszawa, Poland')"

#: source -> location, mode, contracts, salary, url, and a condition.
EXPECT = {
    "greenhouse": ("location", _remote_title.format("location"), "''", "''", "url", "true"),
    "lever": (
        "CASE WHEN l_partkey % 3 = 0 THEN location || '; Opole' ELSE location END",
        f"CASE l_partkey % 4 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Remote' ELSE {_remote_title.format('location')} END", "CASE WHEN l_partkey % 2 = 0 THEN 'B2B,Permanent' ELSE 'B2B' END",
        "CASE l_orderkey % 5 WHEN 0 THEN '100 - 100 PLN /h' WHEN 1 THEN '12.5 - 20.25 EUR' WHEN 3 THEN l_orderkey || ' - ' || (l_orderkey + 1) || ' PLN /month' ELSE '' END", "url", "true",
    ),
    "smartrecruiters": ("location", "'Remote'", "''", "''", f"'https://jobs.smartrecruiters.com/acme/' || {_id}", "true"),
    "workable": (
        "CASE WHEN l_partkey % 3 = 0 THEN location || '; Polska' WHEN l_partkey % 2 = 0 THEN location || ', Polska' ELSE location END",
        f"CASE WHEN l_partkey % 5 = 0 THEN 'Remote' ELSE {_remote_title.format('location')} END", "CASE WHEN l_partkey % 7 > 0 THEN 'B2B' ELSE '' END", "''",
        f"CASE WHEN l_partkey % 4 = 0 THEN 'https://w.co/' || {_id} ELSE url END", "true",
    ),
    "recruitee": (
        "CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'Poland' ELSE 'Nie podano' END WHEN l_partkey % 3 = 0 THEN location || ', Poland' ELSE location END",
        f"CASE WHEN l_partkey % 5 = 0 THEN 'Remote' WHEN l_partkey % 5 > 1 THEN 'Hybrid' WHEN contains(title, 'Remote') OR (l_partkey % 4 > 0 AND contains(location, 'Remote')) THEN 'Remote' ELSE 'Nie podano' END",
        "CASE WHEN l_partkey % 7 = 0 THEN 'Permanent' ELSE 'B2B' END", "l_partkey || ' PLN /h'", "url", "true",
    ),
    "ashby": (
        "CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'Opole' ELSE 'Nie podano' END WHEN l_partkey % 3 = 0 THEN location || '; Opole' ELSE location END",
        "CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 % 4 = 2 THEN 'Remote' WHEN l_partkey % 7 % 4 = 1 THEN 'Hybrid' WHEN contains(title, 'Remote') OR (l_partkey % 4 > 0 AND contains(location, 'Remote')) THEN 'Remote' ELSE 'Nie podano' END",
        "''", "CASE WHEN l_partkey % 2 = 0 THEN salary ELSE '' END", "url", "true",
    ),
    "oracle_hcm": ("location || '; Opole'", "'Hybrid'", "''", "''", f"'https://eg.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/' || {_id}", "true"),
    "capgemini": ("CASE WHEN l_partkey % 7 = 0 THEN 'Poland' ELSE location || '; Poland' END", "CASE WHEN contains(title, 'Remote') OR (l_partkey % 7 <> 0 AND contains(location, 'Remote')) THEN 'Remote' ELSE 'Nie podano' END", "'Permanent'", "''", "url", "l_partkey % 10 <> 0"),
    "phenom": (
        "CASE WHEN l_partkey % 3 = 0 THEN location || '; Opole' ELSE location || ' HQ' END", _remote_title.format("location"), "''", "''", f"'https://careers.x.com/pl/en/job/' || {_id}", "true",
    ),
    "nabory_api": ("CASE WHEN l_partkey % 3 = 0 THEN 'Wrocław, Polska' ELSE location || ', Polska' END", "'Office'", "'Permanent'", "''", "url", f"l_partkey % 5 <> 0 AND {_keyword('title', ['bolt', 'gear', 'widget'])}"),
    "workday": ("location", "'Hybrid'", "''", "''", f"'https://t.wd3.myworkdayjobs.com/Site/job/' || {_id}", "true"),
    "traffit": ("location || ', Polska'", "'Hybrid'", "'B2B'", "''", "url", "true"),
    "epam": ("location || '; Poland'", "'Remote'", "''", "''", f"'https://careers.epam.com/job/' || {_id}", "true"),
    "teamtailor": ("location || ', Polska; Opole'", "'Hybrid'", "'B2B'", "l_partkey || ' PLN /h'", "url", "true"),
    "successfactors": ("location", _remote_title.format("location"), "''", "''", f"'https://jobs.x.com/job/' || {_id}", "true"),
    "erecruiter": ("CASE WHEN contains(location, ',') THEN location ELSE location || ', Polska' END", _remote_title.format("location"), "''", "''", f"'https://skk.erecruiter.pl/Offer.aspx?oid=' || {_id} || '&cfg=c0'", "true"),
    "justjoinit": (
        "CASE l_partkey % 4 WHEN 1 THEN 'Remote or Hybrid' WHEN 2 THEN 'office, mobile' WHEN 3 THEN 'Any place' ELSE location END",
        "CASE WHEN l_partkey % 4 = 1 OR contains(title, 'Remote') OR contains(location, 'Remote') THEN 'Remote' WHEN l_partkey % 4 = 0 THEN 'Hybrid' WHEN l_partkey % 4 = 2 THEN 'Office' ELSE 'Nie podano' END",
        "'B2B' || CASE l_partkey % 3 WHEN 0 THEN ',Contract' WHEN 1 THEN ',Permanent,Mandate contract,Contract' ELSE '' END || CASE WHEN l_partkey % 4 = 3 THEN ',Any' ELSE '' END", "l_partkey || ' PLN / h'", f"'https://justjoin.it/job-offer/' || {_id}", "true"),
    "nofluffjobs": ("CASE WHEN location = 'Wrocław' THEN 'Wrocław' ELSE 'Remote' END", "'Hybrid'", "''", "l_partkey || ' PLN /h'", f"'https://nofluffjobs.com/pl/job/' || {_id}", "true"),
    "rocketjobs": ("location", "'Remote'", "'Mandate contract'", "l_partkey || ' PLN /h'", f"'https://rocketjobs.pl/oferta-pracy/' || {_id}", "true"),
    "linkedin": ("location", f"CASE WHEN {_cities} THEN 'Nie podano' ELSE 'Remote' END", "''", "''", "'https://www.linkedin.com/jobs/view/' || (1000000 + l_orderkey) || l_linenumber || l_partkey || l_suppkey", "true"),
}
#: Sources that keep one job of a URL; ids (and so URLs) repeat where line items do.
ONE = ("smartrecruiters", "oracle_hcm", "capgemini", "nabory_api", "workday", "epam", "successfactors", "justjoinit", "nofluffjobs", "rocketjobs", "linkedin")


def _adapter(source: str):
    place, mode, contract, salary, url, where = EXPECT[source]
    distinct = "DISTINCT" if source in ONE else ""
    # of the URLs that keep one job, only what does not depend on which one is compared
    shown = f"company, trim(title) AS title, {place} AS location, {mode} AS work_mode, {contract} AS contracts, {salary} AS salary, {url} AS url"

    @query(f"{N} SELECT {distinct} {shown} FROM n WHERE {where}")
    def norm(spark, d) -> DataFrame:
        if source in cards.RULES:
            made = cards.read_cards(card_landing(spark, d, source), source, PROFILE)
        else:
            made = adapters.normalise(landing(spark, d, source), source, profile=PROFILE)
        return made.select("company", "title", "location", "work_mode", F.array_join("contract_types", ",").alias("contracts"), "salary", "url")

    _queries[f"norm_{source}"], _sql[f"norm_{source}"] = _queries.pop("norm"), _sql.pop("norm")


for _source in EXPECT:
    _adapter(_source)


@query(f"{N} SELECT DISTINCT {_id} AS id, CASE WHEN {_keyword('title', ['bolt', 'gear', 'widget'])} THEN 'Gdynia; Sopot, Poland' ELSE location END AS location, CASE WHEN {_keyword('title', ['bolt', 'gear', 'widget'])} THEN 'Office' ELSE 'Hybrid' END AS work_mode FROM n")
def workday_details(spark, d) -> DataFrame:
    """Lists with the pages of their postings: all cities and the mode, for titles with a keyword."""
    info = F.to_json(F.struct(F.struct(F.lit("Gdynia").alias("location"), F.array(F.lit("Sopot")).alias("additionalLocations"), F.struct(F.lit("Poland").alias("descriptor")).alias("country"), F.lit("On-site").alias("remoteType"), F.lit("<p>SQL</p>").alias("jobDescription")).alias("jobPostingInfo")))
    details = numbered(spark, d).select("company", F.concat(F.lit("/job/"), "id").alias("path")).distinct().select(F.lit("workday").alias("source"), "company", "path", info.alias("body"))
    o = adapters.normalise(landing(spark, d, "workday"), "workday", details, PROFILE)
    return o.select(F.regexp_extract("url", r"/job/(.*)$", 1).alias("id"), "location", "work_mode").distinct()


@query(
    f"{N} SELECT DISTINCT company, trim(title) AS title, CASE WHEN location = 'Wrocław' THEN 'https://w/' ELSE 'https://x/' END || {_id} AS url, 'Sopot; ' || location || '; cała Polska' AS location, 'Hybrid' AS work_mode, 'B2B,Permanent' AS contracts, "
    "l_partkey || ' - ' || (l_partkey + 1) || ' PLN netto /h' AS salary FROM n"
)
def norm_pracuj(spark, d) -> DataFrame:
    """Pages with their data in a script, up to about 50 postings of a company each, with several places."""
    group = (
        "named_struct('jobTitle', title, 'companyName', company, 'offers', array(named_struct('displayWorkplace', 'Sopot', 'offerAbsoluteUri', concat('https://x/', id), 'isWholePoland', false), "
        "named_struct('displayWorkplace', location, 'offerAbsoluteUri', concat('https://w/', id), 'isWholePoland', true)), 'workModes', array('Praca stacjonarna', 'praca hybrydowa'), 'typesOfContract', array('Kontrakt B2B', 'Umowa o pracę'), "
        "'salaryDisplayText', concat(l_partkey, '–', l_partkey + 1, ' zł netto (+ VAT) / godz.'), 'expirationDate', '2024-03-01T00:00')"
    )
    paged = in_pages(numbered(spark, d)).groupBy("company", "seq").agg(F.expr(f"collect_list({group})").alias("g"))
    data = F.to_json(F.expr("named_struct('props', named_struct('list', array(named_struct('deep', named_struct('groupedOffers', g)))))"))
    pages = paged.select(F.lit("pracuj").alias("source"), F.lit("").alias("company"), "seq", F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>")).alias("body"))
    o = cards.read_pracuj(pages, PROFILE)
    return o.select("company", "title", "url", "location", "work_mode", F.array_join("contract_types", ",").alias("contracts"), "salary")


@query(
    f"SELECT 'Urząd ' || page_id AS company, 'Bolt inspektor – testów ' || page_id || ' (Dział IT)' AS title, CASE WHEN page_id % 2 = 0 THEN 'Wrocław' ELSE 'Opole' END AS location, CASE WHEN page_id % 3 = 0 THEN 'Hybrid' ELSE 'Office' END AS work_mode, "
    "'https://nabory.kprm.gov.pl/o/' || page_id AS url, (6000 + page_id) || ' PLN brutto' AS salary FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 100 ORDER BY page_id) AS n FROM pages) WHERE n <= 60"
)
def norm_nabory(spark, d) -> DataFrame:
    """Civil-service lists by phrase, with the page of each posting; up to 60 of a phrase, which is the source's feature."""
    pages = read(spark, d, "pages").select("page_id")
    card = "concat('<li class=\"row\"><a class=\"single\" href=\"/o/', page_id, '\"></a><strong class=\"title\">Bolt inspektor</strong><div class=\"r\"><span>Urząd:</span><b>Urząd ', page_id, '</b></div><div class=\"r\"><span>Dział:</span><b>Dział IT</b></div><div class=\"r\"><span>Miejscowość:</span><b>', CASE WHEN page_id % 2 = 0 THEN 'Wroclaw' ELSE 'Opole' END, '</b></div></li>')"
    lists = pages.select(F.lit("nabory_kprm").alias("source"), F.lit("").alias("company"), (F.col("page_id") % 100).cast("int").alias("phrase_no"), F.col("page_id").cast("int").alias("seq"), F.concat(F.lit("<ul class='lis'>"), F.expr(card), F.lit("</ul>")).alias("body"))
    html = "concat('<p class=\"job-title__position-matters\">Do spraw: testów ', page_id, '</p><div class=\"x__responsibilities\">', CASE WHEN page_id % 3 = 0 THEN 'praca hybrydowa' ELSE 'SQL' END, '</div><b class=\"info-circle__content--salary\">', 6000 + page_id, ' zł brutto</b>')"
    details = pages.select(F.concat(F.lit("https://nabory.kprm.gov.pl/o/"), "page_id").alias("url"), F.expr(html).alias("html"))
    return cards.nabory(lists, details, ["bolt"], PROFILE).select("company", "title", "location", "work_mode", "url", "salary")


_page = "concat('<h1>', title, '</h1><script type=\"application/ld+json\">', to_json(named_struct('@type', 'JobPosting', 'hiringOrganization', named_struct('name', concat('Org ', company)), 'description', CASE WHEN l_partkey % 3 = 0 THEN 'umowa o pracę, 9000 PLN brutto, SQL, praca hybrydowa, a text that is longer than its title' ELSE 'B2B 50 PLN/h, a text that is longer than its title' END)), '</script>')"


@query(
    f"{N} SELECT DISTINCT CASE WHEN l_partkey % 5 > 0 THEN company WHEN l_partkey % 4 > 0 THEN 'Org ' || company ELSE 'Nie podano' END AS company, trim(title) AS title, 'https://nofluffjobs.com/pl/job/' || {_id} AS url, "
    "CASE WHEN l_partkey % 4 > 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'Permanent' ELSE 'B2B' END ELSE '' END AS contracts, CASE WHEN l_partkey % 7 > 0 THEN l_partkey || ' PLN /h' WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN '9000 PLN brutto' ELSE '50 PLN /h' END AS salary, "
    "CASE WHEN l_partkey % 4 > 0 AND l_partkey % 3 = 0 THEN 'SQL' ELSE '' END AS skills FROM n"
)
def nofluffjobs_pages(spark, d) -> DataFrame:
    """Cards with the pages of their offers: some cards name no company or salary, some pages were not read."""
    from jobloom.sources.tables import CARD_HTML

    card = CARD_HTML["nofluffjobs"].replace("company, '</h4>", "CASE WHEN l_partkey % 5 > 0 THEN company ELSE '' END, '</h4>").replace("l_partkey, ' PLN / godz.", "CASE WHEN l_partkey % 7 > 0 THEN concat(l_partkey, ' PLN / godz.') ELSE '' END, '")
    rows = numbered(spark, d)
    lists = rows.select(F.lit("nofluffjobs").alias("source"), F.lit("x").alias("company"), F.col("l_orderkey").cast("int").alias("seq"), F.expr(card).alias("body"))
    pages = rows.select(F.concat(F.lit("https://nofluffjobs.com/pl/job/"), "id").alias("url"), F.expr("CASE WHEN l_partkey % 4 = 0 THEN 404 ELSE 200 END").alias("status"), F.expr(_page).alias("html"))
    o = cards.nofluffjobs_details(cards.read_cards(lists, "nofluffjobs", PROFILE), pages, cards.nofluffjobs_urls(lists))
    return o.select("company", "title", "url", F.array_join("contract_types", ",").alias("contracts"), "salary", F.array_join("skills", ",").alias("skills"))


@query(f"WITH {OFFERS} SELECT company, count(*)::BIGINT AS n FROM o GROUP BY 1")
def landing_scan(spark, d) -> DataFrame:
    """One source of a landing of two; where it is partitioned by source, the filter prunes."""
    landed = landing(spark, d, "greenhouse").unionByName(landing(spark, d, "lever"))
    own = landed.where("source = 'lever'").select("company", F.size(F.from_json("body", "array<struct<text:string>>")).alias("n"))
    return own.groupBy("company").agg(F.sum("n").alias("n"))


@query(f"{N} SELECT company, trim(title) AS title, url FROM n WHERE l_suppkey % 2 = 0")
def landing_partitions(spark, d) -> DataFrame:
    """Three landed sources of two days, of which a run asks for one day of one: the scan lists that directory only."""
    import uuid

    from jobloom.operators.store import shared_dir
    from jobloom.sources.landing import read_landing, write_landing

    path = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    for source in ("greenhouse", "recruitee", "capgemini"):
        landed = landing(spark, d, source)
        by_day = F.expr("CASE WHEN CAST(substring(split(company, ' ')[0], 10) AS INT) % 2 = 0 THEN '2024-02-02' ELSE '2024-02-01' END")
        write_landing(landed.withColumn("run_date", by_day), path)
    wanted = spark.createDataFrame([("greenhouse", "2024-02-02")], "source string, run_date string")
    o = adapters.normalise(read_landing(spark, path, wanted), "greenhouse", profile=PROFILE)
    return o.select("company", "title", "url")


_bolts = _keyword("title", ["bolt", "gear", "widget"])


@query(
    f"{N} SELECT DISTINCT {_id} AS id, CASE WHEN {_bolts} AND l_partkey % 4 > 0 THEN 'B2B' ELSE '' END AS contracts, CASE WHEN {_bolts} AND l_partkey % 4 > 0 THEN l_partkey || ' PLN /h' ELSE '' END AS salary, "
    f"CASE WHEN {_bolts} AND l_partkey % 4 > 0 THEN 'SQL,Jira' ELSE '' END AS skills FROM n"
)
def smartrecruiters_details(spark, d) -> DataFrame:
    """Lists with the pages of their postings, in sections; of titles with a keyword only, and some pages are missing."""
    ad = "to_json(named_struct('jobAd', named_struct('sections', map('a', named_struct('text', '<p>Jira, B2B</p>'), 'b', named_struct('text', concat(l_partkey, ' PLN/h, SQL'))))))"
    rows = numbered(spark, d).where("l_partkey % 4 > 0")
    # a path's body is made of its part: one row a company and path is one row of all four, shuffled as the join needs it and before the body is made
    once = rows.select("company", F.col("id").alias("path"), "l_partkey").dropDuplicates(["company", "path"])
    details = once.select(F.lit("smartrecruiters").alias("source"), "company", "path", F.expr(ad).alias("body"))
    o = adapters.normalise(landing(spark, d, "smartrecruiters"), "smartrecruiters", details, PROFILE)
    return o.select(F.regexp_extract("url", r"([^/]*)$", 1).alias("id"), F.array_join("contract_types", ",").alias("contracts"), "salary", F.array_join("skills", ",").alias("skills")).distinct()


_read_page, _closed = "l_partkey % 4 > 0 AND l_partkey % 3 > 0", "l_partkey % 4 > 0 AND l_partkey % 3 = 0"


@query(
    f"{N} SELECT DISTINCT company, trim(title) AS title, 'https://www.linkedin.com/jobs/view/' || (1000000 + l_orderkey) || l_linenumber || l_partkey || l_suppkey AS url, CASE WHEN {_closed} THEN 'Zamknięta' ELSE '2024-01-05' END AS expires_in, "
    f"CASE WHEN {_read_page} THEN 'Hybrid' WHEN {_cities} THEN 'Nie podano' ELSE 'Remote' END AS work_mode, CASE WHEN {_read_page} THEN 'B2B' ELSE '' END AS contracts, CASE WHEN {_read_page} THEN l_partkey || ' PLN /h' ELSE '' END AS salary FROM n WHERE {_bolts}"
)
def linkedin_pages(spark, d) -> DataFrame:
    """Cards with the pages of their offers, of titles with a keyword: some are closed, some were not read."""
    url = "concat('https://www.linkedin.com/jobs/view/', 1000000 + l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    html = "CASE WHEN l_partkey % 3 = 0 THEN '<p>No longer accepting applications</p>' ELSE concat('<div class=\"show-more-less-html__markup\">B2B ', l_partkey, ' PLN/h, praca hybrydowa</div> 9 EUR/h') END"
    pages = numbered(spark, d).where("l_partkey % 4 > 0").select(F.expr(url).alias("url"), F.expr(html).alias("html")).distinct()
    o = cards.linkedin_details(cards.read_cards(card_landing(spark, d, "linkedin"), "linkedin", PROFILE), pages, list(PROFILE.include))
    return o.select("company", "title", "url", "expires_in", "work_mode", F.array_join("contract_types", ",").alias("contracts"), "salary")
