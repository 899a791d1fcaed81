"""Tables of offers, tracker snapshots and landed responses that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What tells rows apart, in order.
SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")

#: The offers, the same text for Spark and DuckDB.
OFFERS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
  concat(s_name, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN ' Poland' ELSE ' Polska Sp. z o.o.' END) AS company,
  concat(p_name, CASE WHEN l_linenumber % 2 = 0 THEN ' (f/m/x) [Remote]' ELSE '' END) AS title,
  CASE s_nationkey % 5 WHEN 0 THEN 'Wrocław' WHEN 1 THEN 'Warszawa, Poland' WHEN 2 THEN 'Bangalore, India' WHEN 3 THEN 'Remote - EMEA' ELSE 'Nie podano' END AS location,
  CASE l_returnflag WHEN 'A' THEN 'Remote' WHEN 'N' THEN 'Hybrid' ELSE 'Office' END AS work_mode,
  CASE l_linestatus WHEN 'O' THEN 'B2B' ELSE 'Permanent' END AS contract,
  CASE WHEN l_tax = 0 THEN '' WHEN l_linestatus = 'O' THEN concat(CAST(floor(l_extendedprice / 500) AS BIGINT), ' PLN /h')
       ELSE concat(CAST(floor(l_extendedprice / 5) AS BIGINT), ' PLN brutto /month') END AS salary,
  concat('https://example.com/job/', l_orderkey, '/', l_partkey, '?utm=', l_linenumber) AS url,
  concat('src', l_suppkey % 5) AS source
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers from line items, parts and suppliers; contract_types and skills as arrays."""
    tables = {t: read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier")}
    text = OFFERS_SQL
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    made = spark.sql(text, **tables)
    return made.withColumn("contract_types", F.array("contract")).withColumn("skills", F.array().cast("array<string>"))


#: Two snapshots of a tracker from the events, the same text for Spark and DuckDB.
TRACKER_SQL = """
SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' AS before,
  concat(user_id, '/', event_type) AS key, concat('https://example.com/', user_id, '/', event_type, '/', event_id % 7) AS link,
  CASE event_type WHEN 'click' THEN 'Nowa' WHEN 'view' THEN 'Obejrzana' WHEN 'signup' THEN 'CV wysłane' WHEN 'purchase' THEN 'Rozmowa' ELSE 'Odrzucona' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'Nie' ELSE 'Tak' END AS active, concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0')) AS first_seen,
  concat('list', user_id % 3) AS list_name
FROM events
"""


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKER_SQL.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))


#: How each JSON board shapes a job, and the list of jobs.
JOBS = {
    "greenhouse": "named_struct('title', title, 'absolute_url', url, 'location', named_struct('name', location), 'content', concat('<p>', title, '</p>'))",
    "lever": "named_struct('text', title, 'hostedUrl', url, 'categories', named_struct('location', location, 'allLocations', CASE l_partkey % 3 WHEN 0 THEN array(location, '', 'Opole') WHEN 1 THEN cast(array() AS array<string>) END, 'commitment', 'B2B'), "
    "'workplaceType', element_at(array('hybrid', 'Remote', 'on-site', cast(null AS string)), cast(l_partkey % 4 + 1 AS int)), 'descriptionPlain', CASE WHEN l_partkey % 2 = 0 THEN 'umowa o pracę' END, "
    "'salaryRange', CASE l_orderkey % 5 WHEN 0 THEN named_struct('min', '100', 'max', cast(null AS string), 'currency', 'PLN', 'interval', 'per-hour-wage') WHEN 1 THEN named_struct('min', '12.5', 'max', '20.25', 'currency', 'EUR', 'interval', 'other') "
    "WHEN 2 THEN named_struct('min', '1', 'max', '2', 'currency', cast(null AS string), 'interval', 'x') WHEN 3 THEN named_struct('min', cast(l_orderkey AS string), 'max', cast(l_orderkey + 1 AS string), 'currency', 'PLN', 'interval', 'per-month-salary') END)",
    "smartrecruiters": "named_struct('id', id, 'name', title, 'location', named_struct('city', location, 'remote', true))",
    "workable": "named_struct('title', title, 'url', CASE WHEN l_partkey % 4 = 0 THEN '' ELSE url END, 'shortlink', concat('https://w.co/', id), 'city', location, 'country', CASE WHEN l_partkey % 2 = 0 THEN 'Polska' END, "
    "'locations', CASE l_partkey % 3 WHEN 0 THEN array(named_struct('city', location, 'country', ''), named_struct('city', '', 'country', 'Polska')) WHEN 1 THEN cast(array() AS array<struct<city:string,country:string>>) END, "
    "'telecommuting', l_partkey % 5 = 0, 'employment_type', CASE WHEN l_partkey % 7 > 0 THEN 'B2B' END)",
    "recruitee": "named_struct('title', title, 'careers_url', url, 'city', CASE WHEN l_partkey % 4 = 0 THEN '' ELSE location END, 'country', CASE l_partkey % 3 WHEN 0 THEN 'Poland' WHEN 1 THEN '' END, 'description', cast(null AS string), "
    "'requirements', concat('B2B ', l_partkey, ' PLN/h'), 'hybrid', l_partkey % 5 > 1, 'remote', l_partkey % 5 = 0, 'employment_type_code', CASE WHEN l_partkey % 7 = 0 THEN 'permanent' END)",
    "ashby": "named_struct('title', title, 'jobUrl', url, 'location', CASE WHEN l_partkey % 4 = 0 THEN cast(null AS string) ELSE location END, 'secondaryLocations', CASE l_partkey % 3 WHEN 0 THEN array(named_struct('location', 'Opole'), named_struct('location', '')) WHEN 1 THEN cast(array() AS array<struct<location:string>>) END, "
    "'isRemote', CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END, 'workplaceType', element_at(array('OnSite', 'Hybrid', 'Remote', cast(null AS string)), cast(l_partkey % 7 % 4 + 1 AS int)), 'compensation', CASE WHEN l_partkey % 2 = 0 THEN named_struct('compensationTierSummary', salary) END)",
    "oracle_hcm": "named_struct('Id', id, 'Title', title, 'PrimaryLocation', location, 'secondaryLocations', array(named_struct('Name', location), named_struct('Name', 'Opole')), 'WorkplaceType', 'Hybrid work')",
    "capgemini": "named_struct('title', title, 'apply_job_url', CASE WHEN l_partkey % 10 = 0 THEN '' ELSE url END, 'location', CASE WHEN l_partkey % 7 = 0 THEN cast(null AS string) ELSE location END, 'contract_type', 'permanent')",
    "phenom": "named_struct('title', title, 'jobId', id, 'multi_location', CASE l_partkey % 3 WHEN 0 THEN array(location, '', 'Opole') WHEN 1 THEN cast(array() AS array<string>) END, 'location', concat(location, ' HQ'), 'descriptionTeaser', 'SQL', 'ml_skills', array('Jira'))",
    "nabory_api": "named_struct('jobPosition', title, 'fullPagePath', url, 'voivodeship', location, 'submissionDeadline', CASE WHEN l_partkey % 5 = 0 THEN '2024-01-01' WHEN l_partkey % 5 = 1 THEN cast(null AS string) ELSE '2024-03-01' END, 'intro', CASE WHEN l_partkey % 3 = 0 THEN 'Praca we Wrocławiu: Wroclaw' ELSE '' END, 'employmentForm', 'umowa o pracę', 'subjectName', company)",
    "workday": "named_struct('title', title, 'externalPath', concat('/job/', id), 'locationsText', location, 'remoteType', 'Partially remote')",
    "traffit": "named_struct('url', url, 'advert', named_struct('name', title, 'values', array(named_struct('field_id', 'geolocation', 'value', to_json(named_struct('locality', location, 'country', 'Polska'))), named_struct('field_id', 'description', 'value', 'SQL'))), 'options', named_struct('remote', 'hybrid', 'jobType', 'B2B'))",
    "epam": "named_struct('name', title, 'seo', named_struct('url', concat('/job/', id)), 'city', array(named_struct('name', location), named_struct('name', location)), 'country', named_struct('name', 'Poland'), 'vacancy_type', 'Remote')",
}
BODIES = {
    "greenhouse": "named_struct('jobs', jobs)", "lever": "jobs", "smartrecruiters": "named_struct('content', jobs)", "workable": "named_struct('jobs', jobs)", "recruitee": "named_struct('offers', jobs)",
    "ashby": "named_struct('jobs', jobs)", "oracle_hcm": "named_struct('items', array(named_struct('requisitionList', jobs)))", "capgemini": "named_struct('data', jobs)",
    "phenom": "named_struct('refineSearch', named_struct('data', named_struct('jobs', jobs)))", "nabory_api": "named_struct('content', jobs)", "workday": "named_struct('jobPostings', jobs)", "traffit": "jobs",
    "epam": "named_struct('data', named_struct('jobs', jobs))",
}
KEYS = {"smartrecruiters": "acme", "oracle_hcm": "eg.oraclecloud.com/CX_1", "phenom": "https://careers.x.com/pl/en", "workday": "t.wd3.myworkdayjobs.com/Site"}



#: What an offer's numbers make: its id, and the url of OFFERS_SQL.
KEYS_OF_OFFER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
MADE_OF_KEYS = {"id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "url": "concat('https://example.com/job/', l_orderkey, '/', l_partkey, '?utm=', l_linenumber)"}


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).select(*KEYS_OF_OFFER, "company", "title", "url", "location", "salary")
    return o.withColumn("id", F.expr(MADE_OF_KEYS["id"]))


def in_pages(rows: DataFrame) -> DataFrame:
    """Numbered offers with seq: the number of their response among those of their company, of up to about 50 offers each, however many there are. Id and
    url are made again behind the shuffle, which carries their numbers; rows of the same numbers are ordered by their salary, if there is one."""
    of_company = Window.partitionBy("company").orderBy(*KEYS_OF_OFFER, *[c for c in ("salary",) if c in rows.columns])
    made = rows.drop(*MADE_OF_KEYS).withColumn("seq", (F.row_number().over(of_company) / 50).cast("int"))
    return made.withColumns({c: F.expr(e) for c, e in MADE_OF_KEYS.items() if c in rows.columns})


def landing(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Offers wrapped in the shape of a board's response, one response for up to about 50 offers of a company, as boards page them."""
    rows = numbered(spark, sf_dir) if ", salary)" in JOBS[source] else numbered(spark, sf_dir).drop("salary")  # what no job shows orders none
    paged = in_pages(rows).groupBy("company", "seq").agg(F.expr(f"collect_list({JOBS[source]})").alias("jobs"))
    return paged.select(F.lit(source).alias("source"), "company", "seq", F.lit(KEYS.get(source, "")).alias("key"), F.lit("2024-02-01").alias("run_date"), F.expr(f"to_json({BODIES[source]})").alias("body"))


#: How each list of cards shows an offer.
CARD_HTML = {
    "teamtailor": "concat('<item><title>', title, '</title><link>', url, '</link><remoteStatus>hybrid</remoteStatus><tt:locations><tt:location><tt:city>', location, '</tt:city><tt:country>Polska</tt:country></tt:location><tt:location><tt:city>Opole</tt:city></tt:location></tt:locations><description>&lt;p&gt;B2B ', l_partkey, ' PLN/h&lt;/p&gt;</description></item>')",
    "successfactors": "concat('<tr><td><a class=\"jobTitle-link\" href=\"/job/', id, '\">', title, '</a></td><td><span class=\"jobLocation\">', location, '</span></td></tr>')",
    "erecruiter": "concat('<tr offerid=\"', id, '\"><td class=\"skk_positionName\">', title, '</td><td>x</td><td>', location, '</td></tr>')",
    # modes and contracts by row, in the portal's own names
    "justjoinit": "concat('<article><a class=\"offer-card\" href=\"/job-offer/', id, '\"></a><a class=\"offer_list_offer_title_link\">', title, '</a><object><img alt=\"', company, '\"></object><p>', company, '</p><p>', element_at(array('Hybrid', 'Remote or Hybrid', 'office, mobile', 'Any place'), cast(l_partkey % 4 + 1 AS int)), '</p><p>', location, '</p><b>', element_at(array('Contract', 'Permanent, Mandate contract', 'permanently'), cast(l_partkey % 3 + 1 AS int)), '</b><span>B2B ', l_partkey, ' PLN / h</span><i>7d left</i></article>')",
    "nofluffjobs": "concat('<a class=\"posting-list-item\" href=\"/pl/job/', id, '\"><h3>', title, ' NOWA</h3><h4 class=\"company-name\">', company, '</h4><span data-cy=\"salary ranges on the job offer listing\">', l_partkey, ' PLN / godz.</span><span data-cy=\"location on the job offer listing\">Hybrydowo, ', location, '</span></a>')",
    "rocketjobs": "concat('<article><a class=\"offer-card\" href=\"https://rocketjobs.pl/oferta-pracy/', id, '\"></a><h3>', title, '</h3><div><svg class=\"lucide-building\"></svg></div><p>', company, '</p><div><svg class=\"lucide-map-pin\"></svg></div><p>', location, '</p><span>Zdalnie, umowa zlecenie, ', l_partkey, ' PLN/h</span></article>')",
    "linkedin": "concat('<li><div class=\"job-search-card\"><a class=\"base-card__full-link\" href=\"https://pl.linkedin.com/jobs/view/x-at-y-', 1000000 + l_orderkey, l_linenumber, l_partkey, l_suppkey, '?trk=1\"></a><h3 class=\"base-search-card__title\">', title, '</h3><h4 class=\"base-search-card__subtitle\"><a>', company, '</a></h4><span class=\"job-search-card__location\">', location, '</span><time datetime=\"2024-01-05\"></time></div></li>')",
}


def card_landing(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Offers as cards of HTML pages (or items of a feed), one page for up to about 50 offers of a company."""
    paged = in_pages(numbered(spark, sf_dir).drop("salary")).groupBy("company", "seq").agg(F.array_join(F.expr(f"collect_list({CARD_HTML[source]})"), "").alias("b"))
    body = F.concat(F.lit("cb("), F.to_json(F.struct(F.col("b").alias("htm"))), F.lit(");")) if source == "erecruiter" else F.concat(F.lit("<html><body>"), "b", F.lit("</body></html>"))
    key = {"successfactors": "https://jobs.x.com", "erecruiter": "c0"}.get(source, "")
    return paged.select(F.lit(source).alias("source"), "company", "seq", F.lit(key).alias("key"), F.lit(True).alias("remote_only"), body.alias("body"))
