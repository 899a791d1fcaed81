"""All registered queries of the posting operators, with the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions import extract, language, text
from jobloom.operators import offers as O
from jobloom.operators import pages as P
from jobloom.operators import tracker as T
from jobloom.sources.tables import OFFERS_SQL, SEQ, TRACKER_SQL, offers, read, tracker

#: A profile in words of the test data.
PROFILE = O.Profile(include=("bolt", "gear", "widget"), automation_first=("red",), seniority=("old",), manual=("small",), general=("plate", "rod"))
ORDER = O.Order(SEQ)
TOP = 100  # a report's length, which is what these two queries are about

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


# The same folding for DuckDB, by its own functions.
def _fold(x: str) -> str:
    return f"replace(lower(strip_accents(replace(replace(coalesce({x}, ''), 'ł', 'l'), 'Ł', 'L'))), 'ß', 'ss')"


def _padded(x: str) -> str:
    return f"(' ' || regexp_replace({_fold(x)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ')"


def _keyword(x: str, keywords) -> str:
    marks = keywords  # in the SQL, keywords stand as they are looked for: folded, with single spaces
    return "(" + " OR ".join(f"contains({_padded(x)}, ' {m}{' ' if len(m) <= 3 else ''}')" for m in marks) + ")"


def _title(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({inner}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _core(x: str) -> str:
    tokens = f"list_filter(regexp_split_to_array({_fold(x)}, '[^a-z0-9]+'), lambda t: t <> '')"
    noise = "'sp','z','o','oo','s','a','sa','spolka','ograniczona','odpowiedzialnoscia','akcyjna','komandytowa','k','sk','polska','poland','pl','group','grupa','gmbh','inc','ltd','llc','plc','ag','bv','corp','corporation','co'"
    core = f"list_filter({tokens}, lambda t: t NOT IN ({noise}))"
    return f"array_to_string(CASE WHEN len({core}) > 0 THEN {core} ELSE {tokens} END, ' ')"


def _any(x: str, marks) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


def _marked(x: str, table) -> str:
    """Names whose marks occur, comma-joined."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(x, marks)} THEN '{name}' END" for name, marks in table) + "], lambda v: v IS NOT NULL), ',')"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all(replace(replace({x}, chr(160), ''), ' ', ''), '\\d+(?:[.,]\\d+)?'), lambda n: replace(n, ',', '.')::DOUBLE)"


ALLOWED = f"({_any(_fold('location'), ['wroclaw', 'breslau'])} OR work_mode = 'Remote')"
OFFERS = f"o AS ({OFFERS_SQL})"
_order = ", ".join(SEQ)
DEDUPED = f"""WITH {OFFERS}, k AS (SELECT *, {_core('company')} AS core, {_title('title')} AS norm_title FROM o),
d AS (SELECT *, row_number() OVER (PARTITION BY core, norm_title ORDER BY {ALLOWED}::INT DESC, (salary <> '')::INT DESC, (source <> 'LinkedIn')::INT DESC, {_order}) AS n FROM k)"""


# -- text ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_fold('text')}) AS folded FROM documents")
def fold_text(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.fold_text(F.col("text"))).alias("folded"))


@query(f"SELECT lang, count(*)::BIGINT AS n, count(*) FILTER ({_keyword('text', ['und', 'tion', 'qu'])})::BIGINT AS hits FROM documents GROUP BY lang")
def keyword_match(spark, d) -> DataFrame:
    hit = text.keyword_match(F.col("text"), ["und", "tion", "qu"])
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


@query(f"WITH {OFFERS} SELECT {_title('title')} AS norm_title, count(*)::BIGINT AS n FROM o GROUP BY 1")
def normalize_title(spark, d) -> DataFrame:
    return offers(spark, d).groupBy(text.normalize_title(F.col("title")).alias("norm_title")).agg(F.count("*").alias("n"))


@query(f"WITH {OFFERS} SELECT {_core('company')} AS core, count(*)::BIGINT AS n FROM o GROUP BY 1")
def company_core(spark, d) -> DataFrame:
    return offers(spark, d).groupBy(text.company_core(F.col("company")).alias("core")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def canonical_url(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.strip_url(F.col("url")).alias("url"))


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"  # the old names count without a semicolon
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _main(x: str) -> str:
    t = x
    for tag in ("script", "style", "noscript", "header", "footer", "nav", "form", "svg"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    parts = ", ".join(f"nullif(regexp_extract(t, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '')" for tag in ("main", "article", "body"))
    return f"(SELECT {_plain(f'regexp_replace(coalesce({parts}, t), ' + chr(39) + '(?s)<!--.*?-->' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} FROM (SELECT {t} AS t))"


@query(f"SELECT page_id, md5({_plain('html')}) AS digest FROM pages")
def html_text(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("digest"))


@query(f"SELECT page_id, md5({_main('html')}) AS digest FROM pages")
def page_main_text(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(text.page_main_text(F.col("html"))).alias("digest"))


# -- extraction --------------------------------------------------------------------------------------


def _mode(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(x, marks)} THEN '{mode}'" for mode, marks in extract.WORK_MODES) + " ELSE 'Nie podano' END"


@query(f"WITH {OFFERS} SELECT {_mode('lower(title || chr(32) || work_mode)')} AS mode, count(*)::BIGINT AS n FROM o GROUP BY 1")
def work_mode(spark, d) -> DataFrame:
    return offers(spark, d).groupBy(extract.work_mode(F.concat_ws(" ", "title", "work_mode")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"WITH {OFFERS} SELECT {_marked('lower(contract || chr(32) || title)', extract.CONTRACTS)} AS kinds, count(*)::BIGINT AS n FROM o GROUP BY 1")
def contracts(spark, d) -> DataFrame:
    kinds = F.array_join(extract.contracts(F.concat_ws(" ", "contract", "title")), ",")
    return offers(spark, d).groupBy(kinds.alias("kinds")).agg(F.count("*").alias("n"))


_skills = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){s}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{s}' END" for s in extract.SKILLS)


@query(f"SELECT doc_id, array_to_string(list_filter([{_skills}], lambda v: v IS NOT NULL), ',') AS skills FROM documents")
def extract_skills(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(extract.extract_skills(F.col("text")), ",").alias("skills"))


_cities = _marked(f"(' ' || regexp_replace({_fold('location')}, '[^a-z]+', ' ', 'g') || ' ')", [(n, [f" {v} " for v in vs]) for n, vs in extract.CITIES])


@query(f"WITH {OFFERS} SELECT {_cities} AS cities, count(*)::BIGINT AS n FROM o GROUP BY 1")
def extract_cities(spark, d) -> DataFrame:
    return offers(spark, d).groupBy(F.array_join(extract.extract_cities(F.col("location")), ",").alias("cities")).agg(F.count("*").alias("n"))


@query(f"WITH {OFFERS} SELECT source, count(*) FILTER (salary <> '')::BIGINT AS n, sum(list_max({_numbers('salary')})) AS total FROM o GROUP BY 1")
def salary_numbers(spark, d) -> DataFrame:
    return offers(spark, d).groupBy("source").agg(F.count_if(F.col("salary") != "").alias("n"), F.sum(F.array_max(extract.salary_numbers(F.col("salary")))).alias("total"))


# the texts are made so that the salary found is the one put in
@query(f"WITH {OFFERS} SELECT salary, salary AS found, count(*)::BIGINT AS n FROM o GROUP BY ALL")
def extract_salary(spark, d) -> DataFrame:
    said = F.concat_ws(" ", "title", "salary", F.lit("zdalnie"))
    return offers(spark, d).select("salary", extract.extract_salary(said).alias("found")).groupBy("salary", "found").agg(F.count("*").alias("n"))


@query(
    f"WITH {OFFERS} SELECT {_title('title')} AS norm_title, {_core('company')} AS core, {_keyword('title', ['bolt', 'gear'])} AS named, {_fold('location')} AS place, "
    f"salary AS found, count(*)::BIGINT AS n FROM o GROUP BY ALL"
)
def sql_functions(spark, d) -> DataFrame:
    """A query written in SQL, with the text functions under their names."""
    from jobloom.functions import sql

    sql.register(spark)
    return spark.sql(
        "SELECT normalize_title(title) AS norm_title, company_core(company) AS core, keyword_match(title, 'Bolt') OR keyword_match(title, 'gear') AS named, fold_text(location) AS place, "
        "extract_salary(concat_ws(' ', title, salary, 'zdalnie')) AS found, count(*) AS n FROM {o} GROUP BY ALL",
        o=offers(spark, d),
    )


_class = f"""CASE WHEN salary = '' THEN 'none' WHEN contract = 'B2B' AND m / (CASE WHEN contains(salary, '/h') THEN 1 ELSE 160 END) >= 110 THEN 'b2b_ok'
  WHEN contract = 'B2B' AND m / (CASE WHEN contains(salary, '/h') THEN 1 ELSE 160 END) >= 80 THEN 'b2b_consider' WHEN contract = 'B2B' THEN 'b2b_low'
  WHEN m >= 9000 THEN 'uop_ok' ELSE 'uop_low' END"""
CLASSED = f"c AS (SELECT *, {_class} AS salary_class FROM (SELECT *, list_max({_numbers('salary')}) AS m FROM o))"


@query(f"WITH {OFFERS}, {CLASSED} SELECT contract, salary_class, salary_class NOT IN ('b2b_low', 'uop_low') AS salary_ok, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def assess_salary(spark, d) -> DataFrame:
    return O.assess_salary(offers(spark, d), PROFILE).groupBy("contract", "salary_class", "salary_ok").agg(F.count("*").alias("n"))


@query(f"WITH {OFFERS} SELECT location, {_any(_fold('location'), ['wroclaw', 'breslau'])} AS near, count(*)::BIGINT AS n FROM o GROUP BY ALL")
def preferred_city(spark, d) -> DataFrame:
    return offers(spark, d).groupBy("location", O.preferred_city(F.col("location"), PROFILE).alias("near")).agg(F.count("*").alias("n"))


_cities_in = _any(f"(' ' || regexp_replace({_fold('location')}, '[^a-z]+', ' ', 'g') || ' ')", [f" {v} " for _, vs in extract.CITIES for v in vs])


@query(
    f"WITH {OFFERS} SELECT location, (location IN ('', 'Nie podano') OR {_any(_fold('location'), ['wroclaw', 'breslau'])} OR {_keyword('location', ['poland', 'polska', 'pl', 'pol'])} OR {_cities_in} "
    f"OR ({_keyword('location', ['europe', 'emea', 'anywhere', 'worldwide', 'global', 'cee'])} AND {_keyword('location', ['remote', 'zdalnie'])})) AS inside, count(*)::BIGINT AS n FROM o GROUP BY ALL"
)
def target_country(spark, d) -> DataFrame:
    return offers(spark, d).groupBy("location", O.target_country(F.col("location"), PROFILE).alias("inside")).agg(F.count("*").alias("n"))


# -- offers ------------------------------------------------------------------------------------------


@query(f"{DEDUPED} SELECT core, norm_title, company, title, location, work_mode, salary, url, source FROM d WHERE n = 1")
def dedupe_best(spark, d) -> DataFrame:
    return O.dedupe_best(offers(spark, d).drop("contract"), PROFILE, ORDER).select("core", "norm_title", "company", "title", "location", "work_mode", "salary", "url", "source")


def _url_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in SEQ)
    return f"WITH {OFFERS} SELECT url, company, title, salary FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY {order}) AS n FROM o) WHERE n = 1"


def _by_url(spark, d, last: bool) -> DataFrame:
    kept = offers(spark, d).withColumnRenamed("url", "full_url").withColumn("url", text.strip_url(F.col("full_url")))
    return O.url_dedupe(kept.select("url", "full_url", "company", "title", "salary", *SEQ), ORDER, last).select(F.col("full_url").alias("url"), "company", "title", "salary")


@query(_url_sql("ASC"))
def url_dedupe_first(spark, d) -> DataFrame:
    return _by_url(spark, d, False)


@query(_url_sql("DESC"))
def url_dedupe_last(spark, d) -> DataFrame:
    return _by_url(spark, d, True)


@query(
    f"WITH {OFFERS}, p AS (SELECT *, title AS phrase, l_partkey % 10 AS phrase_no FROM o), c AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY {_order}) AS n FROM p), "
    f"u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY phrase_no, {_order}) AS r FROM c WHERE n <= 60) SELECT phrase, url, company FROM u WHERE r = 1"
)
def phrase_cap(spark, d) -> DataFrame:
    rows = offers(spark, d).withColumn("phrase", F.col("title")).withColumn("phrase_no", F.col("l_partkey") % 10)
    return O.phrase_cap(rows.select("phrase", "phrase_no", "url", "company", *SEQ), 60, ORDER).select("phrase", "url", "company")


_UNION = f"WITH {OFFERS} SELECT url, source, substr(source, 4)::INTEGER AS source_rank, l_orderkey, l_linenumber FROM o"


@query(_UNION)
def union_sources(spark, d) -> DataFrame:
    """Offers of all sources, each with the rank of its source, which comes first in the order of input rows."""
    o = offers(spark, d)
    parts = [o.where(F.col("source") == f"src{k}") for k in range(5)]
    return O.union_sources(parts).select("url", "source", F.col("source_rank"), "l_orderkey", "l_linenumber")


@query(f"WITH {OFFERS} SELECT source, count(*)::BIGINT AS n FROM o GROUP BY 1")
def union_all_sources(spark, d) -> DataFrame:
    o = offers(spark, d)
    return O.union_sources([o.where(F.col("source").isin("src0", "src1", "src2")), o.where(~F.col("source").isin("src0", "src1", "src2"))]).groupBy("source").agg(F.count("*").alias("n"))


_manual, _general = _keyword("title", PROFILE.manual), _keyword("title", [*PROFILE.general, *PROFILE.include])
_near = _any(_fold("location"), ["wroclaw", "breslau"])
_score = f"""(CASE WHEN {_manual} THEN 6 ELSE 0 END + CASE WHEN {_general} THEN 3 ELSE 0 END + CASE WHEN work_mode = 'Remote' THEN 3 WHEN {_near} THEN 2 ELSE 0 END
  + CASE WHEN salary_class IN ('b2b_ok', 'uop_ok') THEN 2 WHEN salary_class = 'none' THEN 1 ELSE 0 END)"""
_reason = f"""CASE WHEN NOT {_keyword('title', PROFILE.include)} THEN 'title' WHEN {_keyword('title', PROFILE.automation_first)} AND NOT {_manual} THEN 'automation'
  WHEN {_keyword('title', PROFILE.seniority)} THEN 'seniority' WHEN NOT {ALLOWED} THEN 'location' WHEN salary_class IN ('b2b_low', 'uop_low') THEN 'salary' WHEN score < 1 THEN 'score' END"""
JUDGED = f"WITH {OFFERS}, {CLASSED}, s AS (SELECT *, {_score} AS score FROM c), j AS (SELECT *, {_reason} AS reason FROM s)"


@query(f"{JUDGED} SELECT url, company, title, coalesce(reason, 'kept') AS reason, score::INTEGER AS match_score FROM j")
def reject_cascade(spark, d) -> DataFrame:
    j = O.reject_cascade(offers(spark, d), PROFILE)
    return j.select("url", "company", "title", F.coalesce("reject_reason", F.lit("kept")).alias("reason"), "match_score")


@query(f"{JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM j GROUP BY 1")
def reject_counts(spark, d) -> DataFrame:
    return O.reject_counts(O.reject_cascade(offers(spark, d), PROFILE))


_reasons = f"array_to_string(list_filter([CASE WHEN {_manual} THEN 'testy manualne' END, CASE WHEN work_mode = 'Remote' THEN '100% remote' WHEN {_near} THEN 'Wrocław' END], lambda v: v IS NOT NULL), ',')"


@query(f"{JUDGED} SELECT score::INTEGER AS match_score, {_reasons} AS reasons, count(*)::BIGINT AS n FROM j GROUP BY ALL")
def score_offers(spark, d) -> DataFrame:
    s = O.score(O.assess_salary(offers(spark, d), PROFILE), PROFILE)
    return s.groupBy("match_score", F.array_join("match_reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"{JUDGED} SELECT url, title, score::INTEGER AS match_score FROM j WHERE reason IS NULL ORDER BY score DESC, (work_mode = 'Remote')::INT DESC, {_order} LIMIT {TOP}")
def topk_candidates(spark, d) -> DataFrame:
    return O.top(O.reject_cascade(offers(spark, d), PROFILE), TOP, ORDER).select("url", "title", "match_score")


# contracts go in every third row, so that their name for nothing is seen
_said = "CASE WHEN l_partkey % 3 = 0 THEN 'Nie podano' ELSE contract END"
_hour = "round_even(m / (CASE WHEN contains(salary, '/h') THEN 1 ELSE 160 END), 0)::BIGINT"
_assessed = f"""CASE salary_class WHEN 'none' THEN 'Brak widełek — pokaż ofertę' WHEN 'b2b_ok' THEN 'B2B ok (ok. ' || {_hour} || ' zł/h)'
  WHEN 'b2b_consider' THEN 'B2B do rozważenia (ok. ' || {_hour} || ' zł/h)' WHEN 'b2b_low' THEN 'B2B poniżej 80 zł/h'
  WHEN 'uop_ok' THEN 'UoP ok (do ' || replace(format('{{:,}}', round_even(m, 0)::BIGINT), ',', ' ') || ' zł brutto)' ELSE 'UoP poniżej 9 000 zł brutto' END"""


@query(
    f"{JUDGED} SELECT CASE WHEN score >= 12 THEN '🟢 Aplikuj' ELSE '🟡 Warto rozważyć' END AS priority, company, title, location, work_mode, {_said} AS contracts, "
    "CASE WHEN salary = '' THEN 'Nie podano' ELSE salary END AS salary, greatest(1, least(10, round_even(score / 2, 0)::INTEGER))::VARCHAR || '/10' AS fit, "
    f"'brak danych w opisie' AS work_summary, {_assessed} AS salary_assessment, source, url FROM j WHERE reason IS NULL"
)
def report_row(spark, d) -> DataFrame:
    kept = O.reject_cascade(offers(spark, d), PROFILE).where("reject_reason is null")
    return O.report_row(kept.withColumn("contract_types", F.expr("CASE WHEN l_partkey % 3 = 0 THEN array() ELSE contract_types END")))


@query(f"{JUDGED} SELECT salary, salary_class, {_assessed} AS salary_assessment, count(*)::BIGINT AS n FROM j GROUP BY ALL")
def salary_labels(spark, d) -> DataFrame:
    made = O.assess_salary(offers(spark, d), PROFILE)
    return made.groupBy("salary", "salary_class", "salary_assessment").agg(F.count("*").alias("n"))


# titles that ask for languages, or are written in one, or only look like it
_ENDS = (
    (" with German", True), (" (Czech speaker)", True), (" und mit Bolt", True), (" pour les gears", True), (" Dutchman", True), (" redutch", False), (" mit Bolt", False), (" Polish", False), ("", False),
)
_ended = "concat(title, CASE l_partkey % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_ENDS)) + " END)"
_foreign = "l_partkey % 9 IN (" + ", ".join(str(i) for i, (_, asks) in enumerate(_ENDS) if asks) + ")"
_named_titles = f"{JUDGED.replace('FROM o)', 'FROM (SELECT * REPLACE (' + _ended + ' AS title) FROM o))')}"


@query(
    f"{_named_titles} SELECT l_orderkey, l_linenumber, l_partkey, title, CASE WHEN reason = 'title' THEN 'title' WHEN {_foreign} THEN 'language' ELSE coalesce(reason, 'kept') END AS reason FROM j"
)
def reject_languages(spark, d) -> DataFrame:
    """The cascade over titles that ask for languages in several ways."""
    j = O.reject_cascade(offers(spark, d).withColumn("title", F.expr(_ended)), PROFILE)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "title", F.coalesce("reject_reason", F.lit("kept")).alias("reason"))


_points = "CASE l_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END"


@query(f"{JUDGED} SELECT url, l_orderkey, l_linenumber, (score + {_points})::INTEGER AS match_score FROM j")
def skill_scores(spark, d) -> DataFrame:
    """Scores of offers whose skills differ from row to row, in either case, known and unknown, repeated."""
    skills = F.expr("CASE l_partkey % 5 WHEN 0 THEN array('SQL', 'sql') WHEN 1 THEN array('Java', 'sql', 'Jira') WHEN 2 THEN array('JIRA') WHEN 3 THEN array('Cobol') ELSE array() END")
    made = offers(spark, d).withColumn("skills", skills.cast("array<string>"))
    return O.score(O.assess_salary(made, PROFILE), PROFILE).select("url", "l_orderkey", "l_linenumber", "match_score")


@query(f"{JUDGED} SELECT source, reason, count(*)::BIGINT AS n FROM (SELECT source, coalesce(reason, 'kept') AS reason FROM j) GROUP BY ROLLUP (source, reason)")
def reject_rollup(spark, d) -> DataFrame:
    j = O.reject_cascade(offers(spark, d), PROFILE).select("source", F.coalesce("reject_reason", F.lit("kept")).alias("reason"))
    return j.rollup("source", "reason").agg(F.count("*").alias("n"))


# -- language and work profile -----------------------------------------------------------------------


def _written(lang: str, marks: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{m}'" for m in marks)
    hits = f"len(list_filter(w, lambda x: x IN ({listed})))"
    head = f"len(list_filter(list_distinct(h), lambda x: x IN ({listed})))"
    return f"CASE WHEN {head} >= 2 OR ({hits} >= 12 AND {hits}::DOUBLE / greatest(len(w), 1) >= 0.06) THEN '{lang}' END"


_langs = ", ".join(_written(k, v) for k, v in language.WRITTEN_IN)
WRITTEN = f"list_filter([{_langs}], lambda v: v IS NOT NULL)"


@query(
    f"SELECT doc_id, array_to_string({WRITTEN}, ',') AS languages FROM "
    f"(SELECT doc_id, regexp_extract_all({_fold('text')}, '[a-z]+') AS w, regexp_extract_all({_fold('source')}, '[a-z]+') AS h FROM documents)"
)
def written_in(spark, d) -> DataFrame:
    made = language.written_in(read(spark, d, "documents").select("doc_id", "source", "text"), "source", "text")
    return made.select("doc_id", F.array_join("languages", ",").alias("languages"))


@query(
    f"WITH {OFFERS}, w AS (SELECT regexp_replace(url, '[?#].*$', '') AS bare, url, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY {', '.join(c + ' DESC' for c in SEQ)}) AS n, "
    f"first_value(l_linenumber) OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY {_order}) AS first_line FROM o) SELECT bare, url, l_orderkey, l_linenumber, first_line FROM w WHERE n = 1"
)
def url_dedupe_places(spark, d) -> DataFrame:
    """The last offer of each URL, with the place of the first."""
    kept = offers(spark, d).withColumnRenamed("url", "full_url").withColumn("url", text.strip_url(F.col("full_url")))
    return O.url_dedupe(kept.select("url", "full_url", *SEQ), ORDER, True).select(F.col("url").alias("bare"), F.col("full_url").alias("url"), "l_orderkey", "l_linenumber", F.col("first_seq.l_linenumber").alias("first_line"))


# -- pages ---------------------------------------------------------------------------------------------

_status = "(CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END)"


def _pages(spark, d) -> DataFrame:
    return read(spark, d, "pages").withColumn("status", F.expr(_status))


@query(f"SELECT page_id, CASE {_status} WHEN 404 THEN 'outdated' WHEN 403 THEN 'blocked' WHEN 200 THEN 'ok' ELSE 'technical' END AS class FROM pages")
def response_class(spark, d) -> DataFrame:
    return _pages(spark, d).select("page_id", P.response_class(F.col("status")).alias("class"))


_FINAL = """CASE page_id % 8 WHEN 0 THEN 'https://example.com/' WHEN 1 THEN 'https://example.com/pl/' WHEN 2 THEN 'https://kariera.example.pl/' WHEN 3 THEN 'https://example.com/?q=1'
  WHEN 4 THEN 'https://example.com/strona-nie-istnieje' WHEN 5 THEN 'https://example.com/x/error' ELSE url END"""
_SOFT_HTML = "CASE WHEN page_id % 16 = 6 THEN replace(html, '<title>', '<title>Strona NIE istnieje ') ELSE html END"
_lower_path = "lower(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
_home = "regexp_full_match({0}, '/?(?:[a-z]{{2}}(?:[-_][a-z]{{2}})?/?)?')"
_host_words = "' ' || regexp_replace(replace(lower(regexp_extract(final, '^[a-zA-Z]+://([^/?#]*)', 1)), '.', ' '), '[^a-z0-9_]+', ' ', 'g') || ' '"


@query(
    f"SELECT page_id, CASE WHEN {_any('fp', ['404', 'not-found', 'notfound', 'nie-znalez', 'page-not-found', 'strona-nie-istnieje'])} THEN 'error path' "
    f"WHEN NOT {_home.format('rp')} AND {_home.format('fp')} AND regexp_extract(final, '[?]([^#]*)', 1) = '' AND NOT {_any(_host_words, [' kariera', ' karier', ' career', ' careers', ' jobs', ' praca', ' rekrutacja', ' work'])} THEN 'redirected home' "
    f"WHEN {_any(_fold('t'), ['404', 'page not found', 'nie znaleziono', 'strona nie istnieje', 'nie zostala znaleziona'])} THEN 'error title' END AS reason "
    f"FROM (SELECT page_id, final, {_lower_path.format('url')} AS rp, {_lower_path.format('final')} AS fp, regexp_extract(html[1:20000], '(?is)<title[^>]*>(.*?)</title>', 1) AS t "
    f"FROM (SELECT page_id, url, {_FINAL} AS final, {_SOFT_HTML} AS html FROM pages))"
)
def soft_404(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", P.soft_404(F.col("url"), F.expr(_FINAL), F.expr(_SOFT_HTML)).alias("reason"))


# Pages as offers of their own headings: every third with another title, every fourth confirmed, half of a portal; some closed, some of a portal's path.
_CHECKED = f"""SELECT page_id, concat(url, CASE WHEN page_id % 6 = 1 THEN ',oferta,' ELSE '' END) AS url, {_status} AS status,
  CASE WHEN page_id % 10 = 3 THEN concat(html, '<p>Offer expired</p>') ELSE html END AS html, page_id % 4 = 0 AS api_confirmed,
  CASE WHEN page_id % 2 = 0 THEN 'Strona kariery (test)' ELSE 'Pracuj.pl' END AS source FROM pages"""


def _page_offers(spark, d) -> tuple[DataFrame, DataFrame]:
    pages = spark.sql(_CHECKED.replace("FROM pages", "FROM {pages}"), pages=read(spark, d, "pages"))
    title = F.when(F.col("page_id") % 3 == 0, F.lit("quite another job")).otherwise(P.heading(F.col("html")))
    # a url that was fetched more than once counts as it was last, by page_id
    return pages.select("page_id", "url", title.alias("title"), "api_confirmed", "source"), pages.select("url", "status", "html", F.col("page_id").alias("place"))


def _inner(tag: str) -> str:
    return _plain(f"regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)")


_STOP = "'and','or','the','a','an','i','w','z','na','do','dla','m','k','f','mid','senior','junior','specialist','engineer','tester'"


def _telling(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda v: length(v) > 2 AND v NOT IN ({_STOP})))"


def _matches(a: str, b: str) -> str:
    shared = f"len(list_intersect({_telling(a)}, {_telling(b)}))"
    return f"({b} <> '' AND (contains({b}, {a}) OR contains({a}, {b}) OR (least(len({_telling(a)}), len({_telling(b)})) > 0 AND 2 * {shared} >= least(len({_telling(a)}), len({_telling(b)})))))"


VERIFIED = f"""c AS ({_CHECKED}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS n FROM c) WHERE n = 1),
o AS (SELECT page_id, url, api_confirmed, source, CASE WHEN page_id % 3 = 0 THEN 'quite another job' ELSE {_inner('h1')} END AS title FROM c),
j AS (SELECT o.*, l.status, {_title('o.title')} AS nt, {_title(_inner('h1'))} AS n1, {_title(_inner('title'))} AS n2, contains(lower(l.html), 'offer expired') AS closed FROM o JOIN l ON l.url = o.url),
v AS (SELECT page_id, CASE WHEN api_confirmed AND status IN (401, 403, 429) THEN 'confirmed, blocked' WHEN status <> 200 THEN 'status'
  WHEN source = 'Pracuj.pl' AND NOT contains(url, ',oferta,') AND NOT contains(url, '/job-offer/') THEN 'path' WHEN closed THEN 'closed' WHEN api_confirmed THEN 'confirmed'
  WHEN {_matches('nt', 'n1')} OR {_matches('nt', 'n2')} THEN 'title' ELSE 'other title' END AS reason FROM j)"""


@query(f"WITH {VERIFIED} SELECT page_id, reason, reason IN ('confirmed, blocked', 'confirmed', 'title') AS verified FROM v")
def verify_offers(spark, d) -> DataFrame:
    return P.verify_offers(*_page_offers(spark, d)).select("page_id", "reason", "verified")


_title_of = f"CASE WHEN page_id % 3 = 0 THEN 'quite another job' ELSE {_inner('h1')} END"
_read = f"""SELECT v.page_id, CASE WHEN v.reason IN ('confirmed', 'title', 'other title') AND contains(lower(m.t), lower(left(x.title, 40))) THEN m.t[1:8000] ELSE '' END AS d
  FROM v JOIN (SELECT page_id, url, {_title_of} AS title FROM c) AS x USING (page_id) JOIN (SELECT url, {_main('html')} AS t FROM l) AS m ON m.url = x.url"""


@query(f"WITH {VERIFIED}, r AS ({_read}) SELECT page_id, md5(CASE WHEN length(d) > 300 THEN d ELSE repeat('x', 300) END) AS digest FROM r")
def verified_descriptions(spark, d) -> DataFrame:
    """Of an offer's own description, here of 300 characters, and its page's, the longer."""
    made, pages = _page_offers(spark, d)
    return P.verify_offers(made.withColumn("description", F.lit("x" * 300)), pages).select("page_id", F.md5("description").alias("digest"))


@query(f"WITH {VERIFIED} SELECT reason, count(*)::BIGINT AS n, count(*) FILTER (reason IN ('confirmed, blocked', 'confirmed', 'title'))::BIGINT AS passed FROM v GROUP BY 1")
def verify_counts(spark, d) -> DataFrame:
    v = P.verify_offers(*_page_offers(spark, d))
    return v.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("verified").alias("passed"))


_ANCHOR = '(?is)<a[^>]*href="[^"]*"[^>]*>.*?</a>'


@query(
    f"WITH a AS (SELECT page_id, unnest(range(0, len(m))) AS place, unnest(m) AS x FROM (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}') AS m FROM pages)) "
    f"SELECT page_id, place::INTEGER AS place, regexp_extract(x, 'href=\"([^\"]*)\"', 1) AS href, {_plain('x')} AS text FROM a"
)
def page_links(spark, d) -> DataFrame:
    return P.links(read(spark, d, "pages"))


@query("SELECT host, count(*)::BIGINT AS n FROM (SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host FROM pages) GROUP BY 1")
def pages_by_host(spark, d) -> DataFrame:
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n"))


# Links to boards of every kind, by page, and what each must give.
_BOARD_LINKS = (
    ("https://boards.greenhouse.io/embed/job_board?for=acme{0}", "greenhouse", "acme{0}"), ("https://boards-api.eu.greenhouse.io/v1/boards/euro{0}/jobs", "greenhouse", "euro{0}"),
    ("HTTPS://JOBS.LEVER.CO/Board{0}/x", "lever", "Board{0}"), ("https://careers.smartrecruiters.com/Corp{0}", "smartrecruiters", "Corp{0}"), ("https://www.recruitee.com/x", None, None),
    ("https://firm{0}.wd3.myworkdayjobs.com/en-US/Careers{0}", "workday", "firm{0}.wd3.myworkdayjobs.com/Careers{0}"), ("https:\\/\\/apply.workable.com\\/work{0}\\/", "workable", "work{0}"),
    ("https://apply.workable.com/j/ABC", None, None), ("https://eg{0}.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_{0}/job/1", "oracle_hcm", "eg{0}.fa.em2.oraclecloud.com/CX_{0}"),
    ("https://team{0}.teamtailor.com/jobs", None, None), ("https://skk.erecruiter.pl/Offer.aspx?oid=1&amp;cfg=0123456789abcdef0123456789abcdef", "erecruiter", "0123456789abcdef0123456789abcdef"),
    ("https://example.com/job/{0}", None, None),
)
_link_of = "CASE page_id % 12 " + " ".join(f"WHEN {i} THEN concat('{u.split('{0}')[0]}'" + "".join(f", page_id % 9, '{x}'" for x in u.split("{0}")[1:]) + ")" for i, (u, _, _) in enumerate(_BOARD_LINKS)) + " END"
_found = [
    f"SELECT page_id, '{t}' AS type, concat('{k.split('{0}')[0]}'" + "".join(f", page_id % 9, '{x}'" for x in k.split("{0}")[1:]) + f") AS key FROM pages WHERE page_id % 12 = {i}" for i, (_, t, k) in enumerate(_BOARD_LINKS) if t
]


@query(" UNION ALL ".join(x for x in _found if "% 12 = 2" not in x))  # in a page, addresses are looked for in lower case
def boards_in_pages(spark, d) -> DataFrame:
    made = spark.sql("SELECT page_id, url, concat(html, '<a href=\"', " + _link_of.replace("\\", "\\\\") + ", '\">') AS html FROM {pages}", pages=read(spark, d, "pages"))
    return P.boards_in_pages(made)


@query(" UNION ALL ".join(_found))
def detect_board(spark, d) -> DataFrame:
    made = spark.sql("SELECT page_id, " + _link_of.replace("\\", "\\\\") + " AS link FROM {pages}", pages=read(spark, d, "pages"))
    b = made.select("page_id", P.detect_board(F.col("link")).alias("b")).where("b is not null and b.type <> 'teamtailor'")
    return b.select("page_id", "b.type", "b.key")


# one more board, by a rule in the table alone
_ADDED = (99, "own", "example.com", r"https?://example\.com/job/(\d+)", "job-$1", "$1", False)


@query(" UNION ALL ".join([*_found, "SELECT page_id, 'teamtailor' AS type, concat('team', page_id % 9) AS key FROM pages WHERE page_id % 12 = 9", "SELECT page_id, 'own', concat('job-', page_id % 9) FROM pages WHERE page_id % 12 = 11"]))
def detect_board_rules(spark, d) -> DataFrame:
    """Boards by rules in a table, with one rule added to it."""
    rules = P.board_rules(spark).union(spark.createDataFrame([_ADDED], P.BOARD_RULES))
    made = spark.sql("SELECT page_id, " + _link_of.replace("\\", "\\\\") + " AS url FROM {pages}", pages=read(spark, d, "pages"))
    return P.detect_boards(made, rules).where("type IS NOT NULL").select("page_id", "type", "key")


# -- tracker -------------------------------------------------------------------------------------------

TR = f"t AS ({TRACKER_SQL.replace('STRING', 'VARCHAR')})"
_rank = "CASE WHEN status IN ('', 'Nowa') THEN 0 WHEN status = 'Obejrzana' THEN 1 ELSE 2 END"


@query(f"WITH {TR} SELECT key, status FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_rank} DESC, list_name, event_id) AS n FROM t WHERE {_rank} > 0) WHERE n = 1")
def shared_status(spark, d) -> DataFrame:
    return T.shared_status(tracker(spark, d), ["list_name", "event_id"])


_match = f"""WITH {TR}, p AS (SELECT * FROM t WHERE before), c AS (SELECT * FROM t WHERE NOT before),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY event_id DESC) AS n FROM p) WHERE n = 1),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM p) WHERE n = 1),
h AS (SELECT c.*, coalesce(bl.event_id, bk.event_id) AS hit FROM c LEFT JOIN bl ON bl.link = c.link LEFT JOIN bk ON bk.key = c.key),
m AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY event_id) AS claim FROM h)"""


def _matched(spark, d) -> tuple[DataFrame, DataFrame]:
    t = tracker(spark, d)
    previous, current = t.where("before"), t.where("not before").drop("status", "first_seen")
    return previous, T.match(previous, current, ["event_id"])


@query(
    f"{_match} SELECT m.event_id, CASE WHEN claim = 1 AND hit IS NOT NULL THEN p.status ELSE 'Nowa' END AS status, "
    "CASE WHEN claim = 1 AND hit IS NOT NULL THEN p.first_seen END AS prev_first_seen, NOT (claim = 1 AND hit IS NOT NULL) AS is_new FROM m LEFT JOIN p ON p.event_id = m.hit"
)
def tracker_match(spark, d) -> DataFrame:
    return _matched(spark, d)[1].select("event_id", "status", "prev_first_seen", "is_new")


@query(f"{_match} SELECT event_id, key, CASE WHEN list_name = 'list0' THEN 'Nie' ELSE active END AS active FROM p WHERE event_id NOT IN (SELECT hit FROM m WHERE hit IS NOT NULL)")
def tracker_gone(spark, d) -> DataFrame:
    previous, matched = _matched(spark, d)
    return T.gone(previous, matched, ["event_id"], F.col("list_name") == "list0").select("event_id", "key", "active")


# The fold, step by step over the rows of a key.
_step = f"""WITH RECURSIVE {TR}, r AS (SELECT *, {_rank} AS rk, (active = 'Tak')::INT AS a, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n, count(*) OVER (PARTITION BY key) AS c FROM t),
f AS (SELECT key, n, c, event_id, link, active, status, first_seen, list_name, before, rk, a FROM r WHERE n = 1 UNION ALL
  SELECT r.key, r.n, r.c, CASE WHEN w THEN r.event_id ELSE f.event_id END, CASE WHEN w THEN r.link ELSE f.link END, CASE WHEN w THEN r.active ELSE f.active END,
    CASE WHEN w AND f.rk > r.rk THEN f.status WHEN w THEN r.status WHEN r.rk > f.rk THEN r.status ELSE f.status END, least(f.first_seen, r.first_seen),
    CASE WHEN w THEN r.list_name ELSE f.list_name END, CASE WHEN w THEN r.before ELSE f.before END, greatest(f.rk, r.rk), greatest(f.a, r.a)
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1, LATERAL (SELECT r.a > f.a OR (r.a = f.a AND r.rk > f.rk) AS w))"""


@query(f"{_step} SELECT key, c::BIGINT AS n_rows, event_id, link, active, status, first_seen FROM f WHERE n = c")
def tracker_collapse(spark, d) -> DataFrame:
    return T.collapse(tracker(spark, d), ["event_id"]).select("key", "n_rows", "event_id", "link", "active", "status", "first_seen")


_tracker_order = f"(active = 'Tak') DESC, {_rank} = 2, list_position(['Nowa', 'Obejrzana', 'CV wysłane', 'Rozmowa', 'Odrzucona'], status), first_seen DESC, event_id"
_PLACED = f"WITH {TR} SELECT event_id, key, status, active, (row_number() OVER (ORDER BY {_tracker_order}) - 1)::BIGINT AS place FROM t"


@query(_PLACED)
def tracker_order(spark, d) -> DataFrame:
    """Every row with its place in the order."""
    return T.placed(tracker(spark, d), ["event_id"]).select("event_id", "key", "status", "active", "place")


@query(_PLACED)
def tracker_order_all(spark, d) -> DataFrame:
    return tracker_order(spark, d)


_section = f"CASE WHEN active <> 'Tak' THEN 'gone' WHEN {_rank} = 2 THEN 'done' ELSE 'active' END"


@query(
    f"WITH {TR} SELECT list_name, {_section} AS section, count(*)::BIGINT AS n, count(*) FILTER (active = 'Tak')::BIGINT AS n_active, "
    f"count(*) FILTER ({_section} = 'active' AND first_seen = '2024-01-09')::BIGINT AS n_new FROM t GROUP BY ALL"
)
def report_sections(spark, d) -> DataFrame:
    t = tracker(spark, d)
    active = T.sections(t).groupBy("list_name", "section").agg(F.count_if(F.col("active") == "Tak").alias("n_active"))
    return T.section_counts(t, "2024-01-09").join(active, ["list_name", "section"])


# rows of the second snapshot are new; every eleventh event is a problem of its list
_bad = "event_id % 11 = 0 AND list_name <> 'list1'"


@query(
    f"WITH {TR}, c AS (SELECT list_name, count(*) FILTER (NOT before)::BIGINT AS n_new, count(*) FILTER ({_bad})::BIGINT AS n_problems, count(*) FILTER (active = 'Tak')::BIGINT AS active, "
    "count(*)::BIGINT AS saved FROM t GROUP BY 1) SELECT *, (sum(n_new) OVER ())::BIGINT AS total_new, (sum(n_problems) OVER ())::BIGINT AS total_problems, (sum(n_new) OVER ()) > 0 OR (sum(n_problems) OVER ()) > 0 AS send FROM c"
)
def run_digest(spark, d) -> DataFrame:
    t = tracker(spark, d)
    lists = t.groupBy("list_name").agg(F.count_if(F.col("active") == "Tak").alias("active"), F.count("*").alias("saved"))
    return T.digest(lists, t.where(_bad), t.where("not before"))


@query(
    f"WITH {TR} SELECT list_name, 'new' AS part, key || ' – ' || status || ' (' || active || ', )' AS line, link FROM t WHERE NOT before "
    f"UNION ALL SELECT list_name, 'problem', list_name || ': bad ' || event_id, '' FROM t WHERE {_bad}"
)
def digest_rows(spark, d) -> DataFrame:
    t = tracker(spark, d)
    news = t.where("not before").select("list_name", F.col("key").alias("company"), F.col("status").alias("title"), F.col("active").alias("location"), F.lit(None).cast("string").alias("work_mode"), "link")
    return T.digest_rows(news, t.where(_bad).select("list_name", F.expr("concat('bad ', event_id)").alias("problem")))


@query(f"WITH {TR}, a AS (SELECT * FROM t WHERE list_name = 'list1') SELECT list_name, count(*)::BIGINT AS n FROM (SELECT list_name FROM a UNION ALL SELECT list_name FROM t WHERE list_name <> 'list1') GROUP BY 1")
def seed_if_empty(spark, d) -> DataFrame:
    t = tracker(spark, d)
    return T.seed_if_empty(t.where("list_name = 'list1'"), t).groupBy("list_name").agg(F.count("*").alias("n"))


def queries() -> dict:
    from jobloom.plans import more, sources  # they register theirs here

    assert more and sources
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
