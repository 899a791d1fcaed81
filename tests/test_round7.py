"""Tests of the findings of FINDINGS_r04.md."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text as X
from jobloom.functions.extract import SALARY
from jobloom.operators import offers as O
from jobloom.plans import catalogue
from jobloom.sources import cards, tables

# texts that were cut inside an entity, as pages quote them
CUT = ("token = &quot p{margin:0}", "a &quot", "&amp b &amp;quot; &ampquot; &amp", "&am &a & &quo; &copy &#39 &lt", "x &quot; y &copy;&middot;&nbsp;z&#39; &ampc;")


def test_entities_without_their_end(spark):
    """html_text puts back what ends in a semicolon, and amp; unescape reads all that HTML does."""
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(CUT)), "i int, h string").orderBy("i").select(X.html_text(F.col("h")).alias("t")).collect()]
    assert got == ["token = &quot p{margin:0}", "a &quot", '& b &quot; &quot; &', "&am &a & &quo; &copy &#39 &lt", "x \" y ©· z' &c;"]
    assert spark.createDataFrame([("a &quot b &copy",)], "h string").select(X.unescape(F.col("h")).alias("t")).first()["t"] == 'a " b ©'


@pytest.mark.parametrize("name", ["html_text", "page_main_text", "page_description", "verified_descriptions"])
def test_cut_entities_as_in_the_sql(spark, tmp_path, name):
    """Pages with such texts give the digests of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    words = " ".join(f"word{i}" for i in range(90))
    page = "<html><head><title>QA {0}</title></head><body><nav>n</nav><article><h1>QA {0}</h1><p>{1} {2}</p></article><footer>&copy; f</footer></body></html>"
    rows = [(i, f"https://x.pl/{i}", page.format(i, words, CUT[i % len(CUT)])) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_long_descriptions_are_read_to_their_end(spark):
    """What stands behind 8000 characters of a long text counts."""
    offer = ("u", "Tester", "A", "Wrocław", "Nie podano", "", [], [], "Pracuj.pl", "short", 5)
    schema = "url string, title string, company string, location string, work_mode string, salary string, contract_types array<string>, skills array<string>, source string, description string, match_score int"
    text = "x" * 9000 + " 100% remote. Fluent German is required."
    long = spark.createDataFrame([("u", text)], "url string, text string")
    judge = lambda most: O.analysis_cascade(spark.createDataFrame([offer], schema), O.Profile(), long, True, most).first()
    whole, cut = judge(None), judge(8000)
    assert (whole["description"], whole["work_mode"], whole["reject_reason"]) == (text, "Remote", "language")
    assert (cut["description"], cut["work_mode"], cut["reject_reason"]) == ("x" * 8000, "Nie podano", None)


def test_analysis_cascade_reads_whole_texts_as_its_sql(spark, tmp_path):
    """A document of few words and more than 8000 characters: query and SQL agree, and see its end."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, "y" * 8500 + " Fluent German is required." if i == 16 else "Selenium, Cypress and Playwright") for i in range(1, 17)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    made = catalogue.queries()["analysis_cascade"](spark, str(tmp_path))
    want = {r[0]: r for r in con.execute(catalogue.oracle_sql()["analysis_cascade"]).fetchall()}
    got = {r["doc_id"]: tuple(r) for r in made.collect()}
    assert got == want and got[16][1] == "language"


def test_shorter_ways_read_the_same(spark):
    """A field's text is that of html_text, and an amount that is taken whole is the one that was found by trying all its starts."""
    rng = random.Random(7)
    bits = ["a", "Wrocław", " ", "  ", "\t", "\x85", " ", "\xa0", "\x1f", "<b>", "&amp;", "&quot", ";", "1", "200", ",", ".", "-", "–", " do ", "PLN", "zł", "eur", "/h", " netto", "K", "ſ", "SQL", "New"]
    rows = [("".join(rng.choice(bits) for _ in range(14)),) for _ in range(4000)]
    old = SALARY.replace(r"(?<!\d)", "").replace("*+(?:-|–|do)", r"*\s*(?:-|–|do)").replace("*+(?:PLN", r"*\s*(?:PLN")
    t = F.col("t")
    made = spark.createDataFrame(rows, "t string").select(X.field_text(t).alias("a"), X.html_text(t).alias("b"), F.regexp_extract(t, SALARY, 0).alias("c"), F.regexp_extract(t, old, 0).alias("d"))
    got = made.collect()
    assert old != SALARY and all(r["a"] == r["b"] and r["c"] == r["d"] for r in got) and sum(r["c"] != "" for r in got) > 100


@pytest.mark.parametrize("source", ["justjoinit", "rocketjobs"])
def test_cards_are_read_before_they_are_shuffled(spark, source):
    """What the shuffle that drops copies carries is what was found, neither the card nor its text."""
    landed = spark.createDataFrame([(source, "", "", "")], "source string, company string, key string, body string")
    made = cards.read_cards(landed, source).select("company", "title", "url", "contract_types", "work_mode", "location", "salary", "skills")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and plan.index("Window [") < plan.index("PLN|EUR|USD|CHF")


def test_pages_carry_numbers(spark):
    """Id and url are made behind the window of in_pages; where no job shows the salary, nothing is ordered by it."""
    plan = tables.card_landing(spark, "/root/testdata/sf0.001", "justjoinit")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [") :]
    assert "https://example.com" not in below and "PLN /h" not in below and "concat_ws" not in below
    assert "PLN /h" in tables.landing(spark, "/root/testdata/sf0.001", "ashby")._jdf.queryExecution().optimizedPlan().toString()


def test_details_are_shuffled_once(spark):
    """Details are made distinct by what they are joined by, before their body is made."""
    plan = catalogue.queries()["smartrecruiters_details"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[company#\d+, path#\d+\]", plan) and not re.search(r"Aggregate \[[^\]]*body#", plan)


def test_cards_of_pages_are_read_once(spark):
    """The urls of pages come from the links of lists, which hold those of all cards."""
    body = '<a class="posting-list-item" href="/pl/job/x&amp;y"><h3>QA</h3></a><a href="https://a.pl/pl/job/z">no card</a><a class="posting-list-item" data-x=1 href=\'https://b.pl/pl/job/w\'><h3>QA</h3></a>'
    landed = spark.createDataFrame([("nofluffjobs", "", body), ("linkedin", "", body), ("nofluffjobs", "", None)], "source string, company string, body string")
    urls = sorted(r["url"] for r in cards.nofluffjobs_urls(landed).collect())
    assert urls == ["https://a.pl/pl/job/z", "https://b.pl/pl/job/w", "https://nofluffjobs.com/pl/job/x&y"] and {r["url"] for r in cards.read_cards(landed, "nofluffjobs").collect()} <= set(urls)
    plan = catalogue.queries()["nofluffjobs_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bposting-list-item\b") == 1
