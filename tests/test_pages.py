"""Nesting of tags, entities, depth of embedded postings, pages that repeat."""

import html
import json
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from jobloom.functions import dom, jsonld
from jobloom.functions import text as X
from jobloom.operators import pages as P
from jobloom.operators.offers import Profile


class Main(HTMLParser):
    """Text of main by the standard library's parser, for pages whose tags all end."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.text = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, any(k in ("class", "id") and "cookie" in (v or "") for k, v in attrs)))

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if any(t == "main" for t, _ in self.open) and not any(t in dom.NO_CONTENT or bad for t, bad in self.open):
            self.text.append(data)


def tree(rng, depth=0):
    """A random fragment of nested elements that all end."""
    parts = []
    for _ in range(rng.randint(1, 4)):
        if depth > 5 or rng.random() < 0.4:
            parts.append(rng.choice(["text", "a &amp; b", "x > y", "<!-- <div> note -->", " "]))
        else:
            tag = rng.choice(["div", "div", "section", "span", "nav", "script"])
            inner = "if (a < b) '<div>'" if tag == "script" else tree(rng, depth + 1)
            parts.append(f"<{tag}{rng.choice(['', ' class=\"cookie\"', ' id=z'])}>{inner}</{tag}>")
    return " ".join(parts)


def test_main_text_of_nested_pages(spark):
    rng = random.Random(3)
    pages = [f"<html><body><div>{tree(rng)}</div><main><div>{tree(rng)}</div></main></body></html>" for _ in range(200)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", X.page_main_text(F.col("h")).alias("t")).collect()}
    for i, p in enumerate(pages):
        m = Main()
        m.feed(p)
        assert got[i].split() == " ".join(m.text).split()


def test_main_text_of_broken_pages(spark):
    cases = {
        None: "", "": "", "plain": "plain", "<div><main>a<div>b": "a b", "</div></p>x": "x", "<main><li>a<ul><li>b</ul>c<li>d</main>e": "a b c d",
        "<nav>x": "", "<p>a</nav>b": "a b", "<article>two</article><article>three</article>": "two", "<main><script>var a='</main>'</script>ok</main>": "ok",
        "<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000: "deep", "<!-- open <b>": "", "a < b <i": "a < b <i",
    }
    rows = [(i, k) for i, k in enumerate(cases)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, h string").select("i", X.page_main_text(F.col("h")).alias("t")).collect()}
    assert [got[i] for i, _ in rows] == list(cases.values())


def test_links_in_nested_cards(spark):
    h = "<div><ul><li><h3>Tester</h3><ul><li>one</li><li>two</li></ul><a href='/jobs/1'>read more</a></li><li><a href=/jobs/2 title=Lead><img></a></li></ul><a name=x>none</a></div>"
    a = P.anchors(spark.createDataFrame([(1, "https://x.pl/", h), (2, None, None)], "page_id int, url string, html string")).orderBy("place").collect()
    assert [(r["href"], r["title"], r["context"]) for r in a] == [("https://x.pl/jobs/1", "Tester", "Tester one two read more none"), ("https://x.pl/jobs/2", "Lead", "Tester one two read more none")]


def test_many_links(spark):
    """Rows carry their own parts only: a page of two thousand links stays small."""
    h = "<ul>" + "".join(f"<li><h4>T{i}</h4>{'w ' * 150}<a href='/j/{i}'>more</a></li>" for i in range(2000)) + "</ul>"
    a = P.anchors(spark.createDataFrame([(1, "https://x.pl/", h)], "page_id int, url string, html string")).collect()
    assert len(a) == 2000 and all(r["title"] == f"T{r['place']}" and len(r["context"]) < 400 for r in a)


def test_entities(spark):
    rng = random.Random(1)
    cases = ["".join(rng.choice(["&", "amp", "lt", ";", "#", "x", "6", "5", " ", "é", "not", "in", "Auml", "\n"]) for _ in range(12)) for _ in range(1000)]
    cases += ["&euro;&eacute;&rsquo;&copy;", "&#150;&#xD800;&#0;&#99999999;", "&notit;", "&amp;lt;", "&CounterClockwiseContourIntegral;", "&#13;&#1;&#xFFFE;"]
    got = {r["i"]: r["u"] for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", X.unescape(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(cases))] == [html.unescape(c) for c in cases]


def test_postings_at_any_depth(spark):
    deep = {"@type": "JobPosting", "title": "deep"}
    for _ in range(20):
        deep = {"@graph": [{"x": 1}, {"item": [deep]}]}
    order = {"@graph": [{"@type": "JobPosting", "title": "a", "item": {"@type": ["JobPosting"], "title": "b"}}, {"@type": "JobPosting", "title": "c"}]}
    page = "".join(f'<script type="application/ld+json">{t}</script>' for t in (json.dumps(deep), "{broken", json.dumps(order), "[" * 50_000))
    got = jsonld.postings(spark.createDataFrame([(page,), (None,), ("",)], "html string")).select("postings").collect()
    assert [[json.loads(p)["title"] for p in r["postings"]] for r in got] == [["deep", "c", "a", "b"], [], []]
    nested = json.dumps({"a": [{"b": [[{"k": None}]]}, {"c": {"d": [{"k": {"v": 1}}]}}], "k2": 1})
    assert spark.createDataFrame([(nested,), (None,)], "t string").select(jsonld.first_value(F.col("t"), "k").alias("v")).collect()[0]["v"] == '{"v": 1}'


OFFERS = "url string, title string, api_confirmed boolean"


def test_pages_that_repeat_give_no_more_offers(spark):
    offers = spark.createDataFrame([("u", "QA Tester", False), ("v", "QA Tester", False), ("u", "QA Tester", False), (None, "QA", False)], OFFERS)
    rows = [("u", 200, "<h1>Other</h1>", 1), ("u", 200, "<h1>QA Tester</h1>", 2), ("u", 200, "<h1>QA Tester</h1>", 2), ("v", 404, "", None), ("v", 200, "<h1>QA Tester</h1>", None), ("w", 200, "x", 3)]
    pages = spark.createDataFrame(rows, "url string, status int, html string, place int")
    for p in (pages, pages.where("place is null or place = 2").drop("place"), pages.repartition(5)):
        got = sorted((str(r["url"]), r["reason"]) for r in P.verify_offers(offers, p).collect())
        assert got == [("None", "no page"), ("u", "title"), ("u", "title"), ("v", "status")]
    empty = F.array().cast("array<string>")
    full = offers.withColumns({"location": F.lit("Nie podano"), "work_mode": F.lit("Nie podano"), "contract_types": empty, "skills": empty, "salary": F.lit(""), "description": F.lit("")})
    assert P.enrich_offers(full, pages, Profile()).count() == 4


def test_pages_are_cut_before_they_are_read(spark):
    """The semi-join stands below the projection that reads HTML."""
    offers = spark.createDataFrame([("u", "QA", False)], OFFERS)
    pages = spark.createDataFrame([("u", 200, "<h1>x</h1>")], "url string, status int, html string")
    plan = P.verify_offers(offers, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all(coalesce(html") < plan.index("LeftSemi")  # what comes later in the text runs earlier
