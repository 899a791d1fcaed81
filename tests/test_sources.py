import json

import pytest
from pyspark.sql import functions as F

from jobloom.sources import adapters, cards, registry


def test_registry(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"companies": [
        {"name": "Acme", "careers_url": "u", "category": "IT", "priority": "s", "ats": [{"url": "a", "type": "lever"}]},
        {"name": "Beta", "careers_url": "u", "ats": {"url": "b"}}, {"name": "Gone", "careers_url": "u", "enabled": False, "ats": "c"},
    ]}))
    r = registry.load_registry(spark, str(path))
    got = {x["name"]: (x["categories"], x["priority"], [tuple(a) for a in x["ats"]]) for x in r.collect()}
    assert got == {"Acme": (["IT"], "S", [("a", "lever")]), "Beta": (["Other"], "B", [("b", "")]), "Gone": (["Other"], "B", [("c", "")])}
    assert [x["name"] for x in registry.select_companies(r, names=["ACM"]).collect()] == ["Acme"]
    assert [x["name"] for x in registry.select_companies(r, tiers=["B"]).collect()] == ["Beta"]
    assert [x["name"] for x in registry.select_companies(r, categories=["IT"]).collect()] == ["Acme"]


def test_nulls_and_bad_bodies(spark):
    body = json.dumps({"offers": [{"title": "QA", "careers_url": "u", "city": "Łódź", "country": None, "description": None, "requirements": "B2B, 100 PLN/h", "remote": None}]})
    landing = spark.createDataFrame([("recruitee", "Acme", body), ("recruitee", "Acme", "not json"), ("other", "x", "{}")], "source string, company string, body string")
    got = adapters.normalise(landing, "recruitee").collect()
    assert len(got) == 1
    assert (got[0]["location"], got[0]["contract_types"], got[0]["salary"], got[0]["work_mode"]) == ("Łódź", ["B2B"], "100 PLN /h", "Nie podano")


def test_cards(spark):
    html = '<div class="c"><a class="t">QA</a><i>Acme</i></div><div class="c"><b>Dev</b></div>'
    rules = [("title", '(?s)<a class="t">(.*?)</a>'), ("title", "(?s)<b>(.*?)</b>"), ("company", "(?s)<i>(.*?)</i>")]
    got = adapters.extract_cards(spark.createDataFrame([(1, html)], "page_id int, html string"), rules, '(?s)<div class="c">.*?</div>')
    assert [(r["title"], r["company"]) for r in got.orderBy("place").collect()] == [("QA", "Acme"), ("Dev", "")]


def test_long_descriptions_are_read_whole(spark):
    from jobloom.functions.extract import SKILLS

    body = json.dumps({"offers": [{"title": "QA", "careers_url": "u", "city": "Opole", "description": "x " * 4500, "requirements": f"B2B, 100 PLN/h, {SKILLS[0]}"}]})
    landing = spark.createDataFrame([("recruitee", "Acme", body)], "source string, company string, body string")
    got = adapters.normalise(landing, "recruitee").first()
    assert (got["contract_types"], got["salary"], len(got["description"])) == (["B2B"], "100 PLN /h", 8000)
    assert SKILLS[0] in got["skills"]


def test_registry_lists_and_bad_boards(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"name": "Łódź Soft", "careers_url": "u", "categories": []}]))
    r = registry.load_registry(spark, str(path))
    assert [(x["name"], x["categories"]) for x in r.collect()] == [("Łódź Soft", ["Other"])]
    assert registry.select_companies(r, names=["lodz"]).count() == 1
    path.write_text(json.dumps({"companies": [{"name": "A", "careers_url": "u", "ats": {"type": "lever"}}]}))
    with pytest.raises(Exception, match="bad registry entry"):
        registry.load_registry(spark, str(path)).collect()


def test_pracuj_salary_and_linkedin_details(spark):
    df = spark.createDataFrame([("130–160 zł netto (+ VAT) / godz.",), ("9 000 zł brutto / mies.",), ("",), (None,)], "t string")
    assert [r["s"] for r in df.select(cards.pracuj_salary(F.col("t")).alias("s")).collect()] == ["130 - 160 PLN netto /h", "9 000 PLN brutto /month", "", ""]
    offers = spark.createDataFrame([("u1", "QA"), ("u2", "QA"), ("u3", "QA"), ("u4", "Cook")], "url string, title string")
    empty = F.array().cast("array<string>")
    offers = offers.withColumns({"expires_in": F.lit("x"), "description": F.lit(""), "work_mode": F.lit("Nie podano"), "contract_types": empty, "salary": F.lit(""), "skills": empty})
    pages = spark.createDataFrame([("u1", '<div class="show-more-less-html__markup">B2B, hybrid, SQL</div> 80 000 PLN'), ("u2", "No longer accepting applications")], "url string, html string")
    got = {r["url"]: (r["expires_in"], r["work_mode"], r["contract_types"], r["salary"], r["skills"]) for r in cards.linkedin_details(offers, pages, ["qa"]).collect()}
    assert got == {"u1": ("x", "Hybrid", ["B2B"], "", ["SQL"]), "u2": ("Zamknięta", "Nie podano", [], "", []), "u3": ("x", "Nie podano", [], "", [])}
