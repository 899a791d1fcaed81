"""Pruning of landed directories, rules in a table, counts that come with the rows, languages and words in the cascade and the report."""

from pyspark.sql import functions as F

from jobloom.operators import offers as O
from jobloom.operators import pages as P
from jobloom.operators import tracker as T
from jobloom.sources import adapters, landing, registry

OFFER = "seq int, company string, title string, location string, work_mode string, contract_types array<string>, salary string, url string, source string, skills array<string>"


def offer(seq, title="QA Tester", salary="100 PLN/h", contracts=("B2B",), mode="Remote", company="Acme"):
    return (seq, company, title, "Opole", mode, list(contracts), salary, f"u{seq}", "src", [])


def test_landed_directories_are_pruned(spark, tmp_path):
    path = str(tmp_path / "landing")
    rows = [(f"c{i}", "", 0, i, f"body {i}", f"s{i % 3}", f"2024-01-0{i % 2 + 1}") for i in range(30)]
    landing.write_landing(spark.createDataFrame(rows, landing.SCHEMA), path)
    landing.write_landing(spark.createDataFrame([("new", "", 0, 0, "more", "s1", "2024-01-03")], landing.SCHEMA), path)
    fixed = landing.read_landing(spark, path).where("source = 's1' AND run_date = '2024-01-03'")
    assert len(fixed.inputFiles()) >= 1 and {r["company"] for r in fixed.collect()} == {"new"}
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan
    spark.createDataFrame([("s1", "2024-01-03"), ("s1", "2024-01-02"), ("gone", "x")], "source string, run_date string").write.parquet(str(tmp_path / "wanted"))
    wanted = spark.read.parquet(str(tmp_path / "wanted")).where("run_date <> '2024-01-02'")
    some = landing.read_landing(spark, path, wanted)
    assert {r["company"] for r in some.collect()} == {"new"}
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()


def test_board_rules_equal_the_chain(spark):
    urls = [
        "https://boards.greenhouse.io/acme", "https://boards.eu.greenhouse.io/embed/job_board?for=x-y", "https://jobs.lever.co/A.b/1", "https://www.recruitee.com/x", "https://acme.recruitee.com", None, "", "x",
        "https://firm.wd3.myworkdayjobs.com/en-US/Jobs", "https://firm.wd3.myworkdayjobs.com/wday/x", "https:\\/\\/apply.workable.com\\/w\\/", "https://apply.workable.com/j/A", "https://t.teamtailor.com/",
        "https://eg.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/2", "https://skk.erecruiter.pl/Offer.aspx?oid=1&amp;cfg=0123456789ABCDEF0123456789abcdef",
        "https://a.pl/?to=https://jobs.ashbyhq.com/Corp", "https://notgreenhouse.io/acme", "HTTPS://API.SMARTRECRUITERS.COM/v1/companies/C-1", "https://acme.traffit.com/public/x",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:2])], "i int, url string")
    want = {r["i"]: (r["b"]["type"], r["b"]["key"]) if r["b"] else (None, None) for r in df.select("i", P.detect_board(F.col("url")).alias("b")).collect()}
    got = {r["i"]: (r["type"], r["key"]) for r in P.detect_boards(df, P.board_rules(spark)).collect()}
    assert got == want and sum(t is not None for t, _ in got.values()) == 14


def test_counts_come_with_the_rows(spark):
    rows = [offer(0), offer(1, "Cook"), offer(2, salary="10 PLN/h"), offer(3, mode="Office"), offer(4, "QA Lead"), offer(5, "QA with German"), offer(6)]
    judged, seen = O.counted(O.reject_cascade(spark.createDataFrame(rows, OFFER), O.Profile()), most=1)
    kept = judged.where("reject_reason is null").collect()  # one job
    assert len(kept) == 2 and {k: v for k, v in seen.get.items() if v} == {"title": 1, "language": 1, "seniority": 1, "location": 1, "salary": 1, "kept": 2, "cut": 1}


def test_languages_of_titles_and_texts(spark):
    titles = ["QA with German", "QA (Czech speaker)", "QA Germanium", "QA und Test mit Plan", "QA preGerman", "QA", "QA"]
    texts = ["", "", "", "", "", "Fluent French is required.", "French would be a plus."]
    df = spark.createDataFrame([offer(i, t) for i, t in enumerate(titles)], OFFER)
    reasons = lambda d: {r["seq"]: r["reject_reason"] for r in O.reject_cascade(d, O.Profile()).collect()}
    assert reasons(df) == {0: "language", 1: "language", 2: "language", 3: "language", 4: None, 5: None, 6: None}
    described = df.withColumn("description", F.element_at(F.array(*map(F.lit, texts)), F.col("seq") + 1))
    assert reasons(described) == {0: "language", 1: "language", 2: "language", 3: "language", 4: None, 5: "language", 6: None}


def test_report_in_words(spark):
    rows = [offer(0, "Manual tester", "120 PLN/h"), offer(1, salary="", contracts=()), offer(2, salary="12 500 PLN brutto", contracts=("Permanent",)), offer(3, salary="85,5 PLN/h"), offer(4, salary="9 EUR")]
    made = O.report_row(O.score(O.assess_salary(spark.createDataFrame(rows, OFFER), O.Profile()), O.Profile()).orderBy("seq")).collect()
    assert [r["salary_assessment"] for r in made] == ["B2B ok (ok. 120 zł/h)", "Brak widełek — pokaż ofertę", "UoP ok (do 12 500 zł brutto)", "B2B do rozważenia (ok. 86 zł/h)", "Widełki w walucie obcej — do indywidualnej oceny"]
    assert [r["priority"] for r in made] == ["🟢 Aplikuj"] + ["🟡 Warto rozważyć"] * 4 and made[1]["contracts"] == "Nie podano" and made[1]["salary"] == "Nie podano"
    low = spark.createDataFrame([offer(0, salary="5 PLN/h"), offer(1, salary="5000 PLN", contracts=("Permanent",)), offer(2, salary="5 PLN", contracts=())], OFFER)
    assert [r["salary_assessment"] for r in O.assess_salary(low, O.Profile()).orderBy("seq").collect()] == ["B2B poniżej 80 zł/h", "UoP poniżej 9 000 zł brutto", "Nieznany typ umowy — pokaż ofertę"]
    scored = O.score(O.assess_salary(spark.createDataFrame(rows[:1], OFFER), O.Profile()), O.Profile()).first()
    assert scored["match_reasons"] == ["testy manualne", "100% remote"] and scored["match_score"] == 6 + 3 + 3 + 2


def test_dedupe_with_shared_and_null_order(spark):
    """Whole rows of one offer each, whatever the order columns: descriptions do not cross."""
    rows = [(*offer(1, "A", salary=""), "a poor"), (*offer(1, "A"), "a rich"), (*offer(1, "B"), "b"), (None, *offer(0, "C")[1:], "c"), (*offer(1, "C"), "c late")]
    df = spark.createDataFrame(rows, OFFER + ", description string")
    for n in (1, 4):
        got = {r["title"]: (r["description"], r["first_seq"]["seq"]) for r in O.dedupe_best(df.repartition(n), O.Profile(), O.Order()).collect()}
        assert got == {"A": ("a rich", 1), "B": ("b", 1), "C": ("c", None)}


def test_sections_digest_and_problems_of_sources(spark):
    rows = spark.createDataFrame([("a", "Tak", "Nowa", "2024-01-02"), ("a", "Tak", "Rozmowa", "2024-01-02"), ("a", "Nie", "Rozmowa", "2024-01-02"), ("a", "Tak", "Obejrzana", "2024-01-01")], "list_name string, active string, status string, first_seen string")
    assert {(r["section"], r["n"], r["n_new"]) for r in T.section_counts(rows, "2024-01-02").collect()} == {("active", 2, 1), ("done", 1, 0), ("gone", 1, 0)}
    news = spark.createDataFrame([("a", "Acme", "QA", None, "Remote", "l")], "list_name string, company string, title string, location string, work_mode string, link string")
    bad = spark.createDataFrame([("b", "broken")], "list_name string, problem string")
    assert {tuple(r) for r in T.digest_rows(news, bad).collect()} == {("a", "new", "Acme – QA (, Remote)", "l"), ("b", "problem", "b: broken", "")}
    runs = spark.createDataFrame([("A", "HTTP 500", ["w"], 0), ("B", "", ["slow"], 0), ("C", None, None, 3), ("D", "", [], None)], "source string, error string, warnings array<string>, n_offers int")
    got = {(r["source"], r["problem"], r["incomplete"]) for r in registry.source_problems(runs).collect()}
    assert got == {("A", "A: źródło nie działa (HTTP 500)", True), ("B", "slow", True), ("B", "B: 0 ofert - możliwa zmiana strony portalu", False), ("D", "D: 0 ofert - możliwa zmiana strony portalu", False)}


def test_categories_and_deadlines_are_carried(spark):
    body = '{"content":[{"jobPosition":"QA tester","fullPagePath":"u","submissionDeadline":"2024-03-01","subjectName":"Urząd"},{"jobPosition":"QA","fullPagePath":"v"}]}'
    landed = spark.createDataFrame([("nabory_api", "x", body, "2024-02-01", ["public"])], "source string, company string, body string, run_date string, company_categories array<string>")
    got = {r["url"]: (r["expires_in"], r["company_categories"]) for r in adapters.normalise(landed, "nabory_api").collect()}
    assert got == {"u": ("2024-03-01", ["public"]), "v": ("", ["public"])}
