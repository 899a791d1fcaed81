"""Analysis cascade: balanced tasks, signals looked for only where their letters are."""

import re

from pyspark.sql import functions as F

from jobloom.functions import language as L
from jobloom.operators import offers as O

SCHEMA = "url string, title string, company string, location string, work_mode string, salary string, contract_types array<string>, skills array<string>, source string, description string, match_score int"


def test_analysis_tasks_are_balanced(spark):
    """One file or one task of input does not make one task of reading texts."""
    rows = [(f"u{i}", "Tester", "A", "Wrocław", "Remote", "", [], [], "X", "manual tests, test cases", 5) for i in range(40)]
    made = O.analysis_cascade(spark.createDataFrame(rows, SCHEMA).coalesce(1), O.Profile())
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 40


def test_signals_equal_their_patterns(spark):
    """What must be in a text before a pattern is tried leaves out no match."""
    texts = """przypadkami testowymi|przypadku testow|test case|test cases|scenariusze testow|test scenarios|eksploracyjne|exploratory|uat|quat|akceptacyjne|acceptance test|funkcjonalne|functional|cross-functional
    |cross functional|integration testing|testy integracyjne|ui testing|mobile testing|testy mobilne|regresja|regression|zglaszanie bledow|zglaszan defekt|zglaszanie defektow|bug report|raportowanie bledow|defect report
    |report defects|reporting bugs|report bug|defect tracking|testrail|xray|zephyr|qtest|dokumentacja testow|test plan|plan testow|test documentation|test report|test reports|raporty z testow|postman|swagger|soapui|manual
    |automat|automation|sdet|sdets|selenium|webdriver|playwright|cypress|appium|robot framework|rest assured|rest-assured|restassured|karate|pytest|junit|testng|nunit|xunit|mocha|jest|jesten|cucumber|gherkin|specflow|java|javas
    |python|typescript|javascript|c#|.net|.nets|kotlin|go|good|go!|ci/cd|jenkins|gitlab ci|github actions|azure devops pipeline|jmeter|gatling|k6|k66|locust|""".replace("\n    ", "").split("|")
    signals = [*L.MANUAL, *L.AUTOMATION]
    df = spark.createDataFrame([(f"a {t}, b",) for t in texts], "t string")
    both = [F.struct(L.has_signal(F.col("t"), p, name).alias("a"), F.col("t").rlike(f"(?U){p}").alias("b")).alias(f"s{i}") for i, (p, _, name) in enumerate(signals)]
    got = df.select("t", *both).collect()
    for i, (_, _, name) in enumerate(signals):
        assert [r["t"] for r in got if r[f"s{i}"]["a"] != r[f"s{i}"]["b"]] == [] and any(r[f"s{i}"]["a"] for r in got), name
    starts = ["nice to have", "nice-to-have", "mile widziane", "dodatkowy atut", "dodatkow atutem", "will be a plus", "would be a plus", "is a plus", "good to have", "bonus points", "optional skills", "preferred qualifications"]
    assert all(re.fullmatch(L.OPTIONAL_START, s) and any(n in s for n in L.OPTIONAL_NEEDED) for s in starts)


def test_counts_judge_once(spark):
    """Reasons and the kept rows beyond the report come from one pass over the offers."""
    judged = spark.createDataFrame([(None,), (None,), (None,), ("title",)], "reject_reason string")
    counts = O.analysis_counts(judged, 2)
    assert sorted(map(tuple, counts.collect())) == [("cut", 1), ("kept", 3), ("title", 1)]
    assert len(re.findall(r"LogicalRDD|LocalRelation", counts._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert sorted(map(tuple, O.analysis_counts(judged.where("reject_reason = 'title'"), 2).collect())) == [("title", 1)]
