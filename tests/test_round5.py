"""Tests of the findings of FINDINGS_r03.md that were taken up after it."""

from jobloom.sources import landing


def test_wanted_days_do_not_gather_a_partition(spark, tmp_path):
    """The landed rows of a source and day are filtered where they are read: shuffled by both, they would all go to one task."""
    path = str(tmp_path / "landed")
    landing.write_landing(spark.createDataFrame([("c", "", 0, n, "b", "s1", f"2024-01-0{1 + n % 2}") for n in range(8)], landing.SCHEMA), path)
    wanted = spark.createDataFrame([("s1", "2024-01-02"), ("s1", "2024-01-02"), ("s2", "2024-01-01")], "source string, run_date string")
    some = landing.read_landing(spark, path, wanted)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["seq"] for r in some.collect()) == [1, 3, 5, 7]


def test_a_card_is_read_once(spark):
    """Tags are cut out of a card and its fields in one place of the plan, however many columns are made of them."""
    from jobloom.sources import cards

    body = '<a class="posting-list-item" href="/pl/job/x"><h3>QA &amp; SQL NOWA</h3><h4 class="company-name">Acme</h4></a>'
    landed = spark.createDataFrame([("nofluffjobs", "", body)], "source string, company string, body string")
    made = cards.read_cards(landed, "nofluffjobs").select("company", "title", "url", "contract_types", "work_mode", "location", "expires_in", "skills")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("<[^>]*>") <= 3
    assert made.select("company", "title", "url", "skills").collect() == [("Acme", "QA & SQL", "https://nofluffjobs.com/pl/job/x", ["SQL"])]
