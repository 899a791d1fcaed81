from jobloom.streaming.incremental import run_new


def test_each_file_once(spark, tmp_path):
    landed, seen = str(tmp_path / "in"), []
    for i in range(2):
        spark.createDataFrame([(f"s{i}", "c", "{}")], "source string, company string, body string").write.mode("append").parquet(landed)
        run_new(spark, landed, str(tmp_path / "check"), lambda rows, n: seen.extend(r["source"] for r in rows.collect()))
    assert seen == ["s0", "s1"]


def test_batches_are_merged_once_even_if_they_come_again(spark, tmp_path, monkeypatch):
    """Two landings; the second run stops after its commit and before its checkpoint, and is run again."""
    import json

    import pytest

    from jobloom.operators import store, tracker
    from jobloom.operators.offers import Profile
    from jobloom.streaming import incremental as I

    paths = {k: str(tmp_path / k) for k in ("in", "tracker", "backup", "check")}
    profile = Profile(city="Opole", city_aliases=())

    def land(*jobs):
        body = json.dumps({"offers": [{"title": t, "careers_url": f"https://x/{u}", "city": "Opole"} for t, u in jobs]})
        spark.createDataFrame([("recruitee", "Acme", body)], I.LANDING).write.mode("append").parquet(paths["in"])

    def run(date):
        return I.run_incremental(spark, paths["in"], paths["tracker"], paths["backup"], paths["check"], "Firmy", ["recruitee"], date, profile)

    land(("QA Tester", 1), ("Cook", 2), ("Test Engineer", 3), ("QA Tester (m/f)", 4))
    assert run("2024-01-01") == []
    rows = lambda: {r["key"]: (r["link"], r["status"], r["first_seen"], r["active"]) for r in tracker.read_current(spark, paths["tracker"]).collect()}
    assert rows() == {"acme/qa tester": ("https://x/1", "Nowa", "2024-01-01", "Tak"), "acme/test engineer": ("https://x/3", "Nowa", "2024-01-01", "Tak")}
    tracker.write_list(tracker.read_current(spark, paths["tracker"]).replace("Nowa", "Rozmowa", "status"), paths["tracker"], "Firmy")

    land(("QA Tester", 1), ("QA Lead tester", 5), ("Tester", 6))
    whole = tracker.update
    with monkeypatch.context() as m:
        m.setattr(tracker, "update", lambda *a, **k: (whole(*a, **k), 1 / 0))
        with pytest.raises(Exception, match="division by zero"):
            run("2024-02-01")
    v, seen = tracker.version(spark, paths["tracker"]), rows()
    assert v == 3 and seen["acme/tester"] == ("https://x/6", "Nowa", "2024-02-01", "Tak") and seen["acme/test engineer"][1:] == ("Rozmowa", "2024-01-01", "Nie")
    assert run("2024-02-02") == [] and tracker.version(spark, paths["tracker"]) == v and rows() == seen
    assert store.latest(spark, paths["tracker"]).batches == {paths["check"]: 1}
