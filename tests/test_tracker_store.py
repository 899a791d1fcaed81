"""Commits of the tracker: stops at each step, broken pages, two writers, replayed batches."""

import pytest

from jobloom.operators import store as S
from jobloom.operators import tracker as T

ROW = "seq int, key string, link string, company string, source string"


def run(spark, *keys):
    return spark.createDataFrame([(i, k, f"l{k}", "Acme", "s") for i, k in enumerate(keys)], ROW)


def begun(spark, tmp_path):
    """A tracker with one row whose status a user has set."""
    path, backup = str(tmp_path / "tracker"), str(tmp_path / "backup")
    T.update(spark, path, backup, "a", run(spark, "x"), "2024-01-01", ["seq"])
    T.write_list(T.read_current(spark, path).replace("Nowa", "Rozmowa", "status"), path, "a")
    return path, backup


def statuses(spark, path):
    return {(r["list_name"], r["key"]): (r["status"], r["first_seen"]) for r in T.read_current(spark, path).collect()}


@pytest.mark.parametrize("step", ["write", "create", "claim", "after"])
def test_a_stop_at_any_step_loses_no_status(spark, tmp_path, monkeypatch, step):
    path, backup = begun(spark, tmp_path)
    stop = lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt)
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(T, "_written", stop)
        elif step == "create":  # data are there, no file of a version yet
            m.setattr(S, "publish", stop)
        elif step == "claim":  # the file of the version is made beside the log
            m.setattr(S, "claim", stop)
        else:
            whole = S.claim
            m.setattr(S, "claim", lambda *a: whole(*a) and stop())
        with pytest.raises(KeyboardInterrupt):
            T.update(spark, path, backup, "a", run(spark, "x", "y"), "2024-02-01", ["seq"])
    assert T.version(spark, path) == (3 if step == "after" else 2)
    assert statuses(spark, path)["a", "x"] == ("Rozmowa", "2024-01-01")
    new, problems = T.update(spark, path, backup, "a", run(spark, "x", "y"), "2024-02-02", ["seq"])
    assert problems == [] and [r["key"] for r in new.collect()] == ([] if step == "after" else ["y"])
    assert statuses(spark, path)["a", "x"] == ("Rozmowa", "2024-01-01") and len(statuses(spark, path)) == 2


def test_a_file_that_is_not_whole_does_not_count(spark, tmp_path):
    path, backup = begun(spark, tmp_path)
    (tmp_path / "tracker" / S.LOG / "0000000003.json").write_text('{"version": 3, "li')
    assert T.version(spark, path) == 2 and statuses(spark, path)["a", "x"][0] == "Rozmowa"
    T.update(spark, path, backup, "b", run(spark, "z"), "2024-02-01", ["seq"])
    assert T.version(spark, path) == 4 and statuses(spark, path)["a", "x"][0] == "Rozmowa"


def test_a_broken_page_gives_a_backup_and_a_problem(spark, tmp_path):
    path, backup = begun(spark, tmp_path)
    T.write_list(T.read_current(spark, path).unionByName(spark.range(3000).selectExpr("int(id) seq", "string(id) key", "concat('l', id) link", "'Acme' company", "'s' source", "'Nowa' status", "'' first_seen", "'' last_seen", "'Tak' active", "'a' list_name")).coalesce(1), path, "a")
    for f in (tmp_path / "tracker" / S.latest(spark, path).lists["a"]).glob("*.parquet"):
        raw = bytearray(f.read_bytes())
        raw[200:1200] = b"\xff" * 1000  # the footer stays readable
        f.write_bytes(raw)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    for n in (1, 2):
        new, problems = T.update(spark, path, backup, "a", run(spark, "x", "y"), "2024-02-01", ["seq"])
        assert new is None and len(problems) == 1 and T.version(spark, path) == 3
        assert spark.read.parquet(f"{backup}/a").count() == 2 * n


def test_a_faulty_run_is_no_problem_of_the_tracker(spark, tmp_path):
    path, backup = begun(spark, tmp_path)
    faulty = run(spark, "x").selectExpr("seq", "key", "link", "raise_error('bad run') company", "source")
    with pytest.raises(Exception, match="bad run"):
        T.update(spark, path, backup, "a", faulty, "2024-02-01", ["seq"])
    assert T.version(spark, path) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """A run that another one overtakes is merged into what that one wrote; neither's rows are lost."""
    path, backup = begun(spark, tmp_path)
    whole, fired = S.publish, []

    def overtaken(*args, **more):
        if not fired:
            fired.append(True)
            T.update(spark, path, backup, "b", run(spark, "other"), "2024-02-01", ["seq"])
            T.update(spark, path, backup, "a", run(spark, "x", "first"), "2024-02-01", ["seq"])
        return whole(*args, **more)

    monkeypatch.setattr(S, "publish", overtaken)
    T.update(spark, path, backup, "a", run(spark, "x", "second"), "2024-02-02", ["seq"])
    assert set(statuses(spark, path)) == {("a", "x"), ("a", "first"), ("a", "second"), ("b", "other")}
    assert statuses(spark, path)["a", "x"] == ("Rozmowa", "2024-01-01") and T.version(spark, path) == 5
    base = S.latest(spark, path)
    assert S.publish(spark, path, S.Commit(4, {}), {"a": "x"}) is None and S.latest(spark, path) == base


def test_batches_and_vacuum(spark, tmp_path):
    path, backup = begun(spark, tmp_path)
    for n in (0, 0, 1, 0):  # a batch that comes again changes nothing
        T.update(spark, path, backup, "a", run(spark, "x", f"k{n}"), f"2024-02-0{n + 1}", ["seq"], batch=("stream", n))
    assert T.version(spark, path) == 4 and {k for _, k in statuses(spark, path)} == {"x", "k0", "k1"}
    before = statuses(spark, path)
    assert len(S.vacuum(spark, path, keep=2)) == 2 and statuses(spark, path) == before and S.vacuum(spark, path, keep=2) == []


def test_columns_of_other_layouts(spark, tmp_path):
    path, backup = begun(spark, tmp_path)
    wider = run(spark, "x").selectExpr("*", "'new' place", "1.5 share").drop("source")
    T.update(spark, path, backup, "a", wider, "2024-02-01", ["seq"])
    r = T.read_current(spark, path).first()
    assert r["place"] == "new" and "source" not in r.asDict() and r["status"] == "Rozmowa"
