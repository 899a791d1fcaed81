import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import offers as O
from jobloom.operators import pages as P
from jobloom.operators import tracker as T
from jobloom.plans.catalogue import PROFILE

OFFER = "seq int, company string, title string, location string, work_mode string, contract_types array<string>, salary string, url string, source string, skills array<string>"


def offer(seq, company="Firma", title="Bolt", location="Wrocław", mode="Hybrid", kinds=(), salary="", source="test", skills=()):
    return (seq, company, title, location, mode, list(kinds), salary, f"https://x/{seq}", source, list(skills))


@pytest.mark.parametrize("n", [1, 7])
def test_dedupe_against_a_plain_loop(spark, n):
    rng = random.Random(3)
    rows = [offer(i, rng.choice(["Axe", "Axe Poland", "Bee", ""]), rng.choice(["Bolt", "bolt (f/m)", "Gear"]), rng.choice(["Wrocław", "Paris"]), rng.choice(["Remote", "Office"]), rng.choice([(), ("B2B",)]), rng.choice(["", "5 PLN"]), rng.choice(["LinkedIn", "x"])) for i in range(200)]
    best = {}
    for r in rows:
        key = (r[1].replace(" Poland", "").lower(), r[2].replace(" (f/m)", "").lower())
        rich = (r[3] == "Wrocław" or r[4] == "Remote", r[6] != "", 0, len(r[5]), r[8] != "LinkedIn")
        if key not in best or rich > best[key][0]:
            best[key] = (rich, r[0])
    got = O.dedupe_best(spark.createDataFrame(rows, OFFER).repartition(n), PROFILE, O.Order())
    assert {r["seq"] for r in got.collect()} == {v[1] for v in best.values()}


def test_cascade(spark):
    rows = [
        offer(0, title="Cook"), offer(1, title="Red bolt"), offer(2, title="Red small bolt"), offer(3, title="Old bolt"), offer(4, location="Paris"),
        offer(5, kinds=["B2B"], salary="50 PLN /h"), offer(6, kinds=["B2B"], salary="120 PLN /h"), offer(7, kinds=["Permanent"], salary="8 000 PLN"), offer(8, location="Paris", mode="Remote"),
    ]
    got = {r["seq"]: r["reject_reason"] for r in O.reject_cascade(spark.createDataFrame(rows, OFFER), PROFILE).collect()}
    assert got == {0: "title", 1: "automation", 2: None, 3: "seniority", 4: "location", 5: "salary", 6: None, 7: "salary", 8: None}


def test_salary_classes(spark):
    rows = [
        offer(0, salary="960 PLN / day /day"), offer(1, salary="10 000 PLN brutto"), offer(2, salary="100 EUR"), offer(3, salary="PLN"), offer(4),
        offer(5, kinds=["B2B", "Permanent"], salary="10 000 PLN"), offer(6, salary="10 000 PLN"), offer(7, kinds=["Permanent"], salary="240000 PLN /year"),
    ]
    got = {r["seq"]: r["salary_class"] for r in O.assess_salary(spark.createDataFrame(rows, OFFER), PROFILE).collect()}
    assert got == {0: "b2b_ok", 1: "uop_ok", 2: "foreign", 3: "unreadable", 4: "none", 5: "uop_ok", 6: "unknown", 7: "uop_ok"}


def test_collapse_is_a_fold(spark):
    rows = [("k", i, f"l{i}", a, s, f) for i, (a, s, f) in enumerate([("Tak", "Nowa", "2024-02-01"), ("Nie", "Rozmowa", "2024-01-01"), ("Tak", "Obejrzana", "")])]
    df = spark.createDataFrame(rows, "key string, seq int, link string, active string, status string, first_seen string")
    for n in (1, 5):
        got = T.collapse(df.repartition(n), ["seq"]).first()
        assert (got["link"], got["status"], got["first_seen"]) == ("l0", "Rozmowa", "2024-01-01")


def test_match_claims_once(spark):
    previous = spark.createDataFrame([(1, "a", "k", "Rozmowa", "2024-01-01"), (2, "b", "k", "Nowa", "2024-01-02")], "seq int, link string, key string, status string, first_seen string")
    current = spark.createDataFrame([(1, "b", "k"), (2, "z", "k"), (3, "a", "q"), (4, "n", "n")], "seq int, link string, key string")
    got = {r["seq"]: (r["status"], r["is_new"]) for r in T.match(previous, current, ["seq"]).collect()}
    assert got == {1: ("Nowa", False), 2: ("Nowa", True), 3: ("Rozmowa", False), 4: ("Nowa", True)}


def test_tracker_write_and_seed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "l1"), ("b", "l2")], "list_name string, link string")
    path = T.write(rows, str(tmp_path), 1)
    assert T.scan(spark.read.parquet(path)).count() == 2
    assert T.seed_if_empty(rows.where("list_name = 'a'"), rows).count() == 2


def test_verification(spark):
    offers = spark.createDataFrame([("u1", "QA Tester", False), ("u2", "QA Tester", True), ("u3", "QA Tester", False), ("u4", "Cook", False), ("u5", "QA", True)], "url string, title string, api_confirmed boolean")
    pages = spark.createDataFrame([("u1", 200, "<h1>Qa tester</h1>"), ("u2", 403, None), ("u3", 200, "<h1>QA Tester</h1> Offer expired"), ("u4", 200, "<h1>Java</h1>"), ("u5", 500, "")], "url string, status int, html string")
    got = {r["url"]: r["reason"] for r in P.verify_offers(offers, pages).collect()}
    assert got == {"u1": "title", "u2": "confirmed, blocked", "u3": "closed", "u4": "other title", "u5": "status"}


def test_boards(spark):
    df = spark.createDataFrame([("https://jobs.lever.co/Acme/1",), ("https://acme.recruitee.com/o/x",), ("https://example.com",)], "u string")
    got = [r["b"] and tuple(r["b"]) for r in df.select(P.detect_board(F.col("u")).alias("b")).collect()]
    assert got == [("lever", "Acme"), ("recruitee", "acme"), None]


def test_verification_by_path_and_og_title(spark):
    rows = [("https://x/cv/1", "Pracuj.pl"), ("https://x/qa,oferta,1", "Pracuj.pl"), ("https://x/job-offer/1", "other"), ("https://x/pl/job/1", "LinkedIn"), ("https://x/1", "Kariera: Acme"), ("https://x/gone", "Kariera: Acme")]
    offers = spark.createDataFrame([(u, s, "QA Tester", False) for u, s in rows], "url string, source string, title string, api_confirmed boolean")
    html = """<meta content='Qa tester' property="og:title"><h1>Welcome</h1>"""
    pages = spark.createDataFrame([(u, 200, html) for u, _ in rows[:-1]], "url string, status int, html string")
    got = {r["url"]: (r["reason"], r["verified"]) for r in P.verify_offers(offers, pages).collect()}
    assert [got[u] for u, _ in rows] == [("path", False), ("title", True), ("title", True), ("path", False), ("title", True), ("no page", False)]


def test_verify_queries_run_over_every_page(spark, tmp_path):
    from jobloom.plans import catalogue

    rows = [(i, f"https://x/{i % 30}", f"<h1>QA {i}</h1>") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.queries()["verify_offers"](spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in got) == list(range(40)) and not any(r["reason"] == "no page" for r in got)
    assert sum(r["n"] for r in catalogue.queries()["verify_counts"](spark, str(tmp_path)).collect()) == 40


def test_whole_order_and_union(spark):
    from jobloom.plans import catalogue

    d = "/root/testdata/sf0.001"
    got = sorted(catalogue.queries()["tracker_order"](spark, d).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(spark.read.parquet(f"{d}/events.parquet").count())) and len(got) > 100
    assert {r["source"] for r in catalogue.queries()["union_all_sources"](spark, d).collect()} == {f"src{i}" for i in range(5)}
    rows = spark.createDataFrame([(i, "Tak" if i % 3 else "Nie", "Nowa", f"2024-01-{i % 28 + 1:02}") for i in range(5000)], "seq int, active string, status string, first_seen string")
    placed = {r["place"]: r["seq"] for r in T.placed(rows.repartition(7), ["seq"]).collect()}
    assert [placed[i] for i in range(5000)] == [r["seq"] for r in T.order(rows, ["seq"]).collect()]


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_target_country(spark):
    cases = {"": True, "Nie podano": True, "Gdynia": True, "Warsaw, PL": True, "Remote - anywhere": True, "EMEA remote": True, "Neuss, Germany (remote)": False, "Remote, Opolelandia": False, "Berlin": False, "Europe": False}
    assert column(spark, list(cases), lambda c: O.target_country(c, O.Profile())) == list(cases.values())


def test_soft_404(spark):
    rows = [
        ("https://x.pl/job/1", "https://x.pl/pl/", "", "redirected home"), ("https://x.pl/job/1", "https://x.pl/error/a", "", None), ("https://x.pl/job/1", "https://x.pl/job/1", "<title>Strona nie istnieje</title>", "error title"),
        ("https://x.pl/job/1", "https://kariera.pl", "", None), ("https://x.pl/", "https://x.pl/pl", "", None), ("https://x.pl/job/1", "https://x.pl/?job=1", "", None), ("https://x.pl/a", "https://x.pl/page-not-found", "", "error path"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, h string, want string").orderBy("i")
    assert [r["x"] for r in df.select(P.soft_404(F.col("a"), F.col("b"), F.col("h")).alias("x")).collect()] == [r[3] for r in rows]


def test_board_addresses(spark):
    cases = {
        "https://boards.greenhouse.io/embed/job_board?for=acme": ("greenhouse", "acme"), "https://boards-api.greenhouse.io/v1/boards/acme/jobs": ("greenhouse", "acme"), "https://www.recruitee.com": None, "HTTPS://JOBS.LEVER.CO/Acme": ("lever", "Acme"),
        "https://t.wd3.myworkdayjobs.com/en-US/Site/job/1": ("workday", "t.wd3.myworkdayjobs.com/Site"), "https://t.wd3.myworkdayjobs.com/wday/x": None, "https:\\/\\/apply.workable.com\\/acme": ("workable", "acme"), "https://apply.workable.com/api/x": None,
    }
    got = column(spark, list(cases), P.detect_board)
    assert [x and tuple(x) for x in got] == list(cases.values())
    hinted = spark.createDataFrame([("https://jobs.acme.com/x", "teamtailor"), ("https://jobs.acme.com/x", "lever")], "u string, h string")
    assert [r["b"] and tuple(r["b"]) for r in hinted.select(P.detect_board(F.col("u"), F.col("h")).alias("b")).collect()] == [("teamtailor", "jobs.acme.com"), None]
    pages = spark.createDataFrame([(1, "https://jobs.acme.com/", '<script src="https://www.teamtailor-cdn.com/x.js">teamtailor'), (2, "https://a.com", "see https://team.teamtailor.com/jobs"), (3, "https://b.com", None)], "page_id int, url string, html string")
    assert [tuple(r) for r in P.boards_in_pages(pages).collect()] == [(1, "teamtailor", "jobs.acme.com")]


def test_embedded_postings_in_order(spark):
    from jobloom.functions import jsonld

    html = '<script type="application/ld+json">[{"@type":"JobPosting","title":"A","item":{"@type":"JobPosting","title":"B"}},{"@graph":[{"@type":"JobPosting","title":"C"},{"@type":"JobPosting","title":"D"}]}]</script><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":["JobPosting"],"title":"E"}</script>'
    stack, want = [[{"t": "A", "item": {"t": "B"}}, {"@graph": [{"t": "C"}, {"t": "D"}]}]], []
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(x)
        else:
            want += [x["t"]] if "t" in x else []
            stack.extend(v for k, v in x.items() if k != "t")
    df = spark.createDataFrame([(html,), (None,), ("plain",)], "html string")
    got = [r["t"] for r in jsonld.postings(df).select(F.transform("postings", jsonld.title).alias("t")).collect()]
    assert got == [[*want, "E"], [], []]


def test_cascades_after_verification(spark):
    schema = "url string, title string, location string, work_mode string, contract_types array<string>, salary string, source string, skills array<string>, description string, match_score int"
    row = lambda i, d, title="Tester", place="Wrocław", mode="Nie podano", source="x": (f"u{i}", title, place, mode, [], "", source, [], d, 3)
    rows = [row(0, "Manual testing"), row(1, "fluent German required"), row(2, "Selenium, Cypress, Python, automation"), row(3, "B2B 10 PLN/h"), row(4, "hybrid", place="Gdynia"), row(5, "short", source="Pracuj.pl"), row(6, None, place="Gdynia", mode="Remote")]
    long = spark.createDataFrame([("u5", "Offer expired 2 days ago"), ("u0", "fluent German")], "url string, text string")
    got = {r["url"]: r for r in O.analysis_cascade(spark.createDataFrame(rows, schema), O.Profile(), long).collect()}
    assert {k: r["reject_reason"] for k, r in got.items()} == {"u0": None, "u1": "language", "u2": "automation", "u3": "salary", "u4": "location", "u5": "expired", "u6": None}
    assert (got["u0"]["match_score"], got["u0"]["manual_share"]) == (8, 100)


def plain_collapse(rows):
    best = {}
    rank = {"": 0, "Nowa": 0, "Obejrzana": 1, "Rozmowa": 2, "Odrzucona": 2}
    for key, seq, active, status, seen in rows:
        if key not in best:
            best[key] = [seq, active, status, seen]
            continue
        now = best[key]
        first = min([x for x in (now[3], seen) if x], default="")
        of = lambda a, s: (a == "Tak", rank[s])
        top = [seq, active, status, seen] if of(active, status) > of(now[1], now[2]) else now
        said = top[2]
        for other in (status, now[2]):
            if rank[other] > rank[said]:
                said = other
        best[key] = [top[0], top[1], said, first]
    return {k: tuple(v) for k, v in best.items()}


@pytest.mark.parametrize("n", [1, 7])
def test_collapse_against_a_plain_loop(spark, n):
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(30)}", i, rng.choice(["Tak", "Nie"]), rng.choice(["", "Nowa", "Obejrzana", "Rozmowa", "Odrzucona"]), rng.choice(["", "2024-01-01", "2024-02-01"])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, seq int, active string, status string, first_seen string").repartition(n)
    assert {r["key"]: (r["seq"], r["active"], r["status"], r["first_seen"]) for r in T.collapse(df, ["seq"]).collect()} == plain_collapse(rows)


ROW = "seq int, key string, link string, company string, source string"


def test_merge_scope_incomplete_and_shared(spark):
    previous = spark.createDataFrame([(1, "a", "la", "Acme", "s", "Obejrzana", "2024-01-01", "", "Tak"), (2, "b", "lb", "Beta", "s", "Nowa", "2024-01-01", "", "Tak"), (3, "c", "lc", "Acme", "broken", "Nowa", "2024-01-01", "", "Tak"), (4, "d", "ld", "Acme", "s", "Nowa", "2024-01-01", "", "Tak")], ROW + ", status string, first_seen string, last_seen string, active string")
    current = spark.createDataFrame([(1, "a", "new link", "Acme", "s"), (2, "e", "le", "Acme", "s")], ROW)
    scope, incomplete = spark.createDataFrame([("ACME",)], "company string"), spark.createDataFrame([("broken",)], "source string")
    shared = spark.createDataFrame([("key", "e", "Rozmowa"), ("link", "lb", "Obejrzana"), ("key", "b", "Rozmowa")], "kind string, value string, status string")
    rows, new = T.merge(previous, current, "2024-02-02", ["seq"], scope, shared, incomplete)
    got = {r["key"]: (r["status"], r["active"], r["first_seen"]) for r in rows.collect()}
    assert got == {"a": ("Obejrzana", "Tak", "2024-01-01"), "b": ("Obejrzana", "Tak", "2024-01-01"), "c": ("Nowa", "Tak", "2024-01-01"), "d": ("Nowa", "Nie", "2024-01-01"), "e": ("Rozmowa", "Tak", "2024-02-02")}
    assert [r["key"] for r in new.collect()] == ["e"]


def test_tracker_update_never_overwrites_what_it_cannot_read(spark, tmp_path):
    current = spark.createDataFrame([(1, "a", "la", "Acme", "s")], ROW)
    store, backup = str(tmp_path / "store"), str(tmp_path / "backup")
    new, problems = T.update(spark, store, backup, "Portale", current, "2024-02-01", ["seq"])
    assert new.count() == 1 and problems == [] and T.version(spark, store) == 1
    again, _ = T.update(spark, store, backup, "Portale", current, "2024-02-02", ["seq"])
    T.update(spark, store, backup, "Firmy", current, "2024-02-02", ["seq"])
    got = {(r["list_name"], r["first_seen"], r["last_seen"]) for r in T.read_current(spark, store).collect()}
    assert again.count() == 0 and got == {("Portale", "2024-02-01", "2024-02-02"), ("Firmy", "2024-02-02", "2024-02-02")}
    v = T.version(spark, store)
    for f in (tmp_path / "store" / f"v={v}").rglob("*.parquet"):
        f.write_bytes(b"broken")
    new, problems = T.update(spark, store, backup, "Portale", current, "2024-02-03", ["seq"])
    assert new is None and len(problems) == 1 and T.version(spark, store) == v and spark.read.parquet(f"{backup}/Portale").count() == 1


def test_digest(spark):
    lists = spark.createDataFrame([("a", 5, 3, 2), ("b", 1, 1, 1)], "list_name string, found int, saved int, active int")
    problems = spark.createDataFrame([("b", "x")], "list_name string, problem string")
    got = {r["list_name"]: (r["n_new"], r["n_problems"], r["total_new"], r["send"]) for r in T.digest(lists, problems, problems.where("false").select("list_name")).collect()}
    assert got == {"a": (0, 0, 0, True), "b": (0, 1, 0, True)}


def test_dedupe_keeps_the_first_place_and_the_description(spark):
    rows = [(*offer(5, salary=""), "one"), (*offer(7, salary="5 PLN"), "two")]
    r = O.dedupe_best(spark.createDataFrame(rows, OFFER + ", description string"), PROFILE, O.Order()).collect()
    assert len(r) == 1 and (r[0]["seq"], r[0]["first_seq"]["seq"], r[0]["description"]) == (7, 5, "two")
