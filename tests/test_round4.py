from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.plans import catalogue


def write_pages(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def test_titles_match_keeps_sharp_s(spark):
    """ß is no ss: a title SS is not in a title with äßä."""
    one = spark.range(1)
    got = one.select(text.titles_match(F.lit("SS"), F.lit("und äßä erer")).alias("a"), text.titles_match(F.lit("Straße"), F.lit("die STRAßE")).alias("b"), text.normalize_title(F.lit("Große (m/f)")).alias("c")).first()
    assert tuple(got) == (False, True, "große")


def test_enrich_offers_of_repeated_urls(spark, tmp_path):
    """Pages of one URL keep their own salaries."""
    write_pages(spark, tmp_path, [(1, "https://x.pl/a", "<p>x</p>"), (2, "https://x.pl/a", "<p>x</p>"), (3, None, "<p>y</p>")])
    got = {r["page_id"]: r["salary"] for r in catalogue.queries()["enrich_offers"](spark, str(tmp_path)).collect()}
    assert got == {1: "1 EUR", 2: "2 EUR", 3: "3 EUR"}


def test_pracuj_pages_are_bounded(spark):
    """Numbered offers come in responses of about 50 of a company, however many there are."""
    from jobloom.sources.tables import in_pages

    ids = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = spark.range(1203).select(*[F.col("id").alias(c) for c in ids], F.lit("c").alias("company"), F.lit("u").alias("url"), F.lit("").alias("salary"))
    sizes = [r["count"] for r in in_pages(rows).groupBy("company", "seq").count().collect()]
    assert sum(sizes) == 1203 and max(sizes) <= 50


def test_batches_are_read_in_parts(monkeypatch):
    """A batch becomes Python objects a part at a time: results of a part are written before the next is read."""
    import pyarrow as pa

    from jobloom.functions import dom

    monkeypatch.setattr(dom, "PART", 100)
    texts = [None, *["x" * (i % 40) for i in range(500)], "y" * 1000]
    run = dom.in_parts(lambda t: [t or "", "z"], pa.list_(pa.string()))
    assert run(pa.array(texts, pa.string())).to_pylist() == [[t or "", "z"] for t in texts]
    assert run(pa.array([], pa.string())).to_pylist() == []
    seen, most = [], []
    counting = dom.in_parts(lambda t: seen.append(t), pa.string())
    real = pa.array
    monkeypatch.setattr(pa, "array", lambda values, *a: (most.append(len(values)), real(values, *a))[1])
    counting(real(texts, pa.string()))
    assert len(seen) == len(texts) and max(most) < 20


def test_dedupe_carries_each_column_once(spark):
    """Whole rows come back, maps and descriptions too; without these the aggregate is one struct that holds each column once."""
    from jobloom.operators import offers as O

    df = spark.createDataFrame([("u", 2, "b", "two", {"k": 2}), ("u", 1, "a", "one", {"k": 1}), ("v", None, "c", None, None)], "url string, seq int, title string, description string, m map<string,int>")
    for last, want in ((False, "one"), (True, "two")):
        got = {r["url"]: r for r in O.url_dedupe(df, O.Order(), last).collect()}
        assert (got["u"]["description"], got["u"]["first_seq"]["seq"], got["u"]["m"]["k"]) == (want, 1, 2 if last else 1) and got["v"]["title"] == "c" and got["v"]["first_seq"]["seq"] is None
    plain = df.drop("description", "m")
    best, restored = O._least(plain, O.Order())
    assert len(plain.agg(best.alias("b")).schema["b"].dataType) == len(plain.columns) == len(restored)
