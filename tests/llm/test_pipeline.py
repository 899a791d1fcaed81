"""The stages of the pipeline on a small table against brute force."""

import corpus_pipeline
from jobloom.llm.common import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    body = lambda seed: " ".join(f"{seed}word{i}" for i in range(80))
    bench = " ".join(f"bench{i}" for i in range(20))
    texts = [body("a"), body("a") + " tail", "too short", body("b") + " " + bench, body("c") + " password=hunter22x", body("d") + "#" * 50, None, body("e")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = read(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS, name
    assert kept == [[0, 1, 3, 4, 7], [0, 3, 4, 7], [0, 4, 7], [0, 4, 7], [0, 4, 7]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 4, 7]
    texts[4] = texts[4].replace("hunter22x", "").replace("password=", "[secret]")
    want = {i: spm_ids(texts[i]) for i in (0, 4, 7)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == want


def spm_ids(text):
    """Number and digest of the library's ids."""
    import hashlib
    import struct

    import sentencepiece

    from jobloom.llm.piece_codec import default_model

    ids = sentencepiece.SentencePieceProcessor(model_file=default_model()).encode(text, add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, names that stages use themselves, a table without rows."""
    body = " ".join(f"word{i}" for i in range(70))
    rows = [(None, body, None, "s", None, 1), (None, body, None, "s", None, 1), (1, None, "en", None, 0, 2), (2, "", "en", "s", 0, 3), (3, body.replace("word", "other"), "en", "s", 5, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row int"
    bench = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(rows, schema)
    for docs, left in ((table, {None, 3}), (table.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == table.columns, name
        assert {r["doc_id"] for r in docs.collect()} == left
