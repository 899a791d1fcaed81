"""The operators with Python inside tasks, against brute force and the tokenizer libraries."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from jobloom.llm import hashing
from jobloom.llm import jaccard_join as J
from jobloom.llm import piece_codec as C
from jobloom.llm import substring_dedup as D
from jobloom.llm import suffix_tree_lm as L
from jobloom.llm import token_counts as T
from jobloom.llm import tool_links as K

SCHEMA = "doc_id long, text string"


def words(t, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if lower and c < "\x80" else c for c in t or ""))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(45)] for _ in range(4)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = [None, "", " \n", "one", "Two words", "two WORDS"]
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)[rng.randint(0, 5) : rng.randint(38, 45)]
        if i % 4 == 1:
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    out += [out[10], out[10], " ".join(base)]
    return out


def test_covers_and_hashes():
    for period, cover in D.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    texts = ["a bb a bb a", "", "bb a", "é" * 50 + " x\x0by", "a bb a"]
    w = hashing.Words(texts)
    assert list(w.count) == [5, 0, 2, 3, 3] and w.hash[0] == w.hash[2] == w.hash[4] != w.hash[1]
    two = hashing.window_hashes(w.hash, 2)
    assert two[0] == two[2] and two[1] == two[3] != two[0]
    big = hashing.Words(["word " * 500_000 + "end"])  # more than one block
    assert len(set(big.hash.tolist())) == 2 and big.count[0] == 500_001


@pytest.mark.parametrize("window", [35, 8])
def test_substring_dedup(spark, window):
    texts = corpus(1)
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], SCHEMA)
    seen = collections.Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    got = {r["doc_id"]: r for r in D.remove_repeats(docs, window).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        r = got[i if i != 3 else None]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    assert D.remove_repeats(docs.limit(0)).count() == 0


def components(texts, size, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t, True)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("small", "size", "percent"), [(16, 3, 90), (0, 3, 90), (1, 5, 80)])
def test_jaccard_join(spark, monkeypatch, small, size, percent):
    """With pairs at once, and with pivots all the way down."""
    monkeypatch.setattr(J, "SMALL", small)
    texts = corpus(2)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs, size, percent).collect()}
    assert got == components(texts, size, percent)


def test_jaccard_keep_one(spark):
    texts = corpus(3)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, rows[20]], SCHEMA)
    want = components(texts, 5, 80)
    kept = sorted(r["doc_id"] for r in J.keep_one(docs).collect())
    assert kept == [i for i, (n, c) in want.items() if c == i]
    assert J.join(docs.limit(0)).count() == 0


def texts_for_tokens():
    rng = random.Random(5)
    letters = [*"ab  \n\t▁é漢🙂\x00ﬁＡ①", "the", "  ", "<s>", "<0x0A>", "hello"]
    return [None, "", " ", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)), "long " * 20000]


def test_piece_codec(spark):
    texts = texts_for_tokens()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    sp = C.codec(open(C.default_model(), "rb").read()).library
    encoded = C.encode(docs, C.default_model())
    decoded = {r["doc_id"]: r["text"] for r in C.decode(encoded, C.default_model()).collect()}
    for r in encoded.collect():
        t = texts[r["doc_id"]] or ""
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert r["ids"] == want and decoded[r["doc_id"]] == sp.decode(want)
        assert r["begins"][0] == 0 and r["ends"][-1] == len(t.encode()) and r["begins"][1:] == r["ends"][:-1]
    digests = {r["doc_id"]: r for r in C.digests(docs, C.default_model()).collect()}
    assert all(digests[r["doc_id"]]["n_tokens"] == len(r["ids"]) for r in encoded.collect())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = next(dict(C._fields(v)) for k, v in C._fields(library.serialized_model_proto()) if k == 3)
    c = object.__new__(C.Codec)
    c.map, c.dummy, c.tidy, c.escape = C.CharMap(spec[2]), True, True, True
    for t in texts_for_tokens()[1:200]:
        if "\0" not in t:
            assert c.normalise(t)[0] == library.normalize(t)


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    pieces = T.vocabulary(C.default_model())
    library = Tokenizer(models.Unigram([("<unk>", -5e9), *pieces], 0, False))
    texts = texts_for_tokens()
    got = {r["doc_id"]: r["n_tokens"] for r in T.counts(spark.createDataFrame(list(enumerate(texts)), SCHEMA), pieces).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == (len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0)
    ties = T.Counter([("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert ties.best("aaaa") == 2 == len(Tokenizer(models.Unigram([("<unk>", -9.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)], 0, False)).encode("aaaa").ids)


def test_suffix_tree_lm(spark):
    rng = random.Random(7)
    follow = {f"a{i}": f"b{i}" for i in range(20)}
    texts = [None, "", "Ab aB", "ab ab"]
    for _ in range(300):
        texts.append(" ".join(x for _ in range(20) for x in (lambda a: (a, follow[a]))(rng.choice(list(follow)))))
    got = {r["doc_id"]: r for r in L.score(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    toks = {i: [*words(t, True), None] for i, t in enumerate(texts)}
    train = collections.Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(train.values()), len(train)
    for i, t in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r["base_score"] - sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6
    held = [r for i, r in got.items() if r["held_out"] and i > 3]
    # half of the words are certain from the word before
    assert held and sum(r["score"] for r in held) > 0.7 * sum(r["base_score"] for r in held)


def test_suffix_tree_is_a_distribution(spark):
    texts = [" ".join(random.Random(i).choices("abcde", [5, 4, 3, 2, 1], k=30)) + " x y z" for i in range(200)]
    tree, counts, total, distinct = L.learn(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert any(level.kept.any() for level in tree.levels)
    size = len(tree.words)
    assert size == distinct  # of so small a corpus every word is frequent
    for level in tree.levels:
        for c in range(len(level.keys)):
            own = level.p[level.entries // size == c].sum() if len(level.p) else 0
            assert abs(own + level.rest[c] - 1) < 1e-9 and level.rest[c] > 0
    assert abs(tree.prior.sum() + 0.1 / (total + 0.1 * (distinct + 1)) - 1) < 1e-9
    assert np.isfinite(tree.log10(tree.ids(hashing.Words(["x y z a b"]).hash), np.zeros(5, int))).all()


CALLS = "conv_id long, call_id string, position long, name string, arguments string, waits_for array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"


def test_tool_links(spark):
    schemas = {"add": {"properties": {"a": {"type": "integer"}, "note": {"type": "string"}}, "required": ["a"]}}
    calls = [
        (1, "x", 0, "add", '{"note": "n", "a": 1}', []), (1, "y", 2, "add", '{"a": "1"}', ["x"]), (1, "z", 4, "add", "not json", ["y", "nobody"]),
        (1, "x", 6, "add", "{}", []), (2, "p", 0, "add", '{"a": 1}', ["q"]), (2, "q", 1, "none", '{"a": 1}', ["p"]), (3, None, 0, "add", "{}", None), (4, "s", 5, "add", '{"a": 1}', None),
    ]
    results = [(1, "x", 1, "one"), (1, "y", 3, None), (1, "x", 9, "again"), (5, "lost", 0, "r"), (4, "s", 5, "early"), (None, "x", 0, "n")]
    got = K.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    by = {(r["conv_id"], r["call_id"], r["position"], r["result_position"]): r for r in got}
    x = by[1, "x", 0, 1]
    assert (x["status"], x["step"], x["valid"], x["arguments_json"]) == ("linked", 0, True, K.example({"note": "n", "a": 1}))
    assert (by[1, "y", 2, 3]["step"], by[1, "y", 2, 3]["valid"]) == (1, False)
    assert (by[1, "z", 4, None]["status"], by[1, "z", 4, None]["step"], by[1, "z", 4, None]["arguments_json"]) == ("open", 2, None)
    assert by[2, "p", 0, None]["step"] is None and by[2, "q", 1, None]["valid"] is False
    assert by[4, "s", 5, 5]["status"] == "early" and by[5, "lost", None, 0]["status"] == "orphan"
    assert sum(r["status"] == "repeated" for r in got) == 2
    lines = K.serialise(K.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)).collect()
    assert [r["json"] for r in lines] == ['{"arguments":{"a":1,"note":"n"},"id":"x","name":"add","result":"one"}']


@pytest.mark.parametrize("cached", [1 << 20, 3])
def test_suffix_tree_keeps_rare_contexts(spark, monkeypatch, cached):
    """Contexts far below any share of the tokens count, from the cache or by joins, as in a plain loop."""
    monkeypatch.setattr(L, "CACHED", cached)
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5)], k=5000)) for _ in range(160)]
    for i in range(0, 160, 16):
        texts[i] += " rare pair of words here"
    texts += ["rare pair of words here"] * 3 + ["rare pair of nothing", None, ""]
    toks = [[*words(t, True), None] for t in texts]
    train = [t for i, t in enumerate(toks) if zlib.crc32(str(i).encode()) % 10]
    grams = [collections.Counter(tuple(t[i : i + m]) for t in train for i in range(len(t) - m + 1)) for m in range(1, 5)]
    total, distinct = sum(grams[0].values()), len(grams[0])
    prior = lambda w: (grams[0][(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
    nexts = [collections.defaultdict(dict) for _ in range(4)]
    for m in (1, 2, 3):
        for g, n in grams[m].items():
            if n >= 2 and grams[m - 1][g[:-1]] >= 8:
                nexts[m][g[:-1]][g[-1]] = n

    def mixed(c, w, kept=None):
        if not c:
            return prior(w)
        below = mixed(c[1:], w, kept)
        own = nexts[len(c)].get(c)
        if not own or (kept is not None and c not in kept):
            return below
        occurs = grams[len(c) - 1][c]
        rest = 1 - sum(n - 0.5 for n in own.values()) / occurs
        return max(own.get(w, 0) - 0.5, 0) / occurs + rest * below

    kept = set()
    for m in (3, 2, 1):
        for c, own in nexts[m].items():
            occurs = grams[m - 1][c]
            rest = 1 - sum(n - 0.5 for n in own.values()) / occurs
            gain = sum(n * math.log(mixed(c, w) / mixed(c[1:], w)) for w, n in own.items()) + (occurs - sum(own.values())) * math.log(max(rest, 1e-12))
            if gain >= max(0.01 * occurs, 0.5 * math.log(total)):
                kept |= {c[i:] for i in range(m)}
    assert ("rare",) in kept and 8 <= grams[0][("rare",)] < 2e-5 * total
    got = {r["doc_id"]: r for r in L.score(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for i, t in enumerate(toks):
        wanted = sum(math.log10(mixed(tuple(t[max(0, j - 3) : j]), w, kept)) for j, w in enumerate(t))
        assert abs(got[i]["score"] - wanted) < 1e-6 * max(1, len(t))
        assert abs(got[i]["base_score"] - sum(math.log10(prior(w)) for w in t)) < 1e-6 * max(1, len(t))
        assert got[i]["n_known"] == sum((w,) in grams[0] for w in t)


def test_tool_links_keep_null_ids(spark):
    calls = [(1, "x", 0, "add", "{}", None), (1, None, 1, "add", '{"a": 1}', ["x", "nobody"]), (1, None, 1, "add", '{"a": 1}', ["x", "nobody"]), (2, None, 0, "add", "no", None), (None, None, 0, "add", "{}", ["x"])]
    results = [(1, None, 2, "r"), (None, None, 3, None)]
    got = K.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"add": {"properties": {"a": {"type": "integer"}}}}).collect()
    rows = collections.Counter((r["conv_id"], r["status"], r["position"], r["result_position"], r["step"], r["valid"], r["content"]) for r in got if r["call_id"] is None)
    assert rows == {(1, "open", 1, None, 1, True, None): 2, (2, "open", 0, None, 0, False, None): 1, (None, "open", 0, None, None, True, None): 1, (1, "orphan", None, 2, None, False, "r"): 1, (None, "orphan", None, 3, None, False, None): 1}


def test_keep_one_with_text_ids_nulls_and_clashing_names(spark):
    body = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [("z", body[0], "1", 7), ("b", body[0] + " tail", "2", 7), (None, body[0], "3", 7), ("c", body[1], "4", 7), ("c", body[1], "4", 7), (None, body[2], "5", 7), ("e", "", "6", 7), ("f", None, "7", 7), ("f", None, "7", 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __t string, s int")
    got = J.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or "", r["__t"]) for r in got.collect()) == [("", "5"), ("b", "2"), ("c", "4"), ("e", "6"), ("f", "7"), ("f", "7")]
    joined = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in J.join(docs, 5, 80).collect()}
    assert joined["z", 56] == joined[None, 56] == "b" or joined["z", 56] == "b"
    assert joined["e", 0] == "e" and joined["f", 0] == "f"
    assert J.keep_one(docs.limit(0)).count() == 0


def test_suffix_tree_of_an_empty_table(spark):
    assert L.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffix_tree_counts_in_parts(spark, monkeypatch):
    """Counts are the same however often they leave Python, and hashes can be read back."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7} a b d{i % 5}") for i in range(300)] + [(300, None), (301, "")], SCHEMA)
    whole = {(r["ctx"], r["word"], r["key"]): r["n"] for r in L._counted(docs, L._first, "text").collect()}
    monkeypatch.setattr(L, "GATHER", 64)
    monkeypatch.setattr(L, "MERGE", 16)
    rows = L._counted(docs.repartition(3), L._first, "text").collect()
    assert len(rows) == len(whole) and {(r["ctx"], r["word"], r["key"]): r["n"] for r in rows} == whole
    a, b = (int(x) for x in hashing.Words(["a b"]).hash.view(np.int64))
    assert {n for (ctx, word, _), n in whole.items() if (ctx, word) == (a, b)} == {600}


def test_suffix_tree_sends_a_key_for_each_open_part(spark):
    """What the cache leaves open leaves Python as one key a part: no lists of parts are stored beside their own shuffle."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7} a b d{i % 5}") for i in range(300)], SCHEMA)
    plan = L.score(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
