"""Conversation trie, URL filter and spelling variants against brute force."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import pytest

from jobloom.llm import prefix_trie as P
from jobloom.llm import spelling_variants as V
from jobloom.llm import url_filter as U

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_hand(convs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, sha) of each node; convs: id to a list of (role, text)."""
    members = collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = {}
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = lambda x: sum(len(q) == len(x) + 1 and q[: len(x)] == x for q in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[min(m), len(p)] = (parent, len(m), kids(p), sum(not kids(q) for q in under), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def rebuilt(rows, every=100, most=6):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % every, [])[:h] + turns[h:]
    return out


def trie_cases(seed):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "user", "é" * 30_000)]
    for c in [*range(200, 300), *range(301, 340), *range(4090, 4180, 3)]:
        for t in range(rng.choice([1, 2, 3, 3, 8])):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(["", "a", "b", "ab"]) if c % 3 else "same"))
    return rows


def test_trie(spark):
    rows = trie_cases(5)
    turns = spark.createDataFrame([(*r, "x") for r in rows], f"{TURNS}, digest string").repartition(5)
    want = trie_by_hand(rebuilt(rows))
    for block in (1, 7, 1000):
        got = P.trie(P.shared_starts(P.conversations(turns)), block).collect()
        assert len(got) == len(want)
        for r in got:
            assert tuple(r)[2:] == want[r["conv_id"], r["depth"]]
    assert P.trie(P.shared_starts(P.conversations(turns.limit(0)))).count() == 0


def test_trie_of_copies_in_several_runs(spark):
    """Equal conversations whose ids fill more than one run, and a conversation without turns."""
    convs = {c: [("user", "hi")] for c in range(9000)} | {20_000: [], -3: [("user", "hi"), ("assistant", "yo")]}
    made = spark.createDataFrame([(c, [(hashlib.sha256(f"{r}{t}".encode()).hexdigest()[:32], len(t)) for r, t in x]) for c, x in convs.items()], "conv_id long, turns array<struct<d:string,n:int>>")
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in P.trie(made).collect()}
    ends = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {
        (-3, 0): (None, 9002, 1, 1, 18_000, ends([20_000])),
        (-3, 1): (-3, 9001, 1, 1, 18_000, ends(range(9000))),
        (-3, 2): (-3, 1, 0, 1, 0, ends([-3])),
    }


def test_range_min_extents():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.integers(0, 5, n)
        index = P.RangeMin(v)
        at = np.repeat(np.arange(n), 6)
        least = np.tile(np.arange(6), n)
        left, right = index.left(at, least), index.right(at, least)
        for i, k, a, b in zip(at, least, left, right, strict=True):
            low = i
            while low > 0 and v[low] >= k:
                low -= 1
            high = i
            while high + 1 < n and v[high + 1] >= k:
                high += 1
            assert (low, high) == (a, b)
            assert index.over(np.array([a]), np.array([b]))[0] == v[a : b + 1].min()


PAGES = "page_id long, url string"


def url_by_hand(url, rules=U.RULES):
    """(host, path, rule, verdict, text) of a URL."""
    if url is None or "://" not in url:
        return "", "", None, None, url or ""
    rest = url.split("://", 1)[1]
    host, after = re.fullmatch(r"([^/?#]*)(.*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", after)[0]
    fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    _, r, v = max(fits) if fits else (0, None, None)
    return host, path, r, v, host + after


def likelihood(texts, text):
    """log10 probability of text under a model of texts, by plain counting."""
    pad = lambda t: [None] * U.ORDER + list(t) + ["end"]
    seen = collections.defaultdict(collections.Counter)
    for t in map(pad, texts):
        for i in range(U.ORDER, len(t)):
            for o in range(U.ORDER + 1):
                seen[tuple(t[i - o : i])][t[i]] += 1
    total, t = 0.0, pad(text)
    for i in range(U.ORDER, len(t)):
        p = 1 / U.SYMBOLS
        for o in range(U.ORDER + 1):
            c = seen.get(tuple(t[i - o : i]), {})
            n = sum(c.values())
            if n >= U.LEAST:
                p = (c.get(t[i], 0) + len(c) * p) / (n + len(c))
        total += math.log10(p)
    return total


def urls(seed, n=400):
    rng = random.Random(seed)
    host = lambda: "".join(rng.choice("abcst") for _ in range(4))
    return [f"http{rng.choice(['', 's'])}://{host()}.{rng.choice(['Example.org', 'example.com', 'b.net'])}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.randint(1, 300)}{rng.choice(['', '/', '?a=1', '#x'])}" for _ in range(n)]


ODD = [None, "", "org/es/", "x", "http://", "https://ORG", "https://org/", "a://b://org/x", "http://notorg/fr/", "http://eXample.org/es/?u=http://com/de/", "http://a.com/de", "http://a.com/fr/\n?x",
       "http://é.com/de/ü#", "http://example.org/en/1/" + "é" * 40_000, "http://x.net/de/" + "b" * 40_000, "HTTP://a.org?/es/"]


def test_url_rules_and_scores(spark):
    rows = [*enumerate(ODD + urls(3)), (None, "http://a.net/de/1"), (5, "https://ORG")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], f"{PAGES}, verdict string").repartition(3)
    got = collections.Counter(tuple(r)[:5] for r in U.parsed(pages).select("id", "host", "path", "rule", "verdict").collect())
    assert got == collections.Counter((i, *url_by_hand(u)[:4]) for i, u in rows)
    judged = U.judge(pages).collect()
    assert len(judged) == len(rows)
    for r in judged:
        v = url_by_hand(dict(rows)[r["page_id"]] if r["page_id"] is not None else "http://a.net/de/1")[3]
        assert r["verdict"] in ("allow", "block") and (v is None or r["verdict"] == v) and r["score"] is not None
    by_id = {r["page_id"]: r["verdict"] for r in judged}
    nets = [(by_id[i], u) for i, u in rows if u and i is not None and "b.net" in u]
    assert sum(v == "block" for v, u in nets if "/es/" in u) > 0.9 * sum("/es/" in u for _, u in nets)
    assert sum(v == "allow" for v, u in nets if "/fr/" in u) > 0.9 * sum("/fr/" in u for _, u in nets)


def test_url_model(spark):
    """Scores equal those of plain counting; the threshold is the best cut."""
    train = [(url_by_hand(u)[3], url_by_hand(u)[4]) for u in urls(4, 120)]
    train = [(v, t) for v, t in train if v] + [("allow", ""), ("block", "")]
    models = U.fit(spark.createDataFrame(train, "verdict string, text string").repartition(3))
    texts = [url_by_hand(u)[4] for u in urls(5, 20)] + ["", "ü\U0001f600"]
    made = {r["text"]: r["score"] for r in U.scored(spark.createDataFrame([(t,) for t in texts], "text string"), models).collect()}
    for t in texts:
        a, b = (likelihood([x for v, x in train if v == k], t) for k in ("allow", "block"))
        assert made[t] == pytest.approx((a - b) / (len(t) + 1), abs=1e-9)
    assert U.threshold([("allow", 1.0), ("allow", -0.5), ("block", -1.0), ("block", -2.0)]) == -0.5
    assert U.threshold([("allow", 1.0)]) == 0.0


def test_url_filter_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.org/")], PAGES)
    assert sorted(map(tuple, U.judge(pages).collect())) == [(1, "a.net", "/x", None, "allow", None), (2, "a.org", "/", "org/", "allow", None)]
    assert U.judge(pages.limit(0)).count() == 0


def test_url_filter_held_out(spark):
    """Accuracy on labelled URLs that neither the models nor the threshold have seen."""
    rows = sorted({(v, t) for *_, v, t in map(url_by_hand, urls(6, 5000)) if v})
    random.Random(1).shuffle(rows)
    models = U.fit(spark.createDataFrame(rows[:1200], "verdict string, text string"))
    score = lambda part: [(r["verdict"], r["score"]) for r in U.scored(spark.createDataFrame(part, "verdict string, text string"), models).collect()]
    cut = U.threshold(score(rows[1200:1400]))
    new = score(rows[1400:])
    assert len(new) > 300 and sum((s >= cut) == (v == "allow") for v, s in new) > 0.93 * len(new)


def variants_by_hand(counts):
    """word to (form, root, n, n_near, form_n)."""
    def near(w):
        letters = set("".join(counts))
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        swap = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return [x for x in cut | put | swap if x in counts and x != w]

    forms, kinds = {}, {w: near(w) for w in counts}
    for w, xs in kinds.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w, f in forms.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (f, root, counts[w], len(kinds[w]), counts[f] if f else None)
    return out


def vocabulary_cases(seed):
    rng = random.Random(seed)
    out = {}
    for _ in range(700):
        w = "".join(rng.choice("ab" if rng.random() < 0.8 else "abcé×") for _ in range(rng.randint(5, 10)))
        out[w] = rng.choice([3, 4, 5, 6, 8, 12, 24, 50, 100])
    for c in ("abcdefgh", "aaaaaaaaaaaaaaa"):  # one front half that many words share, and chains
        for i in range(60):
            out[c + "".join(rng.choice("xyz") for _ in range(5))] = 3 << i % 8
    long = "".join(rng.choice("abc") for _ in range(3000))
    return out | {long: 3, long[:1000] + "z" + long[1000:]: 7, long[:-1]: 20, long[:-2] + "qq": 9}


@pytest.mark.parametrize("hot", [3, 40, 20_000])
def test_spelling_variants(spark, hot):
    counts = vocabulary_cases(hot)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = variants_by_hand(counts)
    for shard in (60, 40_000):
        got = V.variants(words, shard, hot).collect()
        assert {r["word"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_words_of_variants(spark):
    rng = random.Random(9)
    texts = [None, "", "É×÷ÀZ Étage étage", "x" * 50_000 + " naïveté"]
    texts += [" ".join(rng.choice(["Hello", "world", "naïve", "naïveté", "abcd", "ABCDE", "İstanbul", "straße1straße"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(12, texts[12])]
    seen = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    want = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    got = {r["word"]: r["n"] for r in V.vocabulary(V.runs(docs)).collect()}
    assert got == want
    assert {r["word"]: tuple(r)[1:] for r in V.variants(V.vocabulary(V.runs(docs))).collect()} == variants_by_hand(want)
    assert V.variants(V.vocabulary(V.runs(docs.limit(0)))).count() == 0


def links_by_hand(calls, results, schemas):
    """Rows of link() by plain loops: (conv, id, position, result position, step, status, valid)."""
    from jobloom.llm import tool_links as K

    last = 1 << 40
    by = lambda rows: sorted(rows, key=lambda r: last if r[2] is None else r[2])
    firsts, got, out = {}, {}, []
    valid = lambda c: c[3] in schemas and isinstance(json.loads(c[4]), dict) and K.fits(json.loads(c[4]), schemas[c[3]])
    for c in by(calls):
        k = c[:2]
        if k in firsts:
            out.append((*k, c[2], None, None, "repeated", False))
        else:
            firsts[k] = c
    for r in by(results):
        if r[:2] in got:
            out.append((*r[:2], None, r[2], None, "repeated", False))
        else:
            got[r[:2]] = r
    waits = {k: {(k[0], w) for w in c[5]} & set(firsts) for k, c in firsts.items()}
    step, n = {}, 0
    while ready := [k for k in firsts if k not in step and all(w in step for w in waits[k])]:
        step |= dict.fromkeys(ready, n)
        n += 1
    for k in set(firsts) | set(got):
        c, r = firsts.get(k), got.get(k)
        status = "orphan" if c is None else "open" if r is None else "early" if r[2] <= c[2] else "linked"
        out.append((*k, c and c[2], r and r[2], step.get(k), status, bool(c and valid(c))))
    return collections.Counter(out)


SCHEMA_CASES = {
    "add": {"properties": {"a": {"type": "integer"}, "b": {"type": ["number", "null"]}}, "required": ["a"], "additionalProperties": False},
    "find": {"properties": {"q": {"type": "object", "properties": {"k": {"enum": ["x", 1]}}, "required": ["k"]}, "tags": {"type": "array", "items": {"type": "string"}}}},
}


def test_tool_links_by_hand(spark):
    from jobloom.llm import tool_links as K

    rng = random.Random(11)
    texts = ['{"a":1}', '{"a":1.0,"b":null}', '{"a":1.5}', '{"b":2}', '{"a":1,"c":2}', "[]", "7", '{"q":{"k":"x"},"tags":["t"]}', '{"q":{"k":1.0}}', '{"q":{"k":2}}', '{"tags":[1]}', '{"q":null}', "{}"]
    calls = [(rng.randint(1, 6), f"c{rng.randint(1, 9)}", rng.randint(0, 50), rng.choice(["add", "find", "none"]), rng.choice(texts), [f"c{rng.randint(1, 10)}" for _ in range(rng.randint(0, 2))]) for _ in range(60)]
    calls = list({(c[0], c[1], c[2]): c for c in calls}.values())
    results = list({(r[0], r[1], r[2]): r for r in [(rng.randint(1, 6), f"c{rng.randint(1, 12)}", rng.randint(0, 60), "r") for _ in range(50)]}.values())
    made = K.link(
        spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, waits_for array<string>").repartition(3),
        spark.createDataFrame(results, "conv_id long, call_id string, position long, content string"), SCHEMA_CASES,
    ).select("conv_id", "call_id", "position", "result_position", "step", "status", "valid").collect()
    assert collections.Counter(map(tuple, made)) == links_by_hand(calls, results, SCHEMA_CASES)
    empty = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, waits_for array<string>").limit(0)
    assert K.link(empty, spark.createDataFrame(results[:0], "conv_id long, call_id string, position long, content string"), SCHEMA_CASES).count() == 0


def test_canonical_json():
    from jobloom.llm import tool_links as K

    cases = {
        "1.0": "1", "1e2": "100", "1e25": "1e+25", "100.0": "100", "-0.0": "0", "0.1": "0.1", "1E-7": "1e-7", "1.5e-9": "1.5e-9", "0.000001": "0.000001", "1.25e-5": "0.0000125", "123456789012345678901234567890": "123456789012345678901234567890", "1e21": "1e+21", "1.5e300": "1.5e+300",
        '{"b":1,"a":{"d":[1.50,2],"c":"\\u00e9\\n"}}': '{"a":{"c":"é\\n","d":[1.5,2]},"b":1}', '"\\u0007\\/"': '"\\u0007/"', "null": "null", " [ true , false ] ": "[true,false]",
    }
    for text, want in cases.items():
        assert K.written(K._parsed(text)) == want, text
    for bad in ('{"a":1,"a":2}', "{", "NaN", "", "[1,]"):
        with pytest.raises(ValueError):
            K._parsed(bad)


def test_url_filter_learns_from_every_row(spark, monkeypatch):
    """No labelled row is left out: more than 10 000 a verdict, long URLs among them; the same scores with a cache of a few grams; the cut is that of threshold()."""
    assert not hasattr(U, "SAMPLE")
    long = "q" * 300
    train = [("allow", f"a.org/{i}") for i in range(12_000)] + [("block", f"com/de/{i}") for i in range(12_000)] + [("block", long)]
    model = U.fit(spark.createDataFrame(train, "verdict string, text string").repartition(3))
    ends = model.where(model.back.bitwiseAND((1 << 21) - 1) == U.END).groupBy().sum("allow", "block").first()
    assert tuple(ends) == (12_000, 12_001)
    q = sum(ord("q") << 21 * i for i in range(3))
    assert model.where((model.front == q) & (model.back == q)).first()["block"] == 295
    texts = spark.createDataFrame([("a.org/77",), (long,), ("",), ("com/de/9/ü",)], "text string")
    whole = sorted(map(tuple, U.scored(texts, model).collect()))
    monkeypatch.setattr(U, "CACHED", 3)
    assert sorted(map(tuple, U.scored(texts, model).collect())) == whole
    rng = random.Random(2)
    for shift in (0, 3, -9):
        rows = [(v, round(rng.gauss(m, 1), 1) + shift) for v, m in (("allow", 0.5), ("block", -0.5)) for _ in range(60)]
        assert U.best_cut(spark.createDataFrame(rows, "verdict string, score double")) == U.threshold(rows)
    assert U.best_cut(spark.createDataFrame([("allow", -2.0), ("block", -1.0)], "verdict string, score double")) == 0.0
