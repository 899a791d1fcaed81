"""Secret scans behind a trigram inverted index.

From each rule's regex a Boolean query over lower-case trigrams is derived: what any match must
contain. Postings (row key, trigram) are made for the trigrams that some query names, intersected
per text, and only candidate texts are verified with the regex itself. A rule without mandatory
trigrams (a run of hex digits) scans every text.

Edge cases: a null text counts as empty; rows that repeat share one posting list and are each verified
and returned; ids may repeat or be null; an empty table gives an empty one; a very long text is scanned whole; scan() carries no
other columns, redact() all, whatever their names. Offsets are code points, end exclusive. The row key is a 64-bit hash: a collision could only
add a candidate, never hide one.
"""

from __future__ import annotations

import re
import re._parser as sre  # the standard library's own reader of regexes
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_struct, indexes, let, lower_ascii, prefix_sums


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more are secrets."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order of the kinds. The first three are the base; the others only add.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")
#: More alternatives than this are not multiplied out; their trigrams are then not mandatory.
MOST = 16

# A query is True, a trigram, or ("and" | "or", frozenset of queries).


def _all(parts):
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts):
    parts = frozenset(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of(strings) -> object:
    """One of these strings occurs."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(items) -> tuple[set[str] | None, object]:
    """(every string that these parsed items match, or None if too many; a query for what is not in it)."""
    exact, query = {""}, True
    parts = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            parts.append(({chr(arg).lower()}, True))
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MOST:
            parts.append(({chr(a).lower() for _, a in arg}, True))
        elif name == "SUBPATTERN":
            parts.append(_strings(arg[3]))
        elif name == "BRANCH":
            subs = [_strings(x) for x in arg[1]]
            ok = all(e is not None for e, _ in subs)
            parts.append((set().union(*(e for e, _ in subs)) if ok else None, True if ok else _any(_all([q] + ([_of(e)] if e else [])) for e, q in subs)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, sub = arg
            e, q = _strings(sub)
            parts.append((e | {""}, True) if (least, most) == (0, 1) and e is not None else (None, q if least else True))
        else:
            parts.append((None, True))
    whole = True
    for e, q in parts:
        query = _all([query, q])
        if e is None or len(exact) * len(e) > MOST:
            query, whole = _all([query, _of(exact)]), False
            exact = e if e is not None else {""}
        else:
            exact = {a + b for a in exact for b in e}
    if whole and query is True:
        return exact, True
    return None, _all([query, _of(exact)])


def trigram_query(pattern: str):
    """The Boolean query over trigrams of lower-case text that every match of pattern satisfies."""
    exact, query = _strings(sre.parse(pattern))
    return query if exact is None else _all([query, _of(exact)])


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    out = None
    for q in sorted(query[1], key=repr):
        c = _holds(q, has)
        out = c if out is None else (out & c if query[0] == "and" else out | c)
    return out


def _key(docs: DataFrame, text_col: str) -> Column:
    """What rows meet their postings by: ids where there are some, so that copies of a text do not all meet in one task; equal keys have equal texts,
    or, if hashes collide, rules that are tried in vain."""
    return F.xxhash64(*[c for c in ("doc_id",) if c in docs.columns], text_col)


def postings(docs: DataFrame, wanted: list[str], text_col: str = "text") -> DataFrame:
    """The index: (row key, trigram), for the wanted trigrams that the text has in either case."""
    low = docs.select(_key(docs, text_col).alias("key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    listed = F.array(*[F.lit(t) for t in wanted])
    return low.select("key", F.explode(F.filter(listed, lambda t: F.contains(F.col("_low"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """(row key, array of rule numbers whose trigram query holds), for texts with any such rule."""
    queries = [(i, trigram_query(r.pattern)) for i, r in enumerate(rules)]
    queries = [(i, q) for i, q in queries if q is not True]
    wanted = sorted(set().union(set(), *(trigrams(q) for _, q in queries)))
    have = postings(docs, wanted, text_col).groupBy("key").agg(F.collect_set("trigram").alias("_has"))  # at most all wanted
    hits = [F.when(_holds(q, lambda t: F.array_contains("_has", t)), F.lit(i)) for i, q in queries]
    found = have.select("key", (F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")).alias("rules"))
    return found.where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """(start, kind number, end) of each leftmost non-overlapping match that is long enough.

    Spark gives matched strings but no offsets; what lies between the matches gives those.
    """
    pattern = F.lit(rule.pattern)
    lengths = lambda strings: F.transform(strings, lambda s: F.char_length(s))

    def build(x: Column) -> Column:
        before = let(
            F.zip_with(x["gap"], x["len"], lambda g, n: g + F.coalesce(n, F.lit(0))),
            lambda steps: prefix_sums(steps),
        )
        starts = F.zip_with(before, x["gap"], lambda b, g: b + g)
        made = let(
            starts,
            lambda s: F.transform(
                F.filter(indexes(F.size(x["len"])), lambda j: F.get(x["size"], j) >= rule.least),
                lambda j: as_struct(start=F.get(s, j), kind=F.lit(number), end=F.get(s, j) + F.get(x["len"], j)),
            ),
        )
        return made

    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    return let(
        as_struct(
            gap=lengths(F.split(text, rule.pattern, -1)),
            len=whole,
            size=lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole,
        ),
        build,
    )


def _with_spans(docs: DataFrame, rules, text_col: str) -> DataFrame:
    """Each input row as the struct ``__row`` (so its names cannot clash), its text, and all its spans in order."""
    found = candidates(docs, rules, text_col).select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
    base = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"), _key(docs, text_col).alias("__k"))
    joined = base.join(found, F.col("__k") == F.col("__key"), "left")
    parts = []
    for i, r in enumerate(rules):
        run = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        # of a pattern that is one run, the long runs are just the matches that are long enough
        use = Rule(r.kind, f"{run[1]}{{{r.least},}}", r.group, r.least) if run else r
        asked = F.col("__t").rlike(use.pattern) if trigram_query(r.pattern) is True else F.coalesce(F.array_contains("__rules", i), F.lit(False))
        parts.append(F.when(asked, spans_of(F.col("__t"), use, i)).otherwise(NO_SPANS()))
    return joined.select("__row", "__t", F.sort_array(F.concat(*parts)).alias("secrets"))


def NO_SPANS() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, and ``secrets``, its sorted array of (start, kind number, end)."""
    return _with_spans(docs, rules, text_col).select(F.col(f"__row.{id_col}").alias(id_col), "secrets")


def labels(spans: Column, rules=RULES) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, mark: str = "[secret]", rules=RULES, text_col: str = "text") -> DataFrame:
    """docs with the characters of each secret replaced by a mark; all columns and rows stay. Of
    overlapping secrets the union goes, under one mark."""
    step = lambda a, x: F.when(
        x["start"] >= a["at"],
        as_struct(at=x["end"], out=F.concat(a["out"], F.array(as_struct(start=a["at"], end=x["start"])))),
    ).otherwise(as_struct(at=F.greatest(a["at"], x["end"]), out=a["out"]))
    start = as_struct(at=F.lit(0), out=F.array().cast("array<struct<start:int,end:int>>"))
    end = lambda a: F.concat(a["out"], F.array(as_struct(start=a["at"], end=F.lit(2**31 - 1))))
    between = F.aggregate("secrets", start, step, end)
    clean = F.array_join(F.transform(between, lambda s: F.substring(F.col("__t"), s["start"] + 1, s["end"] - s["start"])), mark)
    text = F.when(F.size("secrets") > 0, clean).otherwise(F.col(f"__row.{text_col}"))
    return _with_spans(docs, rules, text_col).select(*[text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    s = scan(read(spark, sf_dir, "documents"))
    number = {r.kind: i for i, r in enumerate(RULES)}
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == number[kind])).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < len(BASE))
    return s.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(labels(base), 256).alias("base_sha256"),
        labels(F.col("secrets")).alias("spans"),
    )


def sql(docs: str) -> str:
    """The same for DuckDB: matches and what lies between them give the offsets."""
    either = re.sub(r"\(\?i:(.*?)\)\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", RULES[0].pattern)
    parts = []
    for i, r in enumerate(RULES):
        pattern = (either if i == 0 else r.pattern).replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS m, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS g, regexp_split_to_array(t, '{pattern}') AS gap FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}),
m AS ({" UNION ALL ".join(parts)}),
j AS (SELECT rid, k, kind, least, j, length(m[j]) AS n, length(g[j]) AS sz, length(gap[j]) AS gap
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM m WHERE len(m) > 0)),
s AS (SELECT rid, k, kind, n, sz, least, (sum(gap) OVER w + sum(n) OVER w - n)::BIGINT AS start FROM j WINDOW w AS (PARTITION BY rid, k ORDER BY j)),
f AS (SELECT rid, k, kind, start, kind || ':' || start || ':' || (start + n) AS label FROM s WHERE sz >= least),
r AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
             string_agg(label, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(label, ',' ORDER BY start, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON r.rid = d.rid
"""
