"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps what was measured and one bit for each
failed rule. Policies are versioned sets of rules applied to the bits later, and ablations are
bitwise aggregates over the ledger, so neither touches the texts again.

Edge cases: a null text counts as empty (0 words, so ``too_short`` fails); repeated rows and null
ids stay as they are, one ledger row for each input row; columns of the input other than the id
and the text are not carried, so they cannot clash; an empty table gives an empty ledger, and ablations of none; a very
long text is measured whole, in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_struct, indexes, let, words

SYMBOLS = r"[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def repeated_words(w: Column, size: int = 3) -> Column:
    """How many words lie in a window of ``size`` words that the text has twice or more.

    Windows are sorted with their places, so that equal ones become neighbours: n log n in the
    document's own length, and no shuffle.
    """
    grams = F.transform(
        indexes(F.size(w) - (size - 1)),
        lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]).alias("s"), i.alias("i")),
    )
    same = lambda a, j, k: F.coalesce(F.get(a, j)["s"] == F.get(a, j + k)["s"], F.lit(False))
    found = let(
        F.sort_array(grams),
        lambda a: F.transform(
            F.filter(indexes(F.size(a)), lambda j: same(a, j, -1) | same(a, j, 1)), lambda j: F.get(a, j)["i"]
        ),
    )
    covered = let(
        F.sort_array(found),
        lambda p: F.aggregate(
            indexes(F.size(p)),
            F.lit(0),
            lambda total, j: total + F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(size))),
        ),
    )
    return covered.cast("long")


def measures(text: Column) -> Column:
    """A struct of all measurements of one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
    return let(
        words(t),
        lambda w: as_struct(
            n_words=F.size(w).cast("long"),
            word_chars=F.char_length(F.array_join(w, "")).cast("long"),
            n_symbols=F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            n_lines=let(lines, lambda x: as_struct(all=F.size(x), distinct=F.size(F.array_distinct(x)))),
            n_repeat_words=repeated_words(w),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where the SQL condition over the measurements holds. ``bit`` never changes once published."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_mean_word", "word_chars < 2 * n_words"),
    Rule(5, "long_mean_word", "word_chars > 15 * n_words"),
)

#: Version -> names of the rules that reject.
POLICIES = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbol_heavy", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "v2"


def mask(policy: str) -> int:
    by_name = {r.name: r for r in RULES}
    return sum(1 << by_name[n].bit for n in POLICIES[policy])


def _judged(docs: DataFrame, text_col: str) -> DataFrame:
    """Each input row as the struct ``__row`` (so its names cannot clash), the measurements, and the failure bits."""
    m = docs.select(F.struct("*").alias("__row"), measures(F.col(text_col)).alias("__m")).select(
        "__row",
        *[F.col(f"__m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.col("__m.n_lines.all").cast("long").alias("n_lines"),
        (F.col("__m.n_lines.all") - F.col("__m.n_lines.distinct")).cast("long").alias("n_dup_lines"),
        F.col("__m.n_repeat_words").alias("n_repeat_words"),
    )
    bits = sum(
        (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES),
        F.lit(0).cast("long"),
    )
    return m.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``fail_bits`` with bit r.bit set for each failed rule."""
    judged = _judged(docs, text_col)
    return judged.select(F.col(f"__row.`{id_col}`").alias(id_col), *judged.columns[1:])


def keep(docs: DataFrame, policy: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that a policy does not reject."""
    kept = _judged(docs, text_col).where(passes(policy or DEFAULT_POLICY))
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def passes(policy: str, bits: Column | str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    c = F.col(bits) if isinstance(bits, str) else bits
    return c.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (so would be kept without
    it), and that the policy rejects at all. Counts are made once for each bit pattern, at most 2^rules.
    """
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    rows = F.explode(F.array(*[as_struct(rule=F.lit(r.name), rule_bit=F.lit(1 << r.bit)) for r in rules]))
    has = F.col("bits").bitwiseAND(F.col("r.rule_bit")) != 0
    return (
        by_bits.select("bits", "n", rows.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.rule_bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    led = ledger(read(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        (passes("base") & passes(DEFAULT_POLICY)).alias("kept"),
        "n_lines", "fail_bits",
    )


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """The ablations of every version of the policy, from one ledger."""
    from functools import reduce

    from .common import read, stored

    led = stored(ledger(read(spark, sf_dir, "documents")).select("fail_bits"), "quality-ledger")
    return reduce(DataFrame.unionByName, [ablations(led, p).withColumn("policy", F.lit(p)) for p in POLICIES])


#: The same in DuckDB; {docs} is the table it reads.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""


def ablation_sql(docs: str) -> str:
    """The same in DuckDB."""
    head = SQL.format(docs=docs)
    head = head[: head.rindex("SELECT doc_id, n_words")]
    of = lambda p, r: (
        f"SELECT '{p}' AS policy, '{r.name}' AS rule, count(*) FILTER (fail_bits & {1 << r.bit} <> 0)::BIGINT AS n_failed, "
        f"count(*) FILTER (fail_bits & {mask(p)} = {1 << r.bit})::BIGINT AS n_only_this, count(*) FILTER (fail_bits & {mask(p)} <> 0)::BIGINT AS n_rejected FROM b"
    )
    return head + " UNION ALL ".join(of(p, r) for p in POLICIES for r in RULES if r.name in POLICIES[p])
