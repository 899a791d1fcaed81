"""Tool calls linked with their results, in order, checked and written as canonical JSON.

Calls and results meet in a join on conversation and call id. A call may name calls it waits for; its
``step`` is one more than the last of theirs, found by peeling what waits for nothing, and whatever
is left then waits for itself. Arguments are checked against the tool's schema (nested objects, items of arrays, enums, additional properties) and
written as canonical JSON in Arrow batches.

Edge cases: of calls with one id in a conversation the first in position counts and the others are
``repeated``, likewise results; a result without a call has a row too (``orphan``); a call without one has a null
result; calls and results with a null id link with nothing and are ``open`` and ``orphan``, each row by itself; arguments that are no JSON, or that repeat a key of
an object, are invalid and serialised as null; JSON that is no object is invalid; a name without a schema is invalid; empty tables give no rows; long arguments are read whole; ids named as dependencies that no call has are ignored. Extra columns are not carried.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KEYS = ["conv_id", "call_id"]


def _parsed(text: str):
    """A JSON value; an error for what is no JSON, NaN and infinities, and objects that repeat a key."""

    def pairs(items):
        found = dict(items)
        if len(found) < len(items):
            raise ValueError("repeated key")
        return found

    def constant(name):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def _number(x: float) -> str:
    """A number that is no integer literal, as JavaScript writes it: whole ones without a fraction, exponents from 1e21 up and below 1e-6."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        if abs(x) >= 1e-6:
            return digits
        digits, _, exponent = f"{x:e}".partition("e")
        digits = min((f"{x:.{n}e}" for n in range(17)), key=lambda t: (float(t) != x, len(t))).partition("e")[0]
    e = int(exponent)
    if -7 < e < 0:
        return f"{x:.{max(0, -e + len(digits.replace('-', '').replace('.', '')) - 1)}f}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def written(value) -> str:
    """Canonical JSON: keys in order of their UTF-16 units, no spaces, numbers in one form whichever way they were spelled, only what must be escaped is."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "integer": number and value == int(value), "number": number, "boolean": isinstance(value, bool),
        "array": isinstance(value, list), "object": isinstance(value, dict), "null": value is None,
    }[kind]


def fits(value, schema: dict) -> bool:
    """Whether a value has the type of its schema (one or one of several; whole numbers are integers), is in its enum, and its properties and items fit
    theirs: required ones are there, others may be absent or null, and those without a schema are as additionalProperties says (any by default)."""
    kinds = schema.get("type", ())
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return False
    if "enum" in schema and written(value) not in {written(x) for x in schema["enum"]}:
        return False
    if isinstance(value, list):
        return all(fits(x, schema.get("items", {})) for x in value)
    if not isinstance(value, dict):
        return True
    known, needed, more = schema.get("properties", {}), schema.get("required", ()), schema.get("additionalProperties", True)
    if any(k not in value for k in needed):
        return False
    for k, x in value.items():
        if k in known:
            if not (x is None and k not in needed) and not fits(x, known[k]):
                return False
        elif more is False or (isinstance(more, dict) and not fits(x, more)):
            return False
    return True


def checked(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """A struct of ``valid`` (an object that fits the tool's schema) and ``json`` (its canonical form, null if it is no JSON)."""

    @F.pandas_udf("valid boolean, json string")
    def check(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for tool, text in zip(names, texts, strict=True):
            try:
                value = _parsed(text) if text is not None else None
                rows.append((tool in schemas and isinstance(value, dict) and fits(value, schemas[tool]), written(value) if text is not None else None))
            except (ValueError, RecursionError, OverflowError):
                rows.append((False, None))
        return pd.DataFrame(rows, columns=["valid", "json"])

    return check(name, arguments)


def canonical(text: Column) -> Column:
    """JSON in canonical form; null if it is not JSON."""
    return checked(F.lit(""), text, {})["json"]


def steps(calls: DataFrame) -> DataFrame:
    """KEYS and step: 0 for calls that wait for nothing, null for those in or behind a circle."""
    waits = calls.select(*KEYS, F.explode(F.array_distinct("waits_for")).alias("other")).where("other is not null")
    there = calls.select("conv_id", F.col("call_id").alias("other")).distinct()
    waits = stored(waits.join(there, ["conv_id", "other"], "left_semi"), "waits")
    open_ = stored(calls.select(*KEYS).distinct(), "open")
    done, step = None, 0
    while True:
        ready = open_.join(waits.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("step", F.lit(step))
        ready = stored(ready, "ready")
        done = ready if done is None else done.unionByName(ready)
        if ready.isEmpty():
            return done.unionByName(open_.withColumn("step", F.lit(None).cast("int")))
        open_ = stored(open_.join(ready, KEYS, "left_anti"), "open")
        finished = ready.select("conv_id", F.col("call_id").alias("other"))
        waits = stored(waits.join(finished, ["conv_id", "other"], "left_anti"), "waits")
        step += 1


def _first(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy(*KEYS).orderBy(F.col("position").asc_nulls_last())
    return rows.where("call_id is not null").withColumn("_n", F.row_number().over(by))


def _unnamed(calls: DataFrame, step: DataFrame) -> DataFrame:
    """Calls with a null id, each with its step by those it waits for."""
    lone = calls.where("call_id is null")
    each = lone.select("conv_id", "waits_for").distinct()
    asked = each.select("conv_id", "waits_for", F.explode("waits_for").alias("call_id")).join(step, KEYS)
    after = F.when(F.count_if(F.col("step").isNull()) == 0, F.max("step") + 1)
    known = asked.groupBy("conv_id", "waits_for").agg(after.alias("step"), F.lit(True).alias("_waits")).withColumnsRenamed({"conv_id": "_c", "waits_for": "_w"})
    both = lone.join(known, (F.col("conv_id") == F.col("_c")) & F.col("waits_for").eqNullSafe(F.col("_w")), "left")
    return both.withColumn("step", F.when(F.col("_waits"), F.col("step")).otherwise(F.when(F.col("conv_id").isNotNull(), 0)))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, call_id, position, name, arguments, waits_for (array of call ids);
    results: conv_id, call_id, position, content. One row for each call id, and each repeated, orphan or null-id row."""
    c, r = _first(calls), _first(results)
    first = c.where("_n = 1").select(*KEYS, "position", "name", "arguments", "waits_for")
    got = r.where("_n = 1").select(*KEYS, F.col("position").alias("result_position"), "content", F.lit(True).alias("_found"))
    step = steps(first)
    first = first.withColumn("_checked", checked(F.col("name"), F.col("arguments"), schemas)).drop("arguments")
    both = first.withColumn("_call", F.lit(True)).join(got, KEYS, "full").join(step, KEYS, "left")
    status = F.when(F.col("_call").isNull(), "orphan").when(F.col("_found").isNull(), "open").when(F.col("result_position") <= F.col("position"), "early").otherwise("linked")
    made = both.select(
        *KEYS, "position", "name", "result_position", "step", status.alias("status"),
        F.coalesce(F.col("_checked.valid"), F.lit(False)).alias("valid"), F.col("_checked.json").alias("arguments_json"), "content",
    )
    again = c.where("_n > 1").select(*KEYS, "position", "name", F.lit("repeated").alias("status"), F.lit(False).alias("valid"), canonical(F.col("arguments")).alias("arguments_json"))
    late = r.where("_n > 1").select(*KEYS, F.col("position").alias("result_position"), F.lit("repeated").alias("status"), F.lit(False).alias("valid"), "content")
    lone = _unnamed(calls, step).select(
        *KEYS, "position", "name", "step", F.lit("open").alias("status"), checked(F.col("name"), F.col("arguments"), schemas).alias("_checked"),
    ).select(*KEYS, "position", "name", "step", "status", F.col("_checked.valid").alias("valid"), F.col("_checked.json").alias("arguments_json"))
    lost = results.where("call_id is null").select(*KEYS, F.col("position").alias("result_position"), F.lit("orphan").alias("status"), F.lit(False).alias("valid"), "content")
    for more in (again, late, lone, lost):
        made = made.unionByName(more, allowMissingColumns=True)
    return made


def serialise(linked: DataFrame) -> DataFrame:
    """A line of canonical JSON for each linked and valid call, its keys in alphabetical order, and its place: step, then position."""

    @F.pandas_udf("string")
    def line(arguments: pd.Series, ids: pd.Series, names: pd.Series, contents: pd.Series) -> pd.Series:
        text = lambda x: written(None if x is None else str(x))
        rows = zip(arguments, ids, names, contents, strict=True)
        return pd.Series([f'{{"arguments":{a},"id":{text(i)},"name":{text(n)},"result":{text(c)}}}' for a, i, n, c in rows], dtype=object)

    made = line(F.coalesce("arguments_json", F.lit("null")), "call_id", "name", "content").alias("json")
    return linked.where("status = 'linked' and valid").select("conv_id", "step", "position", "call_id", made)


SCHEMAS = {"answer": {"properties": {"question": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["question", "turn"]}}


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A tool-use view of plain conversations: each user turn calls ``answer``, waiting for the first turn's call
    but for itself, and the assistant's next turn is the result."""
    users = conversations.where("role = 'user'")
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    calls = users.select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("question"))).alias("arguments"),
        F.when(F.col("turn") > 1, F.array(name(F.lit(0)), name(F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("waits_for"),
    )
    results = conversations.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    linked = link(*derived(read(spark, sf_dir, "conversations")), SCHEMAS)
    return linked.select(*KEYS, "position", "result_position", "step", "status", "valid", F.sha2("arguments_json", 256).alias("arguments_sha256"), F.sha2("content", 256).alias("content_sha256"))


def example(arguments: dict) -> str:
    """What canonical() gives for an object: sorted keys, no spaces."""
    return json.dumps(arguments, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
