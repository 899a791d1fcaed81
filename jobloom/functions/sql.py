"""The text functions under their names in SQL, as temporary SQL functions: native expressions that Spark puts in place of each call, no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import extract, text


def keyword_in(value: Column, keyword: Column) -> Column:
    """keyword_match() of one keyword that is a column: it starts a word of the text; one of up to three characters is the whole word; an empty one matches nothing."""
    mark = F.trim(text.spaced(keyword))
    needle = text.let(mark, lambda k: F.concat(F.lit(" "), k, F.when(F.char_length(k) <= 3, " ").otherwise("")))
    return (mark != "") & F.contains(text.spaced(value), needle)


#: name -> parameters, type of the result, expression over the parameters.
FUNCTIONS = {
    "fold_text": ("t STRING", "STRING", lambda: text.fold_text(F.col("t"))),
    "keyword_match": ("t STRING, k STRING", "BOOLEAN", lambda: keyword_in(F.col("t"), F.col("k"))),
    "normalize_title": ("t STRING", "STRING", lambda: text.normalize_title(F.col("t"))),
    "company_core": ("t STRING", "STRING", lambda: text.company_core(F.col("t"))),
    "strip_url": ("t STRING", "STRING", lambda: text.strip_url(F.col("t"))),
    "html_text": ("t STRING", "STRING", lambda: text.html_text(F.col("t"))),
    "extract_salary": ("t STRING", "STRING", lambda: extract.extract_salary(F.col("t"))),
    "extract_work_mode": ("t STRING", "STRING", lambda: extract.work_mode(F.col("t"))),
    "extract_contracts": ("t STRING", "ARRAY<STRING>", lambda: extract.contracts(F.col("t"))),
    "extract_skills": ("t STRING", "ARRAY<STRING>", lambda: extract.extract_skills(F.col("t"))),
    "extract_cities": ("t STRING", "ARRAY<STRING>", lambda: extract.extract_cities(F.col("t"))),
}


def expression_sql(column: Column) -> str:
    """A column as SQL text. Spark prints operators as calls, whose names need quotes; what stands in string literals is left alone."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", column._jc.node().sql())
    call = re.compile(r"(?<![\w`])([=<>!+\-*/%|&^]+|and|or|not)\(")
    return "".join(p if i % 2 else call.sub(r"`\1`(", p) for i, p in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    """Adds the functions to a session; their names."""
    for name, (parameters, result, made) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression_sql(made())}")
    return list(FUNCTIONS)
