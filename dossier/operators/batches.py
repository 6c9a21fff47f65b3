"""Prompt tables for any batch inference job, and the reading of its answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.frames import small


def prompts(contexts: DataFrame, templates: DataFrame, lessons: DataFrame, *, most: int = 8000) -> DataFrame:
    """doc, clause_type, prompt: the clause type's template (clause_type, template) with {context} and {lessons} filled in.

    contexts: doc, clause_type, context (cut to `most` characters). lessons: clause_type, block. Templates and
    lessons are one row for each clause type.
    """
    got = contexts.join(small(templates), "clause_type").join(small(lessons), "clause_type", "left")
    filled = F.replace(F.replace(F.col("template"), F.lit("{context}"), F.substring(F.coalesce("context", F.lit("")), 1, most)), F.lit("{lessons}"), F.coalesce("block", F.lit("")))
    return got.select("doc", "clause_type", filled.alias("prompt"))


def json_text(raw: Column) -> Column:
    """The outermost object of an answer: code fences and what stands around it go, and trailing commas."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(body, r",(\s*[}\]])", "$1"), F.lit(""))


def _closed(text: str) -> str | None:
    """A cut object with its open string, lists and objects closed; null where even that does not parse."""
    start = text.find("{")
    if start < 0:
        return None
    stack, quoted, escaped = [], False, False
    for c in text[start:]:
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    body = text[start:] + '"' * quoted
    for end in (body.rstrip().rstrip(","), body.rpartition(",")[0]):
        try:
            return json.dumps(json.loads(end + "".join(reversed(stack))))
        except ValueError:
            continue
    return None


def _repaired(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: _closed(x) if isinstance(x, str) else None)


def answers(raw: DataFrame, schema: str, *, column: str = "raw") -> DataFrame:
    """raw rows with parsed (schema) and error: empty, no_json, parse_error or null; no row is dropped.

    Only answers that do not parse go through the repair, which closes what a cut answer left open.
    """
    text = json_text(F.col(column))
    got = raw.withColumn("_json", text).withColumn("_ok", F.col("_json").isNotNull() & F.try_parse_json("_json").isNotNull())
    good = got.where("_ok").withColumn("_text", F.col("_json"))
    bad = got.where("not _ok").withColumn("_text", F.pandas_udf(_repaired, "string")(F.regexp_replace(F.coalesce(column, F.lit("")), r"```(?:json)?", "")))
    both = good.unionByName(bad)
    error = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "empty").when(~F.contains(column, F.lit("{")), "no_json").when(F.col("_text").isNull(), "parse_error")
    return both.withColumns({"parsed": F.from_json("_text", schema), "error": error}).drop("_json", "_ok", "_text")


def stated_score(raw: Column, most: float = 100) -> Column:
    """The number after "score" in an answer, if it lies between 0 and `most`."""
    value = F.regexp_extract(raw, r"(?i)score\"?\s*[:=]\s*\"?(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(value.between(0, most), value)
