"""Scores of claims against criteria, roll-ups of evaluations and the qualification gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.functions.text import tokens
from dossier.operators.similarity import closest, in_order

#: Weights of the evidence flags of a qualification criterion.
QUAL_WEIGHTS = {"named_experts": 0.10, "education_stated": 0.25, "experience_years_stated": 0.25, "relevant_projects_listed": 0.25, "cvs_attached": 0.15}
#: Words that state an absence.
ABSENT = ["not found", "no", "absent", "none", "not present", "not mentioned", "not stated", "null", ""]
#: Multipliers of the confidence in a CV.
CV_CONFIDENCE = {"high": 1.0, "medium": 0.75, "low": 0.25}


def one_decimal(x: Column) -> Column:
    return F.round(x.cast("decimal(20,6)"), 1)


def clamp(score: Column, most: Column) -> Column:
    """Within 0 and most, one decimal."""
    return one_decimal(F.least(F.greatest(score, F.lit(0)), most))


def percent_of(score: Column, most: Column) -> Column:
    return F.when(most > 0, one_decimal(100 * score / most)).otherwise(F.lit(0).cast("decimal(20,1)"))


def step_score(value: Column, base: Column, base_score: Column, size: Column, per_step: Column, most: Column) -> Column:
    """0 below base, else base_score and per_step for each full step beyond it, at most `most`."""
    return F.when(value < base, F.lit(0.0)).otherwise(F.least(base_score + F.floor((value - base) / size) * per_step, most))


def band_score(bands: Column, value: Column, boundary: str = "half_open") -> Column:
    """The score of the band (array of struct lo, hi, score) that holds the value.

    upper: the first band, by hi, whose hi reaches the value, else the last. half_open: lo <= value < hi, a null hi
    open, the last match wins. inclusive: both ends count, the first match wins. None: null.
    """
    if boundary == "upper":
        ordered = F.array_sort(F.transform(bands, lambda b: F.struct(F.coalesce(b["hi"], F.lit(float("inf"))).alias("hi"), b["score"].alias("score"))))
        return F.coalesce(F.get(F.filter(ordered, lambda b: value <= b["hi"]), F.lit(0))["score"], F.try_element_at(ordered, F.lit(-1))["score"])
    ordered = F.array_sort(F.transform(bands, lambda b: F.struct(F.coalesce(b["lo"], F.lit(float("-inf"))).alias("lo"), b["hi"].alias("hi"), b["score"].alias("score"))))
    if boundary == "inclusive":
        return F.get(F.filter(ordered, lambda b: (value >= b["lo"]) & (b["hi"].isNull() | (value <= b["hi"]))), F.lit(0))["score"]
    return F.try_element_at(F.filter(ordered, lambda b: (value >= b["lo"]) & (b["hi"].isNull() | (value < b["hi"]))), F.lit(-1))["score"]


def per_unit_score(count: Column, rate: Column, cap: Column, most: Column) -> Column:
    return F.least(F.least(count, F.coalesce(cap, count)) * rate, most)


def qual_score(flags: dict[str, Column], most: Column) -> tuple[Column, Column, Column]:
    """Weighted evidence flags: score, names found, names missing."""
    total = sum((F.when(c, F.lit(QUAL_WEIGHTS[n])).otherwise(0.0) for n, c in flags.items()), F.lit(0.0))
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return one_decimal(F.round(total.cast("decimal(6,2)"), 2) * most), found, missing


def binary_score(found: Column, value: Column, most: Column) -> Column:
    return F.when(found & ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(ABSENT), most.cast("double")).otherwise(0.0)


def cv_score(confidence: Column, most: Column) -> Column:
    """Marks by confidence, to the nearest half."""
    factor = F.coalesce(*[F.when(F.lower(confidence) == k, F.lit(v)) for k, v in CV_CONFIDENCE.items()], F.lit(0.0))
    return F.round((factor * most * 2).cast("decimal(20,6)"), 0).cast("double") / 2


def matched_rows(criteria: DataFrame, rows: DataFrame, *, doc: str = "doc", least: float = 0.30) -> DataFrame:
    """Each criterion (doc, item_code, parameter) with row_code and match: code, prefix, name or none.

    An equal code wins, then the code without its last character, then the row whose name shares most words of
    four letters and more, `least` at least, the first code of several. Names meet as sets of words, by a prefix filter.
    """
    r = rows.select(F.col(doc), F.col("item_code").alias("row_code"), F.col("parameter").alias("row_parameter"))
    code = criteria.join(r.select(doc, "row_code"), (criteria[doc] == r[doc]) & (criteria["item_code"] == r["row_code"]), "left").drop(r[doc])
    short = F.expr("left(item_code, length(item_code) - 1)")
    p = r.select(F.col(doc).alias("_d"), F.col("row_code").alias("prefix_code"))
    both = code.withColumn("_short", short).join(p, (F.col(doc) == F.col("_d")) & (F.col("_short") == F.col("prefix_code")) & (F.col("_short") != ""), "left").drop("_d", "_short")
    words = lambda c: in_order(tokens(c, 4)).alias("words")
    left = both.where("row_code is null and prefix_code is null").select(doc, "item_code", words("parameter"))
    near = left.join(closest(left, r.select(doc, words("row_parameter"), F.col("row_code").alias("rank")), [doc], least), [doc, "words"])
    best = near.groupBy(doc, "item_code").agg(F.min(F.struct(-F.col("share"), "rank"))["rank"].alias("name_code"))
    got = both.join(best, [doc, "item_code"], "left")
    how = F.when(F.col("row_code").isNotNull(), "code").when(F.col("prefix_code").isNotNull(), "prefix").when(F.col("name_code").isNotNull(), "name").otherwise("none")
    return got.select(*criteria.columns, F.coalesce("row_code", "prefix_code", "name_code").alias("row_code"), how.alias("match"))


def totals(items: DataFrame, *, threshold: float = 70.0) -> DataFrame:
    """One row for each evaluation_id: maximum, score, percentage, comparative sums and the gate.

    The maximum leaves out sub-items and marks not `scored` from documents; the score adds every scored row.
    """
    scored = F.col("score_state") == "scored"
    scoreable = F.sum(F.when(~F.col("is_sub_item") & (F.col("score_state") != "pending_live") & (F.col("score_state") != "comparative"), F.col("max_marks")).otherwise(0))
    got = items.groupBy("evaluation_id").agg(
        scoreable.alias("doc_max"),
        one_decimal(F.coalesce(F.sum(F.when(scored, F.col("score"))), F.lit(0))).alias("total_score"),
        F.sum(F.when(F.col("score_state") == "comparative", F.col("max_marks")).otherwise(0)).alias("comparative_marks"),
        F.sum(F.when(F.col("score_state") == "pending_live", F.col("max_marks")).otherwise(0)).alias("live_marks"),
    )
    got = got.withColumn("percentage", percent_of(F.col("total_score"), F.col("doc_max")))
    got = got.withColumn("min_marks", one_decimal(F.lit(threshold) / 100 * F.col("doc_max")))
    return got.withColumn("passed", F.col("total_score") >= F.col("min_marks"))


def overridden(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """items with the latest valid override (evaluation_id, item_seq, score, ts) of each: its score, state and note."""
    valid = overrides.join(items.select("evaluation_id", "item_seq", "max_marks"), ["evaluation_id", "item_seq"]).where("score between 0 and max_marks")
    latest = valid.groupBy("evaluation_id", "item_seq").agg(F.max_by(F.col("score"), F.struct("ts", "score")).alias("new_score"))
    got = items.join(latest, ["evaluation_id", "item_seq"], "left")
    new = F.col("new_score").isNotNull()
    return got.withColumns({"score": F.coalesce("new_score", "score"), "score_state": F.when(new, "scored").otherwise(F.col("score_state")), "note": F.when(new, "manual override")}).drop("new_score")
