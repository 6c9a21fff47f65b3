"""Why marks were lost, how hard they are to win back, and what follows for the qualification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.operators.scoring import one_decimal, percent_of

#: Weights of the difficulty, and words of criteria that rest on experience.
DIFFICULTY_WEIGHTS = {"easy": 1.0, "medium": 0.5, "hard": 0.25}
EXPERIENCE = ["experience", "turnover", "years", "tsa", "ddu"]


def leaves(items: DataFrame) -> DataFrame:
    """Scored document rows that are no parents and no sums of their children."""
    return items.where("evaluation_layer = 'document' and not coalesce(is_parent, false) and score is not null and coalesce(extracted_value, '') <> 'Sum of sub-criteria'")


def gap_type(evidence: Column, verified: Column, score: Column, most: Column) -> Column:
    return F.when(~F.coalesce(evidence, F.lit(False)), "missing_evidence").when(~F.coalesce(verified, F.lit(True)), "unverified").when(score < most, "partial").otherwise("full")


def difficulty(kind: Column, lost: Column, parameter: Column, experience: list[str] = EXPERIENCE) -> Column:
    low = F.lower(parameter)
    rests = F.lit(False)
    for word in experience:
        rests = rests | F.contains(low, F.lit(word))
    return F.when(rests & (kind == "missing_evidence"), "hard").when(rests, "medium").when(kind == "unverified", "easy").when((kind == "partial") & (lost <= 5), "easy").otherwise("medium")


def _weighed(items: DataFrame, experience: list[str]) -> DataFrame:
    """The leaves with marks_lost, gap_type, difficulty and priority."""
    got = leaves(items).withColumn("marks_lost", one_decimal(F.col("max_marks") - F.col("score")))
    got = got.withColumn("gap_type", gap_type(F.col("evidence_found"), F.col("verified"), F.col("score"), F.col("max_marks")))
    got = got.withColumn("difficulty", difficulty(F.col("gap_type"), F.col("marks_lost"), F.col("parameter"), experience))
    weight = F.coalesce(*[F.when(F.col("difficulty") == k, F.lit(v)) for k, v in DIFFICULTY_WEIGHTS.items()])
    return got.withColumn("priority", F.round((F.col("marks_lost") * weight.cast("decimal(4,2)")).cast("decimal(20,6)"), 2))


def gap_rows(items: DataFrame, *, experience: list[str] = EXPERIENCE) -> DataFrame:
    """The leaves that lost marks, with gap_type, difficulty, priority and its rank in the evaluation."""
    got = _weighed(items, experience).where("marks_lost > 0")
    return got.withColumn("rank", F.row_number().over(W.partitionBy("evaluation_id").orderBy(F.desc("priority"), "item_seq")))


def risk_of(total: Column, needed: Column) -> Column:
    deficit = needed - total
    return F.when((deficit <= 0) & (total >= needed * F.lit(1.15).cast("decimal(4,2)")), "safe").when(deficit <= 0, "marginal").when(deficit <= 10, "at_risk").otherwise("failed")


def gap_summary(items: DataFrame, *, threshold: float = 70.0, experience: list[str] = EXPERIENCE) -> DataFrame:
    """One row for each evaluation: totals, deficit, risk, recoverable marks, worst gap and a sentence."""
    lost = F.col("marks_lost") > 0
    easy = F.when(lost & (F.col("difficulty") == "easy"), F.col("marks_lost")).otherwise(0)
    worst = F.min_by(F.struct("parameter", "marks_lost", "max_marks"), F.when(lost, F.struct(-F.col("priority"), "item_seq")))
    got = _weighed(items, experience).groupBy("evaluation_id").agg(one_decimal(F.sum("score")).alias("total_scored"), F.sum("max_marks").alias("doc_max"), F.count_if(lost).alias("n_gaps"), one_decimal(F.sum(easy)).alias("recoverable"), worst.alias("worst"))
    got = got.withColumn("min_required", one_decimal(F.lit(threshold) / 100 * F.col("doc_max"))).withColumn("deficit", one_decimal(F.col("min_required") - F.col("total_scored")))
    got = got.withColumn("risk", risk_of(F.col("total_scored"), F.col("min_required")))
    text = lambda c: F.format_string("%.1f", c.cast("double"))
    verdict = F.when(F.col("risk") == "safe", "Qualifies with room.").when(F.col("risk") == "marginal", "Qualifies narrowly.").when(F.col("risk") == "at_risk", F.concat(F.lit("At risk, short by "), text(F.col("deficit")), F.lit("."))).otherwise(F.concat(F.lit("Fails, short by "), text(F.col("deficit")), F.lit(".")))
    parts = [
        F.concat(F.lit("Scored "), text(F.col("total_scored")), F.lit("/"), F.col("doc_max").cast("long").cast("string"), F.lit(" ("), text(percent_of(F.col("total_scored"), F.col("doc_max"))), F.lit("%).")),
        verdict,
        F.when(F.col("recoverable") > 0, F.concat(text(F.col("recoverable")), F.lit(" marks easily won."))),
        F.when(F.col("worst").isNotNull(), F.concat(F.lit("Largest gap: "), F.col("worst.parameter"), F.lit(" ("), text(F.col("worst.marks_lost")), F.lit("/"), F.col("worst.max_marks").cast("long").cast("string"), F.lit(").")))
    ]
    return got.withColumn("summary", F.concat_ws(" ", *parts))
