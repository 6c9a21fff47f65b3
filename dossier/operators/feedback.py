"""Reviewers' feedback: upserts, consensus, insights, examples, learned rules and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.functions.frames import first_of
from dossier.functions.text import upper_trimmed
from dossier.operators.similarity import within, with_blanks

#: Risk levels in ascending order, and the valid answers.
RISK_ORDER = ["ACCEPTABLE", "LOW", "MEDIUM", "HIGH"]
AGREEMENTS = ["agree", "too_high", "too_low", "incorrect"]


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key, the last by order."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def valid(feedback: DataFrame, clause_types: list[str]) -> DataFrame:
    """Rows with a known clause type, agreement and (if any) suggested level."""
    return feedback.where(F.col("clause_type").isin(clause_types) & F.col("agreement").isin(AGREEMENTS) & (F.col("suggested_level").isNull() | F.col("suggested_level").isin(RISK_ORDER)))


def submitted(feedback: DataFrame, clause_types: list[str]) -> DataFrame:
    """The valid rows that stay: one for each document, clause type and reviewer, the last one."""
    return latest(valid(feedback, clause_types), ["doc", "clause_type", "user_id"], ["created_at", "id"])


def context_pairs(rows: DataFrame, targets: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct contexts of rows (row_offering, row_solution) that match those of targets (offering, solution), in one scope if columns are named.

    Names match where, upper-cased and trimmed, either holds the other; a blank matches all. Distinct names meet first,
    by their rarest grams; contexts then meet by equal names, those with a blank offering by their solutions first.
    """
    scope = scope or []
    a = rows.select(*scope, upper_trimmed("offering").alias("row_offering"), upper_trimmed("solution").alias("row_solution")).distinct()
    b = targets.select(*scope, upper_trimmed("offering").alias("offering"), upper_trimmed("solution").alias("solution")).distinct()
    column = lambda df, c: df.select(*scope, F.col(c).alias("text"))
    offerings = within(column(a, "row_offering"), column(b, "offering"), scope).select(*scope, F.col("a").alias("row_offering"), F.col("b").alias("offering"))
    x, y = column(a, "row_solution"), column(b, "solution")
    solutions = with_blanks(within(x, y, scope), x, y, scope).select(*scope, F.col("a").alias("row_solution"), F.col("b").alias("solution"))
    named = a.where("row_offering <> ''").join(offerings, [*scope, "row_offering"]).join(b, [*scope, "offering"]).join(solutions, [*scope, "row_solution", "solution"])
    by_solution = lambda p, q: p.join(solutions, [*scope, "row_solution"]).join(q, [*scope, "solution"])
    blank = by_solution(a.where("row_offering = ''"), b).unionByName(by_solution(a.where("row_offering <> ''"), b.where("offering = ''")), allowMissingColumns=True)
    columns = [*scope, "row_offering", "row_solution", "offering", "solution"]
    return named.select(columns).unionByName(blank.select(columns))


def _top(df: DataFrame, keys: list[str], level: str, name: str) -> DataFrame:
    """The most frequent level of each key, the one first seen (by id) of several."""
    n = df.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.groupBy(*keys).agg(F.min_by(level, F.struct(-F.col("n"), "first")).alias(name))


def bumped(level: Column, by: int, unknown: int) -> Column:
    """The next level of the order, kept within it; an unknown level counts as the one at `unknown`."""
    order = F.array(*[F.lit(x) for x in RISK_ORDER])
    at = F.array_position(order, level)
    return F.element_at(order, F.least(F.greatest(F.when(at > 0, at).otherwise(unknown + 1) + by, F.lit(1)), F.lit(len(RISK_ORDER))).cast("int"))


def context_counts(feedback: DataFrame) -> DataFrame:
    """clause_type, row_offering, row_solution, suggested_level with n rows, how many found the level too high and too low, and the first id."""
    return feedback.groupBy("clause_type", upper_trimmed("offering").alias("row_offering"), upper_trimmed("solution").alias("row_solution"), "suggested_level").agg(
        F.count("*").alias("n"), F.count_if(F.col("agreement") == "too_high").alias("high"), F.count_if(F.col("agreement") == "too_low").alias("low"), F.min("id").alias("first"))


def adjustments(feedback: DataFrame, targets: DataFrame, *, least: int = 1, share: float = 0.5) -> DataFrame:
    """targets (clause_type, offering, solution, system_level) with the level that past feedback calls for; see adjusted."""
    return adjusted(context_counts(feedback), targets, least=least, share=share)


def adjusted(counts: DataFrame, targets: DataFrame, *, least: int = 1, share: float = 0.5) -> DataFrame:
    """targets (clause_type, offering, solution, system_level) with the level that counts of feedback (see context_counts) call for.

    Feedback of the clause type whose context matches is counted; where a share of at least `share` found the level too high it
    falls to the most suggested level, else one lower; too low likewise, one higher. Adds feedback_count, direction,
    confidence, top_suggested, adjusted_level, applied.
    """
    key = ["clause_type", "offering", "solution"]
    named = targets.withColumns({"_o": upper_trimmed("offering"), "_s": upper_trimmed("solution")})
    pairs = context_pairs(counts.select(F.col("row_offering").alias("offering"), F.col("row_solution").alias("solution")), targets)
    by_level = counts.join(pairs, ["row_offering", "row_solution"]).groupBy(*key, "suggested_level").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("first").alias("first"))
    top = F.min_by("suggested_level", F.when(F.col("suggested_level").isNotNull(), F.struct(-F.col("n"), "first"))).alias("top_suggested")
    counts = by_level.groupBy(*key).agg(F.sum("n").alias("feedback_count"), (F.sum("high") / F.sum("n")).alias("high"), (F.sum("low") / F.sum("n")).alias("low"), top)
    stats = counts.select(F.col("clause_type").alias("_c"), F.col("offering").alias("_o"), F.col("solution").alias("_s"), "feedback_count", "high", "low", "top_suggested")
    got = named.withColumn("_c", F.col("clause_type")).join(stats, ["_c", "_o", "_s"], "left").withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)))
    enough = F.col("feedback_count") >= least
    direction = F.when(enough & (F.col("high") >= share), "LOWER").when(enough & (F.col("low") >= share), "HIGHER").otherwise("NONE")
    got = got.withColumn("direction", direction)
    known = F.when(F.col("top_suggested").isin(RISK_ORDER), F.col("top_suggested"))
    adjusted = F.when(F.col("direction") == "LOWER", F.coalesce(known, bumped(F.col("system_level"), -1, 2))).when(F.col("direction") == "HIGHER", F.coalesce(known, bumped(F.col("system_level"), 1, 1))).otherwise(F.col("system_level"))
    confidence = F.when(F.col("direction") == "LOWER", F.round("high", 2)).when(F.col("direction") == "HIGHER", F.round("low", 2)).when(enough, F.greatest("high", "low")).otherwise(0.0)
    got = got.withColumns({"adjusted_level": adjusted, "confidence": confidence})
    return got.withColumn("applied", ~F.col("adjusted_level").eqNullSafe(F.col("system_level"))).drop("_c", "_o", "_s", "high", "low")


def insights(feedback: DataFrame, keys: list[str], *, share: float = 0.5) -> DataFrame:
    """Shares of each answer, usual and most suggested level, and a recommendation for each key."""
    rates = [F.round(F.avg((F.col("agreement") == a).cast("double")), 2).alias(a) for a in AGREEMENTS]
    got = feedback.groupBy(*keys).agg(F.count("*").alias("feedback_count"), *rates)
    got = got.join(_top(feedback, keys, "system_level", "typical_level"), keys, "left").join(_top(feedback, keys, "suggested_level", "top_suggested"), keys, "left")
    advice = F.when(F.col("too_high") >= share, "lower").when(F.col("too_low") >= share, "raise").when(F.col("agree") >= share, "keep").otherwise("mixed")
    return got.withColumns({"recommendation": advice, "strong": advice != "mixed", "typical_level": F.coalesce("typical_level", F.lit("UNKNOWN"))})


def review_status(feedback: DataFrame, clause_types: list[str]) -> DataFrame:
    """For each document: clause types done, pending in order, and rows for each answer."""
    every = F.array(*[F.lit(c) for c in clause_types])
    got = feedback.groupBy("doc").agg(F.array_sort(F.collect_set("clause_type")).alias("done"), *[F.count_if(F.col("agreement") == a).alias(f"n_{a}") for a in AGREEMENTS])
    return got.withColumn("pending", F.array_except(every, "done"))


def learning_examples(feedback: DataFrame, existing: DataFrame, snippets: DataFrame) -> DataFrame:
    """New examples: disagreements with a comment not yet promoted (feedback_id), with 300 characters of the clause (doc, clause_type, clause_text)."""
    new = feedback.where("agreement <> 'agree' and length(trim(comment)) > 0").join(existing.select(F.col("feedback_id").alias("id")), "id", "left_anti")
    return new.join(snippets.select("doc", "clause_type", F.substring("clause_text", 1, 300).alias("snippet")), ["doc", "clause_type"], "left").select(F.col("id").alias("feedback_id"), "doc", "clause_type", "offering", "solution", "system_level", F.col("suggested_level").alias("correct_level"), F.col("comment").alias("reason"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def few_shot(examples: DataFrame, feedback: DataFrame, *, most: int = 4, least: int = 2, recent: int = 30) -> DataFrame:
    """A block of text for each clause_type: the most useful active examples, topped up with recent commented disagreements.

    examples: clause_type, example_id, usefulness, created_at, line. feedback: clause_type, id, created_at, agreement, comment.
    The `recent` last disagreements with a comment are looked at, those of over 10 characters count. Fewer than `least` of both give no block.
    """
    a = first_of(examples, ["clause_type"], [F.desc("usefulness"), F.desc("created_at"), F.desc("example_id")], most, salt=F.col("example_id"), place="k").select("clause_type", F.lit(0).alias("kind"), "k", "line")
    raw = first_of(feedback.where("agreement <> 'agree' and comment is not null"), ["clause_type"], [F.desc("created_at"), F.desc("id")], recent, salt=F.col("id"), place="k")
    b = raw.where(F.length(F.trim("comment")) > 10).select("clause_type", F.lit(1).alias("kind"), "k", F.trim("comment").alias("line"))
    both = a.unionByName(b)
    ranked = both.withColumns({"n": F.count("*").over(W.partitionBy("clause_type")), "at": F.row_number().over(W.partitionBy("clause_type").orderBy("kind", "k"))}).where((F.col("n") >= least) & (F.col("at") <= most))
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))
    return ranked.groupBy("clause_type").agg(F.array_join(F.transform(lines, lambda x: F.concat(x["at"].cast("string"), F.lit(". "), x["line"])), "\n").alias("block"), F.count("*").alias("used"))


def digest(feedback: DataFrame, keys: list[str], *, least: int = 5, budget: int = 2_000, span: str = "month") -> DataFrame:
    """keys, n, part, n_parts, n_lines, digest: a line for each row in order of time and id, of keys with at least `least` rows.

    A key's lines are cut into parts, a row each: a part takes the lines that begin within its `budget` characters, so it
    holds at most that and one line, and no row is left out. Rows without a time come last. Places come from the sizes of
    spans of time and the places within one, so a key's rows are the work of as many tasks as they fill spans.
    """
    line = F.concat_ws(" | ", "agreement", F.concat_ws("->", "system_level", "suggested_level"), "comment")
    rows = feedback.select(*keys, "created_at", "id", line.alias("line"), F.date_trunc(span, "created_at").alias("_span")).withColumn("_n", F.length("line") + 1)
    order = [F.asc_nulls_last("created_at"), F.asc_nulls_last("id"), F.col("line")]
    # No column of keys and spans travels twice: sizes are summed before they meet the lines again.
    spans = rows.groupBy(*keys, "_span").agg(F.sum("_n").alias("_size"), F.count("*").alias("_rows"))
    every, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(F.asc_nulls_last("_span")).rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(*keys, "_span", F.sum("_rows").over(every).alias("n"), F.sum("_size").over(every).alias("_all"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.lit(True).alias("_of"))
    inner = W.partitionBy(*keys, "_span").orderBy(*order)
    placed = rows.withColumns({"_in": F.coalesce(F.sum("_n").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_k": F.row_number().over(inner)})
    same = [placed[c].eqNullSafe(starts[c]) for c in [*keys, "_span"]]
    met = placed.join(starts, same).where(F.col("n") >= least).select(*[placed[c] for c in keys], placed["_span"], "line", "_k", "n", F.floor((F.col("_start") + F.col("_in")) / budget).alias("_part"))
    parts = met.groupBy(*keys, "n", "_part").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct(F.col("_span").isNull().alias("last"), "_span", "_k", "line"))).alias("_lines"))
    # A line longer than a budget leaves numbers out; parts are numbered anew.
    number = F.row_number().over(every.orderBy("_part")).cast("long")
    return parts.select(*keys, "n", number.alias("part"), F.count("*").over(every).alias("n_parts"), "n_lines", F.array_join(F.transform("_lines", lambda r: r["line"]), "\n").alias("digest"))


def merged(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of new in place of those of the same key; columns that new leaves null stay."""
    values = [c for c in current.columns if c not in keys]
    b = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return current.join(b, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def learned_rule(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (clause_type, offering, solution) with the active rule (rule_id, rule_text) of the smallest id whose context matches."""
    active = rules.where("active").withColumns({"row_offering": upper_trimmed("offering"), "row_solution": upper_trimmed("solution")})
    first = active.groupBy("clause_type", "row_offering", "row_solution").agg(F.min_by(F.struct("rule_id", "rule_text"), "rule_id").alias("r"))
    wanted = targets.select("clause_type", "offering", "solution", upper_trimmed("offering").alias("_o"), upper_trimmed("solution").alias("_s"))
    pairs = context_pairs(active, targets, ["clause_type"]).withColumnsRenamed({"offering": "_o", "solution": "_s"})
    met = pairs.join(first, ["clause_type", "row_offering", "row_solution"]).groupBy("clause_type", "_o", "_s").agg(F.min_by("r", "r.rule_id").alias("r"))
    return wanted.join(met, ["clause_type", "_o", "_s"], "left").select("clause_type", "offering", "solution", "r.*")


def without(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, link: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after the parents of `gone` (key) and all children that link to them are deleted."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, link), link, "left_anti")


def as_list(text: Column) -> Column:
    """A JSON list, or one plain value, as an array; blank as an empty one."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(plain == "", F.array().cast("array<string>")).when(F.startswith(plain, F.lit("[")), F.coalesce(F.from_json(plain, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(plain))


def first_distinct(*lists: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.array(*lists))), 1, most)
