"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.llm.common import checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
#: Seeds that each source may choose from: the one whose draw comes nearest to its target.
SEEDS = 32


def _uniform(seed: Column) -> Column:
    """A number in [0, 1) from doc_id and seed: 8 hex digits of an md5, four seeds to each digest."""
    digest = F.md5(F.concat_ws(":", F.floor(seed / 4).cast("string"), F.col("doc_id").cast("string")))
    return F.conv(F.substring(digest, 1 + 8 * (seed % 4), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target for each source of (source, size) rows.

    Sources in code point order, null last, get the weights in turn and share all words by them. A target stops at
    `most` times its source's size and the excess goes to the others by weight. That level is found in one pass:
    with sources ordered by most * size / weight, the first k are stopped for the least k at which the next one
    is not. The pass sees one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place - 1) % len(weights) + 1)
    ranked = by_source.withColumn("place", place).withColumn("w", w).withColumn("stop", F.col("source_size") * most)
    order = W.orderBy(F.col("stop") / F.col("w"), "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    free = F.when(level * F.col("w") <= F.col("stop"), level)
    chosen = ranked.withColumn("level", free).withColumn("level", F.min_by("level", F.struct(F.col("level").isNull(), F.col("stop") / F.col("w"), F.col("place"))).over(everything))
    return chosen.select("source", "source_size", F.when(F.col("level") * F.col("w") <= F.col("stop"), F.col("level") * F.col("w")).otherwise(F.col("stop").cast("double")).alias("target"))


def _sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def rates(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, whole, part, seed: what each source's rows are taken by.

    A row is taken `whole` times, and once more when the number that `seed` draws from its doc_id is below `part`.
    Of SEEDS seeds, each source has the one whose total comes nearest to its target, the first of several.
    """
    plan = targets(sizes, weights=weights, most=most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.select("source", "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    rated = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    extra = [F.when(_uniform(F.lit(s)) < F.col("part"), F.col("size")).otherwise(0) for s in range(SEEDS)]
    draws = rated.groupBy("source").agg(*[F.max(c).alias(c) for c in ("source_size", "target", "whole", "part")], F.array(*[F.sum(x) for x in extra]).alias("drawn"))
    misses = F.transform("drawn", lambda x, i: F.struct(F.abs(F.col("whole") * F.col("source_size") + x - F.col("target")).alias("miss"), i.alias("seed")))
    return checkpointed(draws.select("source", "source_size", "target", "whole", "part", F.array_min(misses)["seed"].alias("seed")))


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (doc_id, source and others) with their source's source_size and target, and copies."""
    plan = plan.withColumnRenamed("source", "_source")
    got = docs.join(plan, docs["source"].eqNullSafe(plan["_source"]))
    hit = _uniform(F.col("seed")) < F.col("part")
    return got.withColumn("copies", F.col("whole") + hit.cast("long")).drop("_source", "whole", "part", "seed")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs' doc_id and source with size, source_size, target and copies, the times that the mix takes the row.

    Each source's repetition rate is target / source_size; a row is taken floor(rate) times, and once more with the
    fraction as its chance. A null text has size 0, rows of a source without words are not taken, repeated rows draw alike,
    a null doc_id draws as an empty id, other columns are ignored, no rows give no rows.
    """
    sizes = checkpointed(_sizes(docs))
    return with_copies(sizes, rates(sizes, weights=weights, most=most))


def repeated(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    plan = rates(checkpointed(_sizes(docs)), weights=weights, most=most)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    return with_copies(rows, plan).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_DRAW = "cast(('0x' || substr(md5('{a}' || ':' || cast(doc_id as varchar)), {b}, 8)) as ubigint)::double / 4294967296.0"
ORACLE = f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM by_source),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS w, 3 * source_size AS stop FROM ranked),
levels AS (SELECT *, stop / w AS ratio, ((SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY stop / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM weighed),
pick AS (SELECT level FROM levels WHERE level * w <= stop ORDER BY ratio, place LIMIT 1),
plan AS (SELECT source, source_size, CASE WHEN (SELECT level FROM pick) * w <= stop THEN (SELECT level FROM pick) * w ELSE stop::DOUBLE END AS target FROM weighed),
rated AS (SELECT s.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS rate FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
split AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, [{", ".join(_DRAW.format(a=s // 4, b=1 + 8 * (s % 4)) for s in range(SEEDS))}] AS u FROM rated),
drawn AS (SELECT source, i, abs(max(whole * source_size) + sum(CASE WHEN u[i] < part THEN size ELSE 0 END) - max(target)) AS miss FROM split, range(1, {SEEDS + 1}) r(i) GROUP BY source, i),
best AS (SELECT source, min_by(i, (miss, i)) AS i FROM drawn GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN u[b.i] < part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM split s JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""
