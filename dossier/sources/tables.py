"""Scans, registries of what is done, keyed replacement, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.sources.keyed import KeyedTable


def fingerprint(content: Column, first: int = 512 * 1024) -> Column:
    """16 hex digits of a sha256 of the first bytes."""
    return F.substring(F.sha2(F.substring(content.cast("binary"), 1, first), 256), 1, 16)


def criteria_key(criteria: DataFrame) -> DataFrame:
    """doc and an md5 of its sorted criterion names."""
    return criteria.groupBy("doc").agg(F.md5(F.array_join(F.array_sort(F.collect_list("parameter")), "|")).alias("criteria_key"))


def pending(work: DataFrame, registry: DataFrame, keys: list[str], complete: Column | None = None) -> DataFrame:
    """work without what the registry holds under the same keys; registry rows that are not complete do not count."""
    done = registry if complete is None else registry.where(complete)
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def replaced(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with all rows of the keys of new gone, and the rows of new."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_by_document(chunks: DataFrame, path: str, doc: str = "doc", buckets: int = 64) -> int:
    """Put chunks in place of all chunks of their documents in the table under path; returns its new version (see keyed.KeyedTable)."""
    return KeyedTable(chunks.sparkSession, path, doc, buckets=buckets).replace(chunks)


def without_document(chunks: DataFrame, doc: str, value) -> tuple[DataFrame, DataFrame]:
    """The chunks of all other documents, and one row with the number that goes."""
    return chunks.where(~F.col(doc).eqNullSafe(F.lit(value))), chunks.where(F.col(doc).eqNullSafe(F.lit(value))).agg(F.count("*").alias("n_deleted"))


def listed(map_of_lists: DataFrame, column: str) -> DataFrame:
    """key, value, place of a JSON map of arrays in a column."""
    pairs = map_of_lists.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("key", "values"))
    return pairs.select("key", F.posexplode("values").alias("place", "value"))


def registry_listing(cached: DataFrame) -> DataFrame:
    """doc, n_criteria, total_marks, n_bands of cached extractions (doc, criteria array, bands map)."""
    return cached.select("doc", F.size("criteria").alias("n_criteria"), F.aggregate("criteria", F.lit(0).cast("long"), lambda a, c: a + c["max_marks"]).alias("total_marks"), F.aggregate(F.map_values("bands"), F.lit(0), lambda a, b: a + F.size(b)).alias("n_bands"))


def evolved(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with the columns (name: type, default) that it lacks; nulls of those it has get the default too."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(d).cast(k)) if c in df.columns else F.lit(d).cast(k) for c, (k, d) in columns.items()})


def review_rows(results: DataFrame, order: list[str], *, most: int = 800) -> DataFrame:
    """One row for each document and clause type in display order, types without a result included.

    results: doc, clause_type, clause_text, reference, page_no, risk_level, flags (array).
    """
    places = F.explode(F.transform(F.array(*[F.lit(c) for c in order]), lambda c, i: F.struct(i.alias("place"), c.alias("clause_type")))).alias("p")
    every = results.select("doc").distinct().select("doc", places).select("doc", "p.*")
    got = every.join(results, ["doc", "clause_type"], "left")
    where = F.when(F.col("reference").isNotNull() & F.col("page_no").isNotNull(), F.concat("reference", F.lit(" (Page "), F.col("page_no").cast("string"), F.lit(")"))).otherwise(F.coalesce("reference", F.concat(F.lit("Page "), F.col("page_no").cast("string")), F.lit("-")))
    said = F.concat_ws(" ", F.substring(F.coalesce("clause_text", F.lit("Not found")), 1, most), F.when(F.size("flags") > 0, F.concat(F.lit("["), F.array_join("flags", ", "), F.lit("]"))))
    return got.select("doc", "place", "clause_type", where.alias("reference"), said.alias("text"), F.coalesce("risk_level", F.lit("NEEDS_REVIEW")).alias("risk_level"))


def gap_report(summaries: DataFrame, gaps: DataFrame, *, most: int = 10) -> DataFrame:
    """evaluation_id and a markdown report: the summary, then the `most` first gaps by rank."""
    line = F.format_string("| %d | %s | %.1f | %s | %s |", "rank", "parameter", F.col("marks_lost").cast("double"), "gap_type", "difficulty")
    rows = gaps.where(F.col("rank") <= most).groupBy("evaluation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
    head = "| rank | criterion | lost | gap | difficulty |\n|---|---|---|---|---|\n"
    return summaries.join(rows, "evaluation_id", "left").select("evaluation_id", F.concat(F.lit("# Gaps\n\n"), F.col("summary"), F.lit("\n\n"), F.when(F.col("rows").isNotNull(), F.concat(F.lit(head), F.col("rows"))).otherwise("No gaps.")).alias("report"))


def backfilled(rows: DataFrame, extracted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows whose blank columns are filled from extracted (key and the same columns); changed says where."""
    b = extracted.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    blank = {c: F.nullif(F.trim(c), F.lit("")) for c in columns}
    got = rows.join(b, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (blank[c].isNull() & F.col(f"_{c}").isNotNull())
    return got.withColumn("changed", changed).withColumns({c: F.coalesce(blank[c], f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
