"""Scores, clusters and types of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A signal of a page: its pattern, the points of each match, and the most that it gives (None: no limit; once: any match counts once).
Signal = tuple[str, float, float | None]


def page_score(text: Column, signals: list[Signal]) -> Column:
    """Sum of points of the signals' matches in a page's text."""
    total = F.lit(0.0)
    for pattern, points, most in signals:
        got = F.regexp_count(text, F.lit(pattern)) * F.lit(float(points))
        total = total + (F.least(got, F.lit(float(most))) if most is not None else got)
    return F.round(F.coalesce(total, F.lit(0.0)), 4)


def table_run(scores: DataFrame, *, strong: float = 12.0, weak: float = 4.0, broken: float = 3.0, cap: int = 35, searched: int = 120) -> DataFrame:
    """doc, page_no of the table's pages of scores (doc, page_no, score, is_break).

    The run starts at the first page with `strong` points, else at the best page, the first of several. It ends
    before a section break with less than `broken` points, or before the second of two pages in a row under `weak`
    once three pages are in; documents without a page over `weak` have none; `cap` pages at most.
    """
    rows = scores.where(F.col("page_no") <= searched)
    start = rows.groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("score") >= strong, F.col("page_no"))), F.max_by("page_no", F.struct("score", -F.col("page_no")))).alias("start"), F.max("score").alias("best")).where(F.col("best") > weak).drop("best")
    run = rows.join(start, "doc").where("page_no >= start")
    before = F.lag("score").over(W.partitionBy("doc").orderBy("page_no"))
    run = run.withColumn("before", before)
    ends = (F.col("page_no") > F.col("start")) & ((F.col("is_break") & (F.col("score") < broken)) | ((F.col("score") < weak) & (F.col("before") < weak) & (F.col("page_no") - F.col("start") > 2)))
    stop = run.where(ends).groupBy("doc").agg(F.min("page_no").alias("stop"))
    return run.join(stop, "doc", "left").where("stop is null or page_no < stop").where(F.col("page_no") < F.col("start") + cap).select("doc", "page_no")


def with_neighbours(scores: DataFrame, *, hot: float = 8.0, bonus: float = 2.0) -> DataFrame:
    """scores with `bonus` points for each adjacent page of `hot` points."""
    w = W.partitionBy("doc").orderBy("page_no")
    near = F.lit(0.0)
    for side, step in ((F.lag, -1), (F.lead, 1)):
        near = near + F.when((side("page_no").over(w) == F.col("page_no") + step) & (side("score").over(w) >= hot), bonus).otherwise(0.0)
    return scores.withColumn("score", F.col("score") + near)


def best_cluster(scores: DataFrame, *, least: float = 6.0, gap: int = 2, span: int = 25, toc: DataFrame | None = None) -> DataFrame:
    """doc, page_no of the heaviest cluster: pages with `least` points, at most `gap` apart, weight the sum of points.

    With a table of contents (doc, toc_start), of the two heaviest the one that comes nearer to it. Equal ones: the first. Pages more than `span` after its first go.
    """
    w = W.partitionBy("doc").orderBy("page_no")
    rows = scores.where(F.col("score") >= least).withColumn("_new", (F.col("page_no") - F.coalesce(F.lag("page_no").over(w), F.col("page_no")) > gap).cast("long"))
    rows = rows.withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    weights = rows.groupBy("doc", "cluster").agg(F.sum("score").alias("weight"), F.min("page_no").alias("first"), F.collect_list("page_no").alias("pages"))
    weights = weights.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("weight"), "first")))
    if toc is None:
        chosen = weights.where("k = 1")
    else:
        near = weights.where("k <= 2").join(toc, "doc", "left").withColumn("far", F.array_min(F.transform("pages", lambda p: F.abs(p - F.col("toc_start")))))
        chosen = near.withColumn("j", F.row_number().over(W.partitionBy("doc").orderBy(F.when(F.col("toc_start").isNotNull(), F.col("far")), "k"))).where("j = 1")
    return rows.join(chosen.select("doc", "cluster", "first"), ["doc", "cluster"]).where(F.col("page_no") <= F.col("first") + span).select("doc", "page_no")


def toc_range(lines: DataFrame, start: str, following: str, *, low: int = 5, high: int = 250, within: int = 20) -> DataFrame:
    """doc, toc_start, toc_end: from the first line that meets `start` and ends in a page number from low to high, to the next line (of `within`) that meets
    `following` or ends in a later page."""
    rows = lines.withColumn("_page", F.regexp_extract(F.rtrim("text"), r"(\d{1,3})$", 1).try_cast("int"))
    first = rows.where(F.rlike(F.lower("text"), F.lit(start)) & F.col("_page").between(low, high)).groupBy("doc").agg(F.min_by(F.struct("line_no", "_page"), "line_no").alias("s"))
    after = rows.join(first, "doc").where((F.col("line_no") > F.col("s.line_no")) & (F.col("line_no") < F.col("s.line_no") + within))
    hit = after.where(F.rlike(F.lower("text"), F.lit(following)) | (F.col("_page") > F.col("s._page")))
    end = hit.groupBy("doc").agg(F.min_by("_page", "line_no").alias("e"))
    return first.join(end, "doc", "left").select("doc", F.col("s._page").alias("toc_start"), F.when(F.col("e") >= F.col("s._page"), F.col("e")).alias("toc_end"))


def assessment_pages(pages: DataFrame, header: str, marks: str, *, span: int = 25) -> DataFrame:
    """doc, page_no from the last page with header and marks on: pages with marks, `span` after it at most."""
    rows = pages.withColumns({"_h": F.rlike(F.lower("text"), F.lit(header)), "_m": F.rlike(F.lower("text"), F.lit(marks))})
    start = rows.where("_h and _m").groupBy("doc").agg(F.max("page_no").alias("start"))
    return rows.join(start, "doc").where(F.col("_m") & F.col("page_no").between(F.col("start"), F.col("start") + span)).select("doc", "page_no")


def page_type(text: Column, rules: list[tuple[str, str, float]], blank: int = 50) -> Column:
    """type and confidence of a page: blank under `blank` characters, else the first rule (pattern, type, confidence), else narrative 0.5."""
    out = F.struct(F.lit("narrative").alias("type"), F.lit(0.5).alias("confidence"))
    for pattern, kind, sure in reversed(rules):
        out = F.when(F.rlike(F.lower(text), F.lit(pattern)), F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))).otherwise(out)
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < blank, F.struct(F.lit("blank").alias("type"), F.lit(1.0).alias("confidence"))).otherwise(out)


def pages_of_types(typed: DataFrame, *, least: float = 0.5) -> DataFrame:
    """doc, type, n, pages: how many pages of each type a document has, and those of enough confidence in order."""
    return typed.groupBy("doc", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("confidence") >= least, F.col("page_no")))).alias("pages"))


def first_page(pages: DataFrame, signal: str) -> DataFrame:
    return pages.where(F.rlike(F.lower("text"), F.lit(signal))).groupBy("doc").agg(F.min("page_no").alias("page_no"))


def figures(extractions: DataFrame, schema: str, field: str) -> DataFrame:
    """One row for each entry of a JSON list inside `data`, with doc and page_no; unreadable data has none."""
    return extractions.select("doc", "page_no", F.from_json("data", schema).alias("d")).select("doc", "page_no", F.inline(F.col(f"d.{field}")))
