"""A knowledge graph as two tables: nodes (node, kind) and edges (source, target, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.functions.frames import small
from dossier.functions.phrases import hits


def ontology(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of (term, expansion, kind) rows, and an edge from each expansion to its term."""
    nodes = terms.select(F.col("term").alias("node"), "kind").unionByName(terms.select(F.col("expansion").alias("node"), F.lit("expansion").alias("kind"))).distinct()
    return nodes, terms.select(F.col("expansion").alias("source"), F.col("term").alias("target"), F.lit("SYNONYM_OF").alias("label")).distinct()


def mentions(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges from a term to the pages that hold it as a whole word: an equi-join on words."""
    words = pages.select("doc", "page_no", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[^A-Za-z0-9]+", " "), " "))).alias("term")).where("term <> ''")
    return words.join(small(terms.select("term").distinct()), "term").select(F.col("term").alias("source"), F.concat_ws(":", F.col("doc").cast("string"), F.col("page_no").cast("string")).alias("target"), F.lit("MENTIONED_AT").alias("label")).distinct()


def organisations(chunks: DataFrame, pattern: str, *, most: int = 10) -> DataFrame:
    """Edges from a document to the names that the pattern's first group finds, `most` of each chunk, cut to 100 characters."""
    found = F.slice(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), 1, most)
    return chunks.select(F.col("doc").cast("string").alias("source"), F.explode(found).alias("n")).select("source", F.substring(F.trim("n"), 1, 100).alias("target"), F.lit("INVOLVES").alias("label")).distinct()


def amounts(chunks: DataFrame, *, most: int = 5) -> DataFrame:
    """doc, chunk, crores of the first `most` amounts of each chunk: crores as they are, lakhs by 100, plain rupees by 10 million."""
    p = r"(?i)(?:rs\.?|inr)\s*([\d,]+(?:\.\d+)?)\s*(cr|lakh)?"
    zipped = F.slice(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("unit")), 1, most)
    rows = chunks.select("doc", "chunk", F.posexplode(zipped).alias("k", "a")).withColumn("v", F.replace(F.col("a.n"), F.lit(","), F.lit("")).try_cast("double"))
    unit = F.lower("a.unit")
    return rows.select("doc", "chunk", "k", F.when(unit == "cr", F.col("v")).when(unit == "lakh", F.col("v") / 100).otherwise(F.col("v") / 10_000_000).alias("crores"))


def signals(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """Edges from a risk (phrase, risk) to the documents that hold a phrase, found in one pass over a text (see phrases.hits)."""
    met = hits(chunks.select("doc", F.lower("text").alias("_t")), F.col("_t"), phrases.select(F.col("risk").alias("label"), F.lit(0).alias("place"), "phrase"))
    return met.select(F.col("label").alias("source"), F.col("doc").cast("string").alias("target"), F.lit("DETECTED_IN").alias("label")).distinct()


def expanded(text: Column, terms: list[tuple[str, str]]) -> Column:
    """The text with each term's first whole-word place followed by its expansion in brackets."""
    for term, meaning in terms:
        at = F.regexp_instr(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])"))
        text = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at + len(term) - 1), F.lit(f" ({meaning})"), F.substring(text, at + len(term), F.length(text)))).otherwise(text)
    return text


def first_offering(chunks: DataFrame, keywords: DataFrame, *, searched: int = 50) -> DataFrame:
    """doc, offering: that of the first keyword (place, keyword, offering) which stands in a document's first `searched` chunks."""
    rows = chunks.withColumn("_k", F.row_number().over(W.partitionBy("doc").orderBy("chunk"))).where(F.col("_k") <= searched)
    met = hits(rows.select("doc", F.lower("text").alias("_t")), F.col("_t"), keywords.select(F.col("keyword").alias("label"), "place", F.col("keyword").alias("phrase")))
    return met.select("doc", F.col("label").alias("keyword")).distinct().join(keywords, "keyword").groupBy("doc").agg(F.min_by("offering", "place").alias("offering"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, distinct organisations, detected risks."""
    e = edges.agg(F.count("*").alias("n_edges"), F.count_distinct(F.when(F.col("label") == "INVOLVES", F.col("target"))).alias("n_organisations"), F.count_distinct(F.when(F.col("label") == "DETECTED_IN", F.col("source"))).alias("n_risks"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(e)


def context(edges: DataFrame, *, most: int = 10) -> DataFrame:
    """One text for each target: the first `most` sources by label and name."""
    w = W.partitionBy("target").orderBy("label", "source")
    rows = edges.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    line = F.concat("label", F.lit(" "), F.col("source"))
    return rows.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", line.alias("line")))), lambda x: x["line"]), "; ").alias("context"))
