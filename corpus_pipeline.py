"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.llm import langid, minhash, mixing, packing, toxicity
from dossier.llm.common import shared_dir, table

#: A text of which every language holds less than this share of n-grams is in none of them.
LEAST_SHARE = 0.25
TOXIC = 0.7


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with every column but text under a number, so that no stage can meet its name, and the columns that bring the names back."""
    held = {c: "text" if c == "text" else f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]), [F.col(n).alias(c) for c, n in held.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay."""
    rows, back = _set_aside(docs)
    got = langid.identified(rows, langid.fit(docs))
    return got.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below TOXIC stay."""
    rows, back = _set_aside(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(rows, model).where(F.col("score") < TOXIC).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest doc_id, nulls last, then by the text's hash.

    Rows are told apart by doc_id and text, so a null or repeated doc_id costs no text; rows equal in both are one.
    """
    flat, back = _set_aside(docs)
    number = F.col(f"column_{docs.columns.index('doc_id')}")
    text = F.col("text").cast("string")
    own = F.xxhash64(number.isNull(), number, text.isNull(), text)
    rows = flat.withColumn("own", own)
    groups = minhash.near_duplicates(rows.select(F.col("own").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id").distinct()
    ids = rows.select("own", F.struct(number.isNull().alias("none"), number.alias("doc_id"), F.xxhash64(text).alias("hash"), "own").alias("rank"))
    kept = groups.join(ids, "own").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.own")
    one = F.row_number().over(W.partitionBy("own").orderBy(F.xxhash64(*flat.columns)))
    return rows.join(kept, "own", "left_semi").withColumn("one", one).where("one = 1").select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target asks."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs).drop("ids")


STAGES = [("language_id", language_id), ("toxicity", drop_toxic), ("minhash_near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: SQL expresses neither the language and toxicity models nor the tokenizer; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{number}-{name}")
        docs = spark.read.parquet(f"{at}/{number}-{name}")
    return docs
