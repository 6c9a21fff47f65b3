"""Dictionaries of phrases against plain search."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions.phrases import Dictionary, dictionaries, hits
from dossier.operators.retrieval import keyword_pages

SCHEMA = "label string, place int, phrase string"


def plain(text, phrases):
    out = {}
    for label, place, p in phrases:
        if text is None or label is None or p is None or p not in text:
            continue
        w, n, best = out.get(label, (0, 0, (1 << 30, 0)))
        out[label] = (w + 1, n + (text.count(p) if p else 0), min(best, (place, text.index(p) + 1)))
    return {k: (w, n, b[1]) for k, (w, n, b) in out.items()}


def owners(phrases):
    got = {}
    for label, place, p in phrases:
        got.setdefault(p, []).append((label, place))
    return got


@settings(max_examples=300, deadline=None)
@given(st.text("ab😀 ", max_size=40), st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 5), st.text("ab😀 ", max_size=4)), max_size=12))
def test_same_as_plain_search(text, phrases):
    got = {r["label"]: (r["words"], r["times"], r["first"]) for r in Dictionary(owners(phrases)).found(text)}
    assert got == plain(text, phrases)


PHRASES = [("a", 0, "ab"), ("a", 1, "b"), ("b", 0, "b"), ("b", 1, "nowhere"), ("c", 0, ""), ("a", 2, "ab"), (None, 0, "b"), ("d", 0, None), ("long", 0, "b" * 50)]
TEXTS = [(1, "abab b"), (2, ""), (3, None), (4, "zzz"), (1, "abab b"), (5, "b" * 200_000)]


@pytest.mark.parametrize("block", [500_000, 60])
def test_rows_of_a_table(spark, block):
    phrases = spark.createDataFrame(PHRASES, SCHEMA)
    assert len(dictionaries(phrases, block=block)) == (1 if block > 60 else 2)
    got = hits(spark.createDataFrame(TEXTS, "id int, text string"), F.col("text"), phrases, block=block)
    assert got.columns == ["id", "text", "label", "words", "times", "first"]
    want = sorted((i, k, *v) for i, t in TEXTS for k, v in plain(t, PHRASES).items())
    assert sorted(tuple(r) for r in got.drop("text").collect()) == want


def test_nothing_to_find(spark):
    texts, none = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame([], SCHEMA)
    assert hits(texts, F.col("text"), none).count() == 0
    assert hits(texts.where("false"), F.col("text"), spark.createDataFrame(PHRASES, SCHEMA)).count() == 0


def test_too_large_a_dictionary_is_refused(spark):
    with pytest.raises(ValueError, match="join by grams"):
        dictionaries(spark.createDataFrame([("a", 0, "x" * 100)], SCHEMA), block=50)
    with pytest.raises(ValueError, match="join by grams"):
        dictionaries(spark.createDataFrame([(str(k), 0, "x" * 10) for k in range(10)], SCHEMA), limit=100)


def test_ten_thousand_phrases_are_one_pass_without_a_product(spark):
    pages = spark.range(200).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page_no"), F.concat(F.lit("Phrase "), "id", F.lit(" and phrase "), F.col("id") * 7).alias("text"))
    words = spark.range(10_000).select(F.concat(F.lit("t"), "id").alias("topic"), F.array(F.concat(F.lit("phrase "), "id", F.lit(" "))).alias("words"))
    got = keyword_pages(pages, words)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r["topic"], r["page_no"], r["hits"]) for r in got.collect()} == {(f"t{k}", k, 1) for k in range(200)}
