"""Pages of word boxes: what travels, and the same results from rows of words."""

from dossier.operators import layout as L
from dossier.plans import catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_need_no_shuffle(spark, sf):
    for name in ("l1_header_rows", "l12_markdown"):
        assert "Exchange" not in _plan(catalog.queries()[name](spark, sf))


def test_facts_read_numbers_once(spark, sf):
    plan = catalog.queries()["e1_facts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(") <= 2


def test_pages_of_rows_of_words(spark):
    words = spark.createDataFrame([(1, 1, 0.0, 10.0, 5.0, "a"), (1, 1, 30.0, 11.0, 35.0, "b"), (1, 1, 0.0, 30.0, 5.0, "c"), (1, 2, 0.0, 10.0, 5.0, "d")], "doc int, page int, x0 double, y0 double, x1 double, text string")
    pages = L.packed(words)
    assert sorted(L.boxes(pages, "x0", "y0", "x1", "text").collect()) == sorted(words.collect())
    assert {(r.page, r.table) for r in L.markdown(pages).collect()} == {(1, "| a | b |\n| c |"), (2, "| d |")}
    anchors = spark.createDataFrame([(1, "X", 1, 11.0), (1, "Y", 1, 30.0)], "doc int, code string, page int, y0 double")
    got = L.boxes(L.assigned(pages, anchors, slack=0), "text", "code").collect()
    assert {(r.text, r.code) for r in got} == {("a", None), ("b", "X"), ("c", "Y"), ("d", "Y")}
