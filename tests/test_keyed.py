"""The document-keyed table: what a change keeps, what it rewrites, and what interrupted or concurrent commits leave."""

import threading

import pytest
from pyspark.sql import functions as F

from dossier.operators.feedback import merged
from dossier.sources import tables
from dossier.sources.keyed import Conflict, KeyedTable

SCHEMA = "doc long, k int, text string"


def chunks(spark, docs, word="old", each=3):
    return spark.createDataFrame([(d, k, f"{word} {d} {k}") for d in docs for k in range(each)], SCHEMA)


def held(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def expected(docs, word="old", each=3):
    return [(d, k, f"{word} {d} {k}") for d in docs for k in range(each)]


@pytest.fixture
def table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), "doc", buckets=8)
    table.replace(chunks(spark, range(200)))
    return table


def test_one_document_of_two_hundred(spark, table):
    assert table.replace(chunks(spark, [7], "new", 2)) == 2
    assert held(table) == sorted(expected([d for d in range(200) if d != 7]) + expected([7], "new", 2), key=str)
    assert held(table, 1) == sorted(expected(range(200)), key=str)


def test_only_touched_files_are_rewritten(spark, table):
    before = {f for f, _ in table.manifest()["files"]}
    table.replace(chunks(spark, [7], "new"))
    after = {f for f, _ in table.manifest()["files"]}
    assert len(before) >= 8 and len(before - after) == 1 and len(after - before) == 1
    table.replace(chunks(spark, [1000]))  # a document that no file holds: nothing is rewritten
    assert after < {f for f, _ in table.manifest()["files"]}


def test_sink_keeps_other_documents(spark, tmp_path):
    out = str(tmp_path / "sink")
    tables.write_by_document(chunks(spark, range(200)), out)
    assert tables.write_by_document(chunks(spark, [7]), out) == 2
    assert KeyedTable(spark, out, "doc").read().select("doc").distinct().count() == 200


def test_delete_patch_and_empty_documents(spark, table):
    table.delete(spark.createDataFrame([(3,), (3,), (999,)], "doc long"))
    table.replace(chunks(spark, [5], "new", 1), spark.createDataFrame([(6,)], "doc long"))
    table.patch(spark.createDataFrame([(8, 1, "patched"), (8, 9, "added")], SCHEMA), ["doc", "k"], merged)
    eight = [(8, 0, "old 8 0"), (8, 1, "patched"), (8, 2, "old 8 2"), (8, 9, "added")]
    assert held(table) == sorted(expected([d for d in range(200) if d not in (3, 5, 6, 8)]) + expected([5], "new", 1) + eight, key=str)
    table.delete(table.read())
    assert held(table) == [] and table.read().columns == ["doc", "k", "text"]
    table.replace(chunks(spark, [1]))
    assert held(table) == expected([1])


def test_null_keys_columns_by_name_and_large_documents(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "doc", buckets=2, rows_per_file=50)
    with pytest.raises(ValueError):
        table.read()
    table.replace(spark.createDataFrame([(None, 0, "a"), (None, 1, None), (1, 0, "b")], SCHEMA))
    table.replace(spark.createDataFrame([(None, 5, "c")], SCHEMA).select("text", "k", "doc"))
    assert held(table) == sorted([(None, 5, "c"), (1, 0, "b")], key=str)
    table.replace(chunks(spark, [2], each=500))
    assert len(table.manifest()["files"]) >= 10 and table.read().where("doc = 2").count() == 500
    table.delete(spark.createDataFrame([(None,)], "doc long"))
    assert table.read().where("doc is null").count() == 0


def test_interrupted_commit_leaves_the_old_version(spark, table, monkeypatch):
    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.replace(chunks(spark, [7], "new"))
    again = KeyedTable(spark, table.root, "doc")
    assert again.versions() == [1] and held(again) == sorted(expected(range(200)), key=str)
    assert again.replace(chunks(spark, [7], "new")) == 2
    assert len(again.vacuum(keep=2)) == 1 and held(again, 1) == sorted(expected(range(200)), key=str)
    again.vacuum()
    assert again.versions() == [2] and held(again) == sorted(expected([d for d in range(200) if d != 7]) + expected([7], "new"), key=str)


def test_a_later_commit_starts_over_from_the_first(spark, table):
    other = KeyedTable(spark, table.root, "doc")
    raced = []

    def build(old):
        if not raced:
            raced.append(other.replace(chunks(spark, [1], "first")))
        return chunks(spark, [1], "second")

    assert table.change(spark.createDataFrame([(1,)], "doc long"), build, None) == 3
    assert raced == [2] and held(table, 2) == sorted(expected([d for d in range(200) if d != 1]) + expected([1], "first"), key=str)
    assert held(table) == sorted(expected([d for d in range(200) if d != 1]) + expected([1], "second"), key=str)


def test_concurrent_writers_lose_nothing(spark, table):
    errors = []

    def write(d):
        try:
            KeyedTable(spark, table.root, "doc").replace(chunks(spark, [d], f"by {d}", 1))
        except Conflict as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(d,)) for d in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and table.versions() == [1, 2, 3, 4]
    assert held(table) == sorted(expected([d for d in range(200) if d not in (1, 2, 3)]) + [(d, 0, f"by {d} {d} 0") for d in (1, 2, 3)], key=str)
    assert table.read().agg(F.count_distinct("doc")).first()[0] == 200
