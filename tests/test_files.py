"""The source, stream and sink of document files."""

import os

import pytest
from pyspark.sql import functions as F

from dossier.plans.jobs import _docx
from dossier.sources.files import FolderReader, document_files, document_stream, write_files


def rows(spark, path, **options):
    return {r["path"].removeprefix(f"{path}/"): r for r in document_files(spark, str(path), **options).collect()}


def test_kinds_and_errors(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    files = {"a.txt": "héllo".encode(), "deep/b.MD": b"\xef\xbb\xbfx", "deep/er/c.docx": _docx("a <b>\n\nc & d"), "d.docx": b"PK\x03\x04broken", "e.pdf": b"%PDF-1.4 ...", "f.pdf": b"<html>", "g.txt": b"\xff\xfe\x00", "h.xls": b"1", "none": b"2", "empty.txt": b"", ".hidden.txt": b"3", "_log.txt": b"4"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    os.symlink(tmp_path / "gone", tmp_path / "i.txt")
    got = rows(spark, tmp_path)
    assert {k: (r["kind"], r["text"], r["error"]) for k, r in got.items() if k != "i.txt"} == {
        "a.txt": ("txt", "héllo", None), "deep/b.MD": ("md", "x", None), "deep/er/c.docx": ("docx", "a <b>\n\nc & d", None), "d.docx": ("docx", None, "unreadable: BadZipFile"), "e.pdf": ("pdf", None, None),
        "f.pdf": ("pdf", None, "unreadable: ValueError"), "g.txt": ("txt", None, "unreadable: UnicodeDecodeError"), "h.xls": ("xls", None, "unsupported type: xls"), "none": ("", None, "unsupported type: "), "empty.txt": ("txt", "", None),
    }
    assert bytes(got["f.pdf"]["content"]) == b"<html>" and got["h.xls"]["content"] is None and got["a.txt"]["length"] == 6
    small = rows(spark, tmp_path, maxBytes="5", supported="txt", content="false")
    assert small["a.txt"]["error"] == "too large: 6 bytes" and small["e.pdf"]["error"] == "unsupported type: pdf" and small["empty.txt"]["content"] is None


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert document_files(spark, str(tmp_path)).count() == 0


def test_a_file_that_goes_after_listing_is_an_error_row(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    reader = FolderReader({"path": f"file:{tmp_path}"})
    (part,) = reader.partitions()
    (tmp_path / "a.txt").unlink()
    (batch,) = reader.read(part)
    assert batch.column("error").to_pylist() == ["unreadable: FileNotFoundError"]


def test_partitions_are_packed_by_bytes(tmp_path):
    for k in range(10):
        (tmp_path / f"{k}.txt").write_bytes(b"x" * (100 if k == 4 else 10))
    parts = FolderReader({"path": str(tmp_path), "partitionBytes": "40", "partitionFiles": "3"}).partitions()
    assert [[f[1] for f in p.files] for p in parts] == [[10, 10, 10], [10], [100], [10, 10, 10], [10, 10]]


def test_written_files_come_back(spark, tmp_path):
    made = spark.range(500).select(F.concat("id", F.lit(".txt")).alias("path"), F.when(F.col("id") > 0, F.repeat(F.lit("é"), F.col("id").cast("int")).cast("binary")).alias("content"), F.lit(1).alias("other"))
    write_files(made, f"file:{tmp_path}/out")
    write_files(made.where("id % 2 = 0").withColumn("content", F.lit("again").cast("binary")), str(tmp_path / "out"))
    got = rows(spark, tmp_path / "out", partitionBytes="20000")
    assert {k: r["text"] for k, r in got.items()} == {f"{n}.txt": "é" * n if n % 2 else "again" for n in range(500)}
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".")]
    with pytest.raises(Exception, match="not a path below"):
        write_files(spark.createDataFrame([("../x.txt", b"1")], "path string, content binary"), str(tmp_path / "out"))


def test_a_stream_goes_on_at_its_offset(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def run():
        taken = []
        stream = document_stream(spark, str(folder), str(tmp_path / "log"))
        query = stream.writeStream.foreachBatch(lambda df, n: taken.extend((r["path"].rsplit("/", 1)[1], r["text"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        seen.append(sorted(taken, key=str))

    (folder / "a.txt").write_text("1")
    (folder / "b.xls").write_text("2")
    run()
    run()
    (folder / "c.txt").write_text("3")
    os.utime(folder / "c.txt", (1000, 1000))  # older than all that was read
    (folder / "a.txt").write_text("changed")
    os.utime(folder / "a.txt", (2000, 2000))
    run()
    assert seen == [[("a.txt", "1"), ("b.xls", None)], [], [("a.txt", "changed"), ("c.txt", "3")]]
    # An entry that was logged while Spark had not taken it up, as after a lost driver, belongs to the next batch.
    from dossier.sources.files import FolderStreamReader

    (folder / "d.txt").write_text("4")
    assert FolderStreamReader({"path": str(folder), "log": str(tmp_path / "log")}).latestOffset() == {"entry": 3}
    (folder / "e.txt").write_text("5")
    run()
    assert seen[-1] == [("d.txt", "4"), ("e.txt", "5")]
