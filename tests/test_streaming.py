"""Each stream ends with what its batch twin says of the same rows."""

import datetime
import pathlib
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators.feedback import adjustments, context_counts, latest
from dossier.plans.bindings import feedback
from dossier.plans.registry import Tables
from dossier.streaming import jobs as J
from dossier.streaming import keyed_state as KS


@pytest.fixture(scope="module")
def rows(spark, sf, tmp_path_factory):
    """Feedback rows in three files, and their folder."""
    path = str(tmp_path_factory.mktemp("feedback"))
    frame = feedback(Tables(spark, sf)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    for k in range(3):
        frame.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), path


def drained(query):
    assert query.awaitTermination(300) and query.exception() is None


KEYS, ORDER = ["doc", "clause_type", "user_id"], ["created_at", "id"]


def test_upsert(spark, rows, tmp_path):
    frame, path = rows
    seen = []
    run = lambda: drained(J.upsert_stream(J.stream(spark, path, frame), str(tmp_path / "out"), KEYS, ORDER, str(tmp_path / "ck"), late="3650 days", buckets=4, after=lambda df, n: seen.append((n, df.count()))))
    run()
    twin = sorted(r["id"] for r in latest(frame, KEYS, ORDER).collect())
    got = J.snapshot(spark, str(tmp_path / "out"), frame.schema)
    assert sorted(r["id"] for r in got.collect()) == twin and got.columns == frame.columns
    assert seen[-1][1] == len(twin) and len(seen) >= 3
    # Two versions of a bucket at most are left, and a restart without new rows changes nothing.
    versions = [str(p) for p in (tmp_path / "out").glob("batch=*/bucket=*")]
    assert len(versions) <= 2 * 4
    run()
    assert sorted(r["id"] for r in J.snapshot(spark, str(tmp_path / "out"), frame.schema).collect()) == twin


def levels_of(df):
    return sorted(map(str, df.select("clause_type", "offering", "solution", "adjusted_level", "direction", "feedback_count", "top_suggested").collect()))


def test_live_consensus_after_restarts_with_late_and_repeated_rows(spark, rows, tmp_path):
    frame, path = rows
    targets = frame.select("clause_type", "offering", "solution").distinct().orderBy("clause_type", "offering", "solution").limit(40)
    targets = targets.unionByName(spark.createDataFrame([("ld", "", ""), ("scope", "NATION_1", ""), ("ld", "nowhere at all", "none")], targets.schema)).withColumn("system_level", F.lit("HIGH"))
    part, out = tmp_path / "in", str(tmp_path / "out")
    part.mkdir()
    files = sorted(pathlib.Path(path).glob("*.parquet"))
    # Rows by their third of ids, so reviewers change their minds in every batch; the first file comes again at the end, late and repeated.
    written = []
    for k, f in enumerate([*reversed(files), files[-1]]):
        shutil.copy(f, part / f"{k}.parquet")
        drained(KS.consensus_stream(J.stream(spark, str(part), frame), out, str(tmp_path / "ck"), parts=3))
        written.append(KS.counts_table(spark, out).versions()[-1])
    kept = latest(frame, KEYS, ORDER)
    assert levels_of(KS.live_levels(spark, out, targets, share=0.25)) == levels_of(adjustments(kept, targets, share=0.25))
    assert written == [1, 2, 3, 3] and len(KS.counts_table(spark, out).versions()) <= 2
    counts = KS.counts_table(spark, out).read().where("n > 0").groupBy(*KS.CONTEXT, "suggested_level").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("first").alias("first"))
    assert sorted(map(str, counts.collect())) == sorted(map(str, context_counts(kept).collect()))


def test_a_batch_costs_its_own_rows(spark, tmp_path):
    """The same few rows change as many counts after a long history as after none."""
    schema = "doc long, clause_type string, user_id long, created_at timestamp, id long, offering string, solution string, suggested_level string, agreement string"
    row = lambda i, day: (i, "ld", i, datetime.datetime(2024, 1, day), i * 100 + day, f"o{i % 5}", "", ("LOW", None)[i % 2], "too_high")
    changed = []
    for history in (0, 400):
        home = tmp_path / str(history)
        (home / "in").mkdir(parents=True)
        for k, batch in enumerate([[row(i, 1) for i in range(history)] or [row(9999, 1)], [row(i, 2) for i in range(4)]]):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(home / "tmp" / str(k)))
            shutil.copy(next((home / "tmp" / str(k)).glob("*.parquet")), home / "in" / f"{k}.parquet")
        sizes = []
        stream = KS.consensus_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(home / "in")), parts=2)
        with KS.keyed_store(spark):
            query = stream.writeStream.outputMode("append").foreachBatch(lambda df, n, sizes=sizes: sizes.append(df.count())).option("checkpointLocation", str(home / "ck")).trigger(availableNow=True).start()
        drained(query)
        changed.append(sizes[-1] if sizes[-1] else sizes[-2])
    assert changed[0] <= 4 and changed[1] <= 8


@pytest.mark.parametrize("seed", [1, 2])
def test_waits_of_a_stream_equal_the_table(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    schema = "provider string, call_id long, at long, status int, retry_after int"
    calls = [("pq"[int(rng.integers(2))], k, int(t), 429 if rng.random() < 0.05 else 200, int(rng.integers(0, 60)) if rng.random() < 0.5 else None) for k, t in enumerate(np.sort(rng.integers(0, 3000, 400)))]
    calls += [("r", 900, 5, 200, None), ("r", 901, 5, 429, None), ("r", 902, 6, 200, None)]
    (tmp_path / "in").mkdir()
    files = [min(2, (c[2] + int(rng.integers(0, 200))) // 1100) for c in calls]  # times lie within reach of the watermark, files overlap
    for k in range(3):
        part = [c for c, f in zip(calls, files, strict=True) if f == k] + [("end", 1000, 100_000, 200, None)] * (k == 2)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "tmp" / str(k)))
        shutil.copy(next((tmp_path / "tmp" / str(k)).glob("*.parquet")), tmp_path / "in" / f"{k}.parquet")
    frame = spark.createDataFrame(calls, schema)
    caps = {"p": 7, "q": 3, "r": 1}
    got = []
    for _ in range(2):  # a restart says nothing again
        stream = KS.call_waits(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), caps, window=40, late="30 minutes")
        with KS.keyed_store(spark):
            query = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        drained(query)
    table = J.call_rates(frame, spark.createDataFrame(list(caps.items()), "provider string, cap int"), window=40, spans=2)
    assert sorted((r["provider"], r["call_id"], r["wait"], r["in_cooldown"]) for r in got if r["provider"] != "end") == sorted(tuple(r) for r in table.select("provider", "call_id", "wait", "in_cooldown").collect())


def test_calls_over_span_borders(spark):
    rng = np.random.default_rng(4)
    calls = [("p", k, int(t), 429 if rng.random() < 0.1 else 200, None) for k, t in enumerate(np.sort(rng.integers(0, 2000, 300)))] + [("q", 900, 5, 200, None)]
    got = {r["call_id"]: r for r in J.call_rates(spark.createDataFrame(calls, "provider string, call_id int, at int, status int, retry_after int"), spark.createDataFrame([("p", 7)], "provider string, cap int"), window=40, spans=2).collect()}
    for p, k, t, _, _ in calls:
        recent = sum(q == p and t - 40 <= u <= t for q, _, u, _, _ in calls)
        refused = [u for q, _, u, s, _ in calls if q == p and s == 429 and u < t]
        before = sorted((u, n) for q, n, u, _, _ in calls if q == p and (u, n) < (t, k))[-7:]
        busy = before[0][0] + 40 - t if p == "p" and len(before) == 7 else 0
        assert got[k]["wait"] == max(0, busy, max(refused) + 180 - t if refused else 0)
        assert (got[k]["recent"], got[k]["over_cap"], got[k]["in_cooldown"]) == (recent, p == "p" and recent > 7, bool(refused) and t < max(refused) + 180)


@pytest.mark.parametrize("kind", ["windows", "progress"])
def test_aggregates(spark, rows, tmp_path, kind):
    frame, path = rows
    if kind == "windows":
        build = J.windowed_counts
    else:
        build = lambda df: J.latest_progress(df.select(F.col("user_id").alias("job"), F.col("agreement").alias("step"), F.col("id").alias("pct"), F.col("system_level").alias("status"), F.col("created_at").alias("ts"), F.col("id").alias("event_id")))
    query = build(J.stream(spark, path, frame)).writeStream.outputMode("complete").format("memory").queryName(f"out_{kind}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    drained(query)
    assert sorted(map(str, spark.table(f"out_{kind}").collect())) == sorted(map(str, build(frame).collect()))


def test_ingest(spark, rows, tmp_path):
    frame, path = rows
    for _ in range(2):
        drained(J.ingest_stream(J.stream(spark, path, frame), str(tmp_path / "registry"), "user_id", str(tmp_path / "ck"), buckets=4))
    got = spark.read.parquet(str(tmp_path / "registry"))
    assert got.count() == got.select("user_id").distinct().count() == frame.select("user_id").distinct().count()
