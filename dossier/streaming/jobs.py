"""Structured Streaming jobs, each with the batch function that says the same of a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W


def stream(spark: SparkSession, path: str, like: DataFrame, time: str | None = None, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream of like's schema; a time column without zone becomes a timestamp."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows if time is None else rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(rows: DataFrame, *, time: str = "created_at", length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows for each window, clause type and agreement, on a stream or a table; the watermark holds on a stream only."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(time, length).alias("w"), "clause_type", "agreement").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "clause_type", "agreement", "n")


def latest_progress(rows: DataFrame) -> DataFrame:
    """The last (step, pct, status) of each job by time and event id: state of one row a job on a stream."""
    return rows.groupBy("job").agg(F.max_by(F.struct("step", "pct", "status"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n")).select("job", "last.*", "n")


def _versions(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """Rows of the batches under path before the given one, with their batch and bucket."""
    layout = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(layout).parquet(path).where(F.col("batch") < before)


def _newest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("bucket").agg(F.max("batch").alias("batch"))


def _store(rows: DataFrame, path: str, number: int) -> None:
    rows.withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def snapshot(spark: SparkSession, path: str, schema: T.StructType, before: int = 1 << 62) -> DataFrame:
    """What upsert_stream keeps under path: of each bucket the newest version."""
    versions = _versions(spark, path, schema, before)
    return versions.join(_newest(versions), ["bucket", "batch"]).drop("bucket", "batch")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, *, time: str = "created_at", late: str = "1 day", buckets: int = 64, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep, under path, the last row of each key of a stream, in buckets by key.

    Rows seen twice within the watermark are dropped. A batch rewrites only the buckets that it touches, from their
    newest versions before it, so a batch that is run again, as after a restart, changes nothing; versions that neither this batch nor its
    repetition can need are deleted. `after` gets each new snapshot.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        every = batch.select("*", bucket)
        if number:
            versions = _versions(spark, path, batch.schema, number)
            needed = _newest(versions).join(every.select("bucket").distinct(), "bucket", "left_semi")
            every = versions.join(needed, ["bucket", "batch"]).drop("batch").unionByName(every)
        w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        _store(every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), path, number)
        if number:
            places = _versions(spark, path, batch.schema, number).select("bucket", "batch").distinct()
            old = places.join(_newest(places), ["bucket", "batch"], "left_anti").collect()  # a version of each touched bucket at most
            for r in old:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={r['batch']}/bucket={r['bucket']}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if after is not None:
            after(snapshot(spark, path, batch.schema, number + 1), number)

    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(rows: DataFrame, registry: str, key: str, checkpoint: str, *, order: list[str] | None = None, buckets: int = 64) -> StreamingQuery:
    """Add to the registry only rows whose key it does not hold yet, each key once; a batch reads the buckets of its own keys.

    Of several rows of a key in one batch the first by order is kept, any without order.
    """

    def add(batch: DataFrame, number: int) -> None:
        if order is None:
            new = batch.dropDuplicates([key])
        else:
            new = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        new = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if number:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` at most
            known = _versions(batch.sparkSession, registry, batch.schema, number).where(F.col("bucket").isin(touched))
            new = new.join(known.select(key), key, "left_anti")
        _store(new, registry, number)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_rates(calls: DataFrame, caps: DataFrame, *, window: int = 60, cooldown: int = 180, least: int = 10, spans: int = 64) -> DataFrame:
    """calls (provider, call_id, at in seconds, status, retry_after) with calls in the trailing window, over_cap, in_cooldown and wait.

    caps: provider, cap. A call is in a cooldown if the provider's last refusal (429) before it was under its
    retry_after (`cooldown` if unknown, `least` at least) seconds ago; of refusals at one time the longest counts. wait is the least
    number of seconds after which the call would be within the cap and out of the cooldown: the call `cap` places before it, by at and call_id, must have left the window. A
    provider's calls are cut into spans of `spans` windows, each with the last window of the one before and the last
    refusal of all before, so a busy provider is the work of many tasks.
    """
    length = spans * window
    wait = F.greatest(F.coalesce("retry_after", F.lit(cooldown)), F.lit(least))
    rows = calls.withColumns({"_span": F.floor(F.col("at") / length), "_own": F.lit(True), "_refused": F.when(F.col("status") == 429, F.struct("at", wait.alias("wait")))})
    again = rows.where(F.pmod("at", F.lit(length)) >= length - window).withColumns({"_span": F.col("_span") + 1, "_own": F.lit(False)})
    in_span = W.partitionBy("provider", "_span").orderBy("at")
    seen = rows.unionByName(again).withColumns({"recent": F.count("*").over(in_span.rangeBetween(-window, 0)), "_r": F.max("_refused").over(in_span.rangeBetween(W.unboundedPreceding, -1))}).where("_own")
    last = rows.groupBy("provider", "_span").agg(F.max("_refused").alias("_last"))
    before = last.select("provider", "_span", F.max("_last").over(W.partitionBy("provider").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    # A call's place in its provider's order: its place in the span, after all calls of the spans before.
    sizes = rows.groupBy("provider", "_span").agg(F.count("*").alias("_n"))
    starts = sizes.select("provider", "_span", F.coalesce(F.sum("_n").over(W.partitionBy("provider").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("provider", "_span").orderBy("at", "call_id"))
    got = seen.withColumn("_place", place).join(before, ["provider", "_span"]).join(starts, ["provider", "_span"]).withColumns({"_r": F.coalesce("_r", "_before"), "_place": F.col("_place") + F.col("_start")}).join(caps, "provider", "left")
    earlier = got.select("provider", F.col("_place").alias("_freed"), F.col("at").alias("_left"))
    got = got.withColumn("_freed", F.col("_place") - F.col("cap")).join(earlier, ["provider", "_freed"], "left")
    return got.withColumns({"over_cap": F.coalesce(F.col("recent") > F.col("cap"), F.lit(False)), "in_cooldown": F.coalesce(F.col("at") < F.col("_r.at") + F.col("_r.wait"), F.lit(False)), "wait": F.greatest(F.coalesce(F.col("_left") + window - F.col("at"), F.lit(0)), F.coalesce(F.col("_r.at") + F.col("_r.wait") - F.col("at"), F.lit(0)), F.lit(0)).cast("long")}).drop("_r", "_place", "_start", "_freed", "_left", "_refused", "_before", "_span", "_own", "cap")
