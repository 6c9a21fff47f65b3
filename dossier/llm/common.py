"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of text that one numpy pass handles at once; bounds a task's memory whatever the batch holds.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, one of our own where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="dossier-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucket_of_id(col: str, mod: int) -> Column:
    """crc32 of an id written as text, modulo mod; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def smallest(rows: DataFrame, kind: str, order: list[str], n: int) -> DataFrame:
    """The n rows of each kind that come first by `order`, whose first column is a 64-bit hash, with their `place`.

    A kind's rows are counted first, and only those under a share of the hashes that holds about 4 n of them are
    ranked, so no task sees more of a kind, however large it is.
    """
    sizes = rows.groupBy(kind).agg(F.count("*").alias("_n")).withColumnRenamed(kind, "_kind")
    least = rows.join(sizes, F.col(kind) == F.col("_kind")).where(F.col(order[0]).cast("double") <= F.lit(2.0**64) * (F.lit(4.0 * n + 100) / F.col("_n")) - 2.0**63)
    ranked = least.withColumn("place", F.row_number().over(W.partitionBy(kind).orderBy(*order)))
    return ranked.where(F.col("place") <= n).drop("_kind", "_n")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows whose texts hold about `limit` bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, data, _ = utf8(batch.column(column))
    ends = data[1:] - data[0]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (from the bytes' start) and validity of an Arrow string array; nulls are empty."""
    if pa.types.is_large_string(array.type):
        kind = np.int64
    elif pa.types.is_string(array.type):
        kind = np.int32
    else:
        array, kind = array.cast(pa.string()), np.int32
    valid = ~np.asarray(array.is_null(), dtype=bool)
    n = len(array)
    if n == 0 or array.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], valid


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, near inputs scatter."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component = smallest id reachable) for every node with an edge.

    Labels travel to neighbours as a minimum that is aggregated before the shuffle, then jump to their own
    label's label, so a path of length n takes about log n rounds. Every round is checkpointed. Self-loops,
    repeated edges and nulls are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    both = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.join(near, "id").select(F.col("id").alias("label"), F.least("label", "near").alias("up"))
        labels = checkpointed(step.join(up, "label").select("id", "old", F.least("label", "up").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")
