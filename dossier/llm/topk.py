"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.llm.common import checkpointed, table

#: Segments of each level, coarse to fine.
LEVELS = (1, 4, 16)
#: Vectors of one block of candidates, and queries of one block: what a task holds.
CANDIDATES, QUERIES = 8192, 2048
#: Candidates that are bounded and scored together.
CHUNK = 1024
#: Above this share of survivors a level is worked out for the whole chunk at once.
DENSE = 0.05


def statistics(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, times the root of the segment's length."""
    parts = np.array_split(np.arange(m.shape[1]), min(segments, m.shape[1]))
    mean = np.stack([m[:, p].mean(axis=1) * len(p) ** 0.5 for p in parts], axis=1)
    dev = np.stack([m[:, p].std(axis=1) * len(p) ** 0.5 for p in parts], axis=1)
    return mean, dev


def search(q: np.ndarray, c: np.ndarray, q_keys: np.ndarray, c_keys: np.ndarray, c_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query's key, candidate's id, score) that hold each query's k best candidates but itself, ties to the smaller id.

    least: scores of which each query is known to have k; candidates below them are left out.

    |q - c|^2 is at least the sum over segments of (mean difference)^2 + (deviation difference)^2 times their
    length, so with lengths known the inner product is at most the sum of products of means and of deviations. A
    candidate whose bound at a level falls below the query's k-th score so far goes; the rest reach the next level and then
    the exact product.
    """
    exact = lambda i, j: np.einsum("ij,ij->i", q[i], c[j])
    best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    q_stats = [statistics(q, s) for s in LEVELS]
    for a in range(0, len(c), CHUNK):
        cc, ids = c[a : a + CHUNK], c_ids[a : a + CHUNK]
        own = q_keys[:, None] == c_keys[None, a : a + CHUNK]
        floor = best_s[:, -1] if least is None else np.maximum(best_s[:, -1], least)
        alive = ~own
        for (q_mean, q_dev), s in zip(q_stats, LEVELS, strict=True):
            c_mean, c_dev = statistics(cc, s)
            if alive.mean() > DENSE:
                bound = q_mean @ c_mean.T + q_dev @ c_dev.T
                alive &= bound * (1 + np.sign(bound) * 1e-9) + 1e-6 >= floor[:, None]
            else:
                i, j = np.nonzero(alive)
                bound = np.einsum("ij,ij->i", q_mean[i], c_mean[j]) + np.einsum("ij,ij->i", q_dev[i], c_dev[j])
                alive[i, j] = bound * (1 + np.sign(bound) * 1e-9) + 1e-6 >= floor[i]
        score = np.full(alive.shape, -np.inf)
        if alive.mean() > DENSE:
            score[alive] = (q @ cc.T)[alive]
        else:
            i, j = np.nonzero(alive)
            score[i, j] = exact(i, j + a)
        rows = np.flatnonzero((score >= floor[:, None]).any(axis=1) & alive.any(axis=1))
        if len(rows):
            s = np.concatenate([best_s[rows], score[rows]], axis=1)
            n = np.concatenate([best_i[rows], np.where(alive[rows], ids[None, :], np.iinfo(np.int64).max)], axis=1)
            order = np.lexsort((n, -s), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
    i, j = np.nonzero(np.isfinite(best_s))
    return q_keys[i], best_i[i, j], best_s[i, j]


def exact_integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles as Python's integers, exact for any size."""
    return np.array([[int(v) << 8 if abs(v) >= 2.0**52 else int(np.floor(256 * v)) for v in row] for row in x], object).reshape(x.shape)


def search_large(q: np.ndarray, c: np.ndarray, q_keys: np.ndarray, c_keys: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search, without bounds, in Python's integers; scores beyond a long become the nearest long."""
    out: tuple[list, list, list] = ([], [], [])
    for key, row in zip(q_keys, exact_integers(q), strict=True):
        score = np.clip(exact_integers(c) @ row, -(1 << 63), (1 << 63) - 1)
        for n, i, s in sorted((-s, i, s) for s, i, o in zip(score, c_ids, c_keys, strict=True) if o != key)[:k]:
            out[0].append(key), out[1].append(i), out[2].append(int(s))
    return tuple(np.array(x, np.int64) for x in out)


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components as doubles; rows that are null or hold null or non-finite components go."""
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float64)
            if i is not None and x is not None and len(x) and np.isfinite(x).all():
                ids.append(i)
                vectors.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "v"])


def _meet(k: int):
    """The k best of a block of candidates for each query of a block. Pairs whose products could leave the exact range of doubles are worked out in integers."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in set(map(len, left["v"])) & set(map(len, right["v"])) if len(left) and len(right) else ():
            p, r = left[left["v"].map(len) == size], right[right["v"].map(len) == size]
            q, c = (np.frombuffer(b"".join(x["v"]), np.float64).reshape(len(x), -1) for x in (p, r))
            keys, others, ids, least = p["key"].to_numpy(), r["key"].to_numpy(), r["vec_id"].to_numpy(), p["least"].to_numpy(np.float64, na_value=-np.inf)
            most = (2.0**53 / q.shape[1]) ** 0.5 / 256 - 1
            q_small, c_small = np.abs(q).max(axis=1) <= most, np.abs(c).max(axis=1) <= most
            parts = [search(np.floor(256 * q[q_small]), np.floor(256 * c[c_small]), keys[q_small], others[c_small], ids[c_small], k, least[q_small])]
            parts.append(search_large(q[~q_small], c, keys[~q_small], others, ids, k))
            if not c_small.all():
                parts.append(search_large(q[q_small], c[~c_small], keys[q_small], others[~c_small], ids[~c_small], k))
            out += [pd.DataFrame({"key": a, "vec_id": b, "score": np.asarray(s, np.int64)}) for a, b, s in parts]
        return pd.concat(out).astype("int64") if out else pd.DataFrame({x: pd.Series(dtype="int64") for x in ("key", "vec_id", "score")})

    return run


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    The score is the inner product of floor(256 * x) of the components, exact for finite components of any size (a score
    beyond a long is the nearest long); ties go to the smaller vec_id. Queries and candidates are cut into blocks by a
    hash. Each query first meets one block, which gives it a score that it can count on; then every block of queries meets
    every block of candidates in one task, which bounds by that score, keeps k rows for each of its queries, and a
    window ranks those.

    Vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no part;
    vectors of different lengths never meet. Rows that repeat a vec_id, or a whole row, are rows of their own: each is a
    candidate of the others, and each query row has its own k rows. Fewer than k candidates give as many rows; other
    columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_doubles, "vec_id long, v binary").groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    rows = checkpointed(rows.select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("vec_id", "v", F.xxhash64("vec_id", "v", "copy").alias("key")))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n, queries = rows.select(F.count("*"), F.count_if(is_query)).first()
    n_c, n_q = 1 + n // CANDIDATES, 1 + queries // QUERIES
    block = lambda n: F.pmod("key", F.lit(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = lambda left, right: left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_meet(k), "key long, vec_id long, score long")
    asked = rows.where(is_query).select("vec_id", "key", "v", F.lit(None).cast("double").alias("least"))
    candidates = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    if n_c > 1:
        once = met(asked.select("*", block(n_c).alias("cb"), F.lit(0).alias("qb")), candidates.select("*", block(n_c).alias("cb"), F.lit(0).alias("qb")))
        known = once.groupBy("key").agg(F.min("score").alias("low"), F.count("*").alias("held")).where(F.col("held") >= k).select("key", F.col("low").cast("double").alias("least"))
        asked = asked.drop("least").join(known, "key", "left").select("vec_id", "key", "v", "least")
    found = met(asked.select("*", block(n_q).alias("qb"), over(n_c).alias("cb")), candidates.select("*", block(n_c).alias("cb"), over(n_q).alias("qb")))
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("key", F.col("vec_id").alias("query_id")), "key").select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
