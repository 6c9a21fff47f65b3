"""Toxicity by class-conditional Kneser-Ney models of characters, whose rare expressions share one backoff of both classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import bucket_of_id, checkpointed, mix, slices, smallest, table

#: Labelled rows that the models are fitted on: so many toxic ones and so many times more ordinary ones, the smallest by a hash of their id.
SAMPLE, TIMES = 2000, 3
#: The scale of the scores is set by rows that models of the other folds have measured.
FOLDS = 4
#: Characters of an n-gram. Its first three are the context.
ORDER = 4
#: What each n-gram that a class has loses to the shared backoff, and what each kind loses in the backoff itself.
DISCOUNT, SHARED_DISCOUNT = 0.9, 0.75
#: Share of a toxic text's words that are expressions of the toxic model (the others come from the ordinary one), the largest
#: log ratio of a word, and words without a say that are added to a text's length. These, TIMES, ORDER and DISCOUNT were chosen by
#: cross-validation on learnable rows.
EXPRESSIONS, MOST, PRIOR = 0.003, 6.0, 50
GAP, OTHER = 0, 0xFFFF


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The 16-bit symbol of each code point: itself for letters and digits, OTHER for those beyond 16 bits, else a gap."""
    out = np.fromiter((c if chr(c).isalnum() else GAP for c in range(0x110000)), np.uint32, 0x110000)
    return np.minimum(out, OTHER)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-grams of all texts in order (four 16-bit symbols in 64 bits), the end of each word among them, and each word's text.

    Texts are lower-cased; a run of anything but letters and digits is one gap, and gaps stand before a text. A word's
    n-grams are those that end in one of its letters or in the gap after it.
    """
    parts, sizes = [], []
    for t in texts.to_pylist():
        codes = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [np.zeros(ORDER - 1, np.uint32), codes, np.zeros(1, np.uint32)]
        sizes.append(len(codes) + ORDER)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = _symbols()[np.concatenate(parts)]
    owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    letter = flat != GAP
    counted = letter.copy()
    counted[1:] |= letter[:-1]  # the gap after a word; the next text's first gaps never follow a letter
    keep = counted.copy()
    for k in range(ORDER - 1):
        keep[starts + k] = True
    symbols, counted, owner = flat[keep].astype(np.uint64), counted[keep], owner[keep]
    at = np.flatnonzero(counted)
    out = symbols[at]
    for k in range(1, ORDER):
        out |= symbols[at - k] << np.uint64(16 * k)
    ends = np.flatnonzero(symbols[at] == GAP)
    return out, ends, owner[at[ends]]


class Table:
    """Numbers by 64-bit key in an open hash table of at least twice the keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.keys, self.values, self.used, self.rounds = np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, bool), 0
        left = np.arange(len(keys))
        while len(left):
            at = self._place(keys[left], self.rounds)
            first = np.unique(at, return_index=True)[1]
            won = first[~self.used[at[first]]]
            self.keys[at[won]], self.values[at[won]], self.used[at[won]] = keys[left[won]], values[left[won]], True
            left = np.delete(left, won)
            self.rounds += 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((mix(keys) + np.uint64(step)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, 0 for none, and which keys have none."""
        out, missing = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self._place(keys, 0)
        for _ in range(self.rounds + 1):
            hit = self.used[at] & (self.keys[at] == keys[left])
            out[left[hit]] = self.values[at[hit]]
            missing[left[~self.used[at]]] = True
            on = self.used[at] & ~hit
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        missing[left] = True
        return out, missing


def _shared(kinds: np.ndarray, order: int) -> np.ndarray:
    """P(last symbol | the order - 1 before it) of each n-gram of that order, from how many different symbols stand before it in the kinds (order + 1).

    What a context has is discounted and the rest goes to the next shorter one, at last to every symbol alike and one unknown.
    """
    mask = np.uint64((1 << 16 * order) - 1)
    gram, n = np.unique(kinds & mask, return_counts=True)
    context, of = np.unique(gram >> np.uint64(16), return_inverse=True)
    total, types = np.bincount(of, n), np.bincount(of)
    if order == 1:
        lower = np.full(len(gram), 1 / (len(gram) + 1))
    else:
        shorter, p = _shared(gram, order - 1)
        lower = p[np.searchsorted(shorter, gram & np.uint64((1 << 16 * (order - 1)) - 1))]
    return gram, (np.maximum(n - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * types[of] * lower) / total[of]


@dataclass
class Model:
    """Log-likelihood ratios, toxic over ordinary: of n-grams, and for others of their context's shares left to the backoff."""

    seen: Table
    unseen: Table
    slope: float = 1.0
    bias: float = 0.0

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        out, missing = self.seen.get(keys)
        at = np.flatnonzero(missing)
        out[at] = self.unseen.get(keys[at] >> np.uint64(16))[0]
        return out

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the sum over its words of log(((1 - EXPRESSIONS) ordinary + EXPRESSIONS toxic) / ordinary) by its length, and its words."""
        keys, ends, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.r_[0.0, np.cumsum(self.ratios(keys))][np.r_[0, ends + 1]]
        word = np.log1p(EXPRESSIONS * np.expm1(np.minimum(np.diff(total), MOST)))
        return np.bincount(owner, word, minlength=len(texts)) / (n + PRIOR), n

    def scores(self, texts: pa.Array) -> np.ndarray:
        x, n = self.means(texts)
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(self.bias + self.slope * x, -50, 50))), 0.0)


def model(gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The models' ratios from distinct 4-grams and how often either class has them.

    P_c(w | h) = (max(n_c(hw) - DISCOUNT, 0) + DISCOUNT kinds_c(h) P(w | h')) / n_c(h), where P is the backoff that both
    classes share; a class without the context has P alone. For an n-gram that neither has, P cancels out.
    """
    order = np.argsort(gram)
    gram, counts = gram[order], (toxic[order], ordinary[order])
    context, of = np.unique(gram >> np.uint64(16), return_inverse=True)
    suffix, p = _shared(gram, ORDER - 1)
    backoff = p[np.searchsorted(suffix, gram & np.uint64((1 << 16 * (ORDER - 1)) - 1))]
    seen, unseen = np.zeros(len(gram)), np.zeros(len(context))
    for n, sign in zip(counts, (1, -1), strict=True):
        total, kinds = np.bincount(of, n), np.bincount(of, n > 0)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[of]
        seen += sign * np.log(own + left[of] * backoff)
        unseen += sign * np.log(left)
    return Model(Table(gram, seen), Table(context, unseen))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-grams of each slice by fold, and how often toxic and ordinary texts have them."""
    for whole in batches:
        for batch in slices(whole, "text"):
            kind = np.asarray(batch.column("fold")) * 2 + (np.asarray(batch.column("toxic")) == 1)
            for k in np.unique(kind):
                gram, n = np.unique(grams(batch.column("text").filter(pa.array(kind == k)))[0], return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(n), k // 2, np.int32)), pa.array(n if k % 2 else none), pa.array(none if k % 2 else n)], names=["gram", "fold", "t", "o"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method with a weak pull to 0; both classes weigh alike."""
    scale = float(np.std(x)) or 1.0
    a, weight = np.c_[x / scale, np.ones(len(x))], np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y != 1).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        hessian = a.T @ (a * (weight * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - 0.01 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Up to SAMPLE toxic rows and TIMES as many ordinary ones with their text, equal texts once; the ids that are broadcast are as few."""
    ids = labels.where(F.col("toxic").isin(0, 1) & (bucket_of_id("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    ids = smallest(ids, "toxic", ["h", "doc_id"], TIMES * SAMPLE)
    ids = ids.where((F.col("toxic") == 0) | (F.col("place") <= SAMPLE))
    got = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id")
    once = got.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    return once.select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled rows of docs; None where either class has no row with a letter.

    The kinds of n-grams of at most (1 + TIMES) * SAMPLE texts reach the driver. Scores are put on a logistic scale by
    the sample's rows, each measured by models that have not seen its fold; both classes weigh alike.
    """
    sample = checkpointed(_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")))
    counted = sample.mapInArrow(_counts, "gram long, fold int, t long, o long").groupBy("gram", "fold").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).toPandas()
    gram, at = np.unique(counted["gram"].to_numpy().view(np.uint64), return_inverse=True)

    def without(fold: int | None) -> Model | None:
        use = (counted["fold"] != fold).to_numpy() if fold is not None else np.ones(len(counted), bool)
        t, o = (np.bincount(at[use], counted[c].to_numpy()[use], len(gram)) for c in "to")
        return model(gram[t + o > 0], t[t + o > 0], o[t + o > 0]) if t.any() and o.any() else None

    fitted = without(None)
    if fitted is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast([without(k) for k in range(FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fold = np.asarray(batch.column("fold"))
                for k in np.unique(fold):
                    part = batch.filter(pa.array(fold == k))
                    if shared.value[k] is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(shared.value[k].means(part.column("text"))[0]), part.column("toxic").cast(pa.int32())], names=["x", "y"])

    scale = sample.select("text", "toxic", "fold").mapInArrow(measure, "x double, y int").toPandas()
    if scale["y"].nunique() == 2:
        fitted.slope, fitted.bias = _logistic(scale["x"].to_numpy(), scale["y"].to_numpy())
    return fitted


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `score`, the probability that the text is toxic; texts that are null or without a letter, and all where model is None, score 0. A column called score is replaced."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column("text")))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Rows whose crc32(doc_id as text) mod 3 is 1 are never learned from; a null doc_id is never held out nor
    learned from. A label other than 0 and 1 is ignored, and of several labels of one document the larger counts.
    Repeated rows score alike; other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = scored(docs, fit(docs, labels))
    return got.select("doc_id", F.coalesce(bucket_of_id("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
