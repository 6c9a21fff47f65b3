"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from dossier.llm.common import bucket_of_id, checkpointed, mix, slices, smallest, table

#: Labelled rows of each language that the filters are filled from, the smallest by a hash of their id.
SAMPLE = 2000
#: Lengths of the n-grams; their inner characters are letters, their ends letters or a gap.
SIZES = (3, 4)
#: A language contains an n-gram that it uses at least this share as often as the language that uses it most; what is rarer
#: there is foreign: names, quotations and texts in another language.
SHARE = 0.125
#: Slots for each n-gram of the largest language, probes of each n-gram, and the most slots: beyond them filters are fuller, and
#: what they wrongly hold is measured and corrected for.
SLOTS, PROBES, MOST = 16, 3, 1 << 23
#: Slots that one task fills.
CHUNK = 1 << 14
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the index of the text of each, and whether each text has a letter."""
    codes, ends = [np.zeros(1, np.uint32)], []
    for t in texts.to_pylist():
        codes += [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(1, np.uint32)]
        ends.append(len(codes[-2]) + 1)
    flat = np.concatenate(codes)
    owner = np.repeat(np.arange(len(ends)), ends)
    letter = _letters()[flat]
    flat = np.where(letter, flat, np.uint32(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    has = np.zeros(len(ends), bool)
    has[owner[letter[1:]]] = True
    owner, flat = np.r_[0, owner][keep], flat[keep].astype(np.uint64)
    gap = flat == 0
    hashes, owners = [], []
    for n in SIZES:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        whole = ~gap[1 : m + 1]
        for k in range(2, n - 1):
            whole &= ~gap[k : m + k]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + flat[k : m + k]
        hashes.append(mix(h[whole]))
        owners.append(owner[1 : m + 1][whole])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


def _positions(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slot of each probe of n-grams in a filter of `size` slots, a power of two."""
    at, step = hashes, (hashes >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (at & np.uint64(size - 1)).astype(np.int64)
        at = at + step


def _kind(languages: int) -> type:
    """The least integer with a bit for each language, of 64 bits for more than as many."""
    return next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 62, np.uint64)) if languages <= n)


@dataclass
class Filters:
    """One Bloom filter for each language, sliced: slots[i] holds bit i of every language's filter side by side, 64 to a word."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray

    def bit(self, words: np.ndarray, i: int) -> np.ndarray:
        """Language i's bit of rows of slots."""
        return (words[:, i // 64] >> words.dtype.type(i % 64)) & words.dtype.type(1)

    def holders(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, as rows of masks."""
        first, *more = _positions(hashes, len(self.slots))
        out = self.slots[first]
        for at in more:
            out &= self.slots[at]
        return out

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        hashes, owner, has = ngrams(texts)
        masks = self.holders(hashes)
        n = np.bincount(owner, minlength=len(has)).astype(float)
        hits = np.stack([np.bincount(owner, self.bit(masks, i), minlength=len(has)) for i in range(len(self.languages))])
        hits = np.maximum(0, (hits - n * self.wrong[:, None]) / np.maximum(1 - self.wrong[:, None], 1e-9))
        best = hits.argmax(axis=0)
        share = np.where(has, hits[best, np.arange(len(has))] / np.maximum(n, 1), 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.clip(share, 0, 1)


def fit(docs: DataFrame) -> Filters | None:
    """Filters of the n-grams that each language contains; None where there is no labelled row with an n-gram.

    A language contains an n-gram of its sampled rows if its share of the language's n-grams is at least SHARE times the
    largest share that it has in any language. With SHARE 0 all n-grams count, and the filters all fill with the same ones.
    Tasks fill the filters a chunk of slots each; the driver gets the filters alone, MOST slots at most.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.coalesce(bucket_of_id("doc_id", 4), F.lit(0)) != 2)).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = smallest(rows, "lang", ["h", "doc_id"], SAMPLE).select("doc_id", "lang")
    sample = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                hashes, owner, _ = ngrams(batch.column("text"))
                langs = batch.column("lang").to_pylist()
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])[owner] if len(owner) else owner
                for k, name in enumerate(names):
                    gram, n = np.unique(hashes[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = checkpointed(sample.select("text", "lang").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("p", F.col("n") / F.col("total"))
    held = checkpointed(shares.withColumn("top", F.max("p").over(W.partitionBy("gram"))).where(F.col("p") >= SHARE * F.col("top")).select("lang", "gram"))
    sizes = {r["lang"]: r["count"] for r in held.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    size = min(MOST, 1 << int(SLOTS * max(sizes.values()) - 1).bit_length())
    kind, chunk, width = _kind(len(languages)), min(CHUNK, size), (len(languages) + 63) // 64

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, of = np.asarray(batch.column("gram")).view(np.uint64), np.searchsorted(languages, batch.column("lang").to_pylist())
            mask = np.left_shift(np.uint64(1), (of % 64).astype(np.uint64)).view(np.int64)
            for at in _positions(gram, size):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of // 64), pa.array(mask)], names=["slot", "word", "mask"])

    def filled(part: pa.Table) -> pa.Table:
        slot, word, mask = (np.asarray(part.column(x)) for x in ("slot", "word", "mask"))
        out = np.zeros((chunk, width), np.uint64)
        out[slot % chunk, word] = mask.view(np.uint64)
        return pa.table({"chunk": pa.array([slot[0] // chunk]), "slots": pa.array([out.astype(kind).tobytes()], pa.binary())})

    bits = held.mapInArrow(probes, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    slots = np.zeros((size, width), kind)
    for row in bits.groupBy(F.expr(f"slot div {chunk}")).applyInArrow(filled, "chunk long, slots binary").collect():
        slots[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["slots"], kind).reshape(chunk, width)
    out = Filters(languages, slots, np.zeros(len(languages)))
    out.wrong = np.array([out.bit(slots, i).mean() for i in range(len(languages))]) ** PROBES
    return out


def identified(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """docs with lang_pred and score: the language that holds most n-grams of the text, and the share that it holds.

    Counts are corrected for each filter's false positives; ties go to the first language by name. A text that is
    null or has no letter, and every text where filters is None, gets `und` and 0. Columns of docs with these names
    are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if filters is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                names, score = shared.value.decide(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from; a null doc_id is never held out. Repeated
    rows get equal results; other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = identified(docs.select("doc_id", "text"), fit(docs))
    return got.select("doc_id", F.coalesce(bucket_of_id("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
