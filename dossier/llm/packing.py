"""Packing documents into training sequences: order-preserving dynamic programming over cuts."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from dossier.llm.common import slices, table

LENGTH = 1024
END = 0
#: What a cut costs, in tokens of padding: none between documents, little after a sentence, more inside one.
SENTENCE, INSIDE = 4, 24
#: What a sequence shorter than LENGTH costs where its size is a power of two, so that it needs no padding.
SHORT = 48
#: Inside a run without a sentence's end, a cut may stand at every so many tokens.
STRIDE = 16
#: Of the sentences that end within so many tokens, the first may be cut after.
APART = 12
#: Tokens that a task plans at once; the unfinished last sequence is carried on.
PLAN = 1 << 18
SPECIAL = "<|endoftext|>"


class Vocabulary:
    """Token ids of texts from the byte-level vocabulary's ranks, which are those of byte_bpe_50k.json in another form."""

    def __init__(self, ranks: str) -> None:
        with open(ranks, "rb") as lines:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={SPECIAL: len(table_)})
        ending = (b".", b"!", b"?", b"\n")
        #: Whether each id's text ends a sentence: a full stop, an exclamation or question mark, or a new line.
        self.stops = np.zeros(self.coder.n_vocab, bool)
        self.stops[[i for x, i in table_.items() if x.rstrip(b" \"')")[-1:] in ending]] = True

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text and the end's id. The special token's text is that token, as in the vocabulary's own library.

        Runs of a hundred thousand spaces and more overflow the pattern's stack; such a text goes to the slower library.
        """
        try:
            got = self.coder.encode(text, allowed_special="all", disallowed_special=()) if SPECIAL in text else self.coder.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            got = list(_slow().encode(text, add_special_tokens=False).ids)
        got.append(END)
        return np.array(got, "<u4")


@lru_cache(maxsize=1)
def _slow() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=1)
def vocabulary(ranks: str) -> Vocabulary:
    """One for each Python worker, however many tasks it runs."""
    return Vocabulary(ranks)


def cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Indices into `at` of the cheapest cuts from the first position to the last.

    at holds the positions where a cut may stand, no gap longer than `length`; cost is what each costs. A sequence
    from i to j costs its padding, length - (at[j] - at[i]), and the cut's own cost; where j costs nothing (a document
    ends) and the size is a lesser power of two, it may cost SHORT instead. The padding falls as at[i] falls short, so the cheapest start of each end is the front of a
    queue kept in order of best[i] + at[i]; sizes that are powers of two are looked up beside it.
    """
    places, costs = at.tolist(), cost.tolist()
    where = {p: k for k, p in enumerate(places)}
    powers = [1 << k for k in range(6, length.bit_length()) if 1 << k < length]
    best, back = [0.0] * len(places), [0] * len(places)
    queue = deque([(0.0 + places[0], 0)])
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - length:
            queue.popleft()
        low, start = queue[0]
        low += length - p
        if not costs[j]:
            for size in powers:
                i = where.get(p - size)
                if i is not None and best[i] + SHORT < low:
                    low, start = best[i] + SHORT, i
        best[j], back[j] = low + costs[j], start
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(places) - 1
    while j:
        out.append(j)
        j = back[j]
    return np.array(out[::-1], np.int64)


def _candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may stand, and their costs: ends are the documents' ends, stops mark sentence-ending ids."""
    sentence = np.flatnonzero(stops[ids]) + 1
    cell = sentence // APART
    sentence = sentence[np.r_[True, cell[1:] != cell[:-1]]] if len(sentence) else sentence
    known = np.union1d(sentence, ends)
    known = np.union1d(known, [0, len(ids)])
    gaps = np.diff(known)
    long = gaps > 2 * STRIDE
    n = (gaps[long] - 1) // STRIDE
    inside = np.repeat(known[:-1][long], n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    at = np.union1d(known, inside).astype(np.int64)
    cost = np.full(len(at), INSIDE)
    cost[np.searchsorted(at, sentence)] = SENTENCE
    cost[np.searchsorted(at, ends)] = 0
    return at, cost


def _pack(ranks: str | None):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        partition = TaskContext.get().partitionId()
        held: list[tuple] = []  # document, ids before this part, its ids, ids of the whole document
        sequence = partition << 33

        def plan(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            ids = np.concatenate([h[2] for h in held]) if held else np.zeros(0, "<u4")
            if not len(ids):
                return
            ends = np.cumsum([len(h[2]) for h in held])
            at, cost = _candidates(ids, ends, words.stops)
            bounds = np.r_[0, at[cuts(at, cost)]]
            if not last and len(bounds) > 2:
                bounds = bounds[:-1]
            edges = np.union1d(bounds, ends[ends <= bounds[-1]])
            first = edges[:-1]
            owner = np.searchsorted(ends, first, side="right")
            which = np.searchsorted(bounds, first, side="right") - 1
            begin = ends - [len(h[2]) for h in held]
            columns: dict[str, list] = {n: [] for n in names}
            for a, b, k, s in zip(first.tolist(), edges[1:].tolist(), owner.tolist(), which.tolist(), strict=True):
                raw = ids[a:b].tobytes()
                doc, before, _, total = held[k]
                for n, v in zip(names, (doc, before + a - int(begin[k]), b - a, zlib.crc32(raw), total, sequence + s, a - int(bounds[s]), raw), strict=True):
                    columns[n].append(v)
            sequence += len(bounds) - 1
            k = int(np.searchsorted(ends, bounds[-1], side="right"))
            rest = held[k:]
            if rest:
                doc, before, own, total = rest[0]
                cut = int(bounds[-1] - begin[k])
                rest[0] = (doc, before + cut, own[cut:], total)
            held = rest
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], pa.binary() if n == "ids" else pa.int64()) for n in names], names=names)

        size = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = words.ids(text or "")
                    for a in range(0, len(ids), PLAN):
                        held.append((doc, a, ids[a : a + PLAN], len(ids)))
                        size += len(held[-1][2])
                        if size >= PLAN:
                            yield from plan(False)
                            size = sum(len(h[2]) for h in held)
        yield from plan(True)

    return run


def packed(docs: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Documents keep the order of their rows. Each partition packs its own stream of ids, every document followed by
    id 0. Of the places where a cut may stand, those are taken that cost least in padding and in cuts inside
    documents over a run of PLAN ids; a run's last sequence is left open and goes on in the next, so only a
    partition's last sequence is short for want of ids. sequence_id is unique over partitions. A null or empty text is its id 0 alone; repeated rows are packed as often as they stand; a null
    doc_id stays null; no rows give no rows. `ranks` is a file of the byte-level vocabulary's ranks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(ranks), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
