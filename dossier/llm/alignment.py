"""Cross-tokenizer alignment: linked token pairs, counted over the corpus by external spill counting."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from dossier.llm.common import mix, slices, table
from dossier.llm.warc import save

#: Bytes of text that one block holds; pairs that a task counts before it spills them; pairs in one frame of a run.
BLOCK, SPILL, FRAME = 2 << 20, 1 << 21, 1 << 16
#: Radix partitions: each holds the pairs of its share of A ids, a few megabytes for a gigabyte of text.
RADIXES = 64
#: Groups with more links than this are counted by their distinct ids.
WIDE = 4096


class Coders:
    """Both tokenizers, the bytes of their tokens, and their ids as text."""

    def __init__(self, ranks: str, vocabulary: str, pieces: str) -> None:
        with open(ranks, "rb") as lines:
            entries = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.vocabulary = vocabulary
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        sizes = {i: len(x) for x, i in entries.items()}
        self.a_size = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if max(len(self.a_size), n) > 1 << 16:
            raise ValueError("ids of 16 bits only")
        #: Text of every id with what may follow it: A's with a comma or a bar, B's with a comma or a semicolon.
        said = [f"{i}{end}" for ids, ends in ((range(len(self.a_size)), ",|"), (range(n), ",;")) for end in ends for i in ids]
        self.said_size = np.array([len(x) for x in said])
        self.said = np.array(said, "S6").view(np.uint8).reshape(-1, 6)

    @staticmethod
    @lru_cache(maxsize=1)
    def _slow(vocabulary: str) -> Tokenizer:
        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def a_ids(self, text: str) -> np.ndarray:
        """Ids by A. Runs of a hundred thousand spaces and more overflow the pattern's stack; such a text goes to the slower library."""
        try:
            return np.array(self.a.encode_ordinary(text), np.int64)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return np.array(self._slow(self.vocabulary).encode(text, add_special_tokens=False).ids, np.int64)


@lru_cache(maxsize=1)
def coders(ranks: str, vocabulary: str, pieces: str) -> Coders:
    """One for each Python worker, however many tasks it runs."""
    return Coders(ranks, vocabulary, pieces)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that high bytes, mostly zero, take next to nothing."""
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack(frame: bytes, *kinds: str) -> list[np.ndarray]:
    planes = zstandard.ZstdDecompressor().decompress(frame)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(planes) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def _reduced(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


class Block:
    """Groups, links and their digests of a run of documents."""

    def __init__(self, use: Coders, ids: list[int | None], texts: list[str | None]) -> None:
        self.ids = ids
        n = len(ids)
        b_all = use.b.encode([t or "" for t in texts], num_threads=1)
        a_parts, b_parts, owner = [], [], []
        for k, (text, b) in enumerate(zip(texts, b_all, strict=True)):
            if not text:
                continue
            data = b" " + text.encode()
            a, b = use.a_ids(" " + text), np.array(b, np.int64)
            if use.a_size[a].sum() == len(data) == use.b_size[b].sum() and b"".join(map(use.b_bytes.__getitem__, b.tolist())) == data:
                a_parts.append(a)
                b_parts.append(b)
                owner.append(k)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.sha = [""] * n
        self.keys, self.weights, self.entries = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(n, np.int64)
        if not owner:
            return
        owner = np.array(owner)
        self.n_a[owner], self.n_b[owner] = [len(x) for x in a_parts], [len(x) for x in b_parts]
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        doc = np.repeat(owner, self.n_a[owner])
        a_end, b_end = np.cumsum(use.a_size[a]), np.cumsum(use.b_size[b])
        a_last, b_last = self._both(a_end, b_end)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        a_n, b_n = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
        of = doc[a_last]
        self.n_groups = np.bincount(of, minlength=n)
        links = a_n * b_n
        so_far = np.r_[0, np.cumsum(links)]
        bounds = np.r_[0, np.cumsum(self.n_groups)]
        self.n_links = so_far[bounds[1:]] - so_far[bounds[:-1]]
        self._digest(use, owner, a, b, a_last, b_last, a_group, b_group, b_at, a_at + a_n)
        self._count(a, b, doc, of, a_group, a_n, b_n, a_at, b_at, links)

    @staticmethod
    def _both(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, whether one of the other side ends where it does."""
        ends = np.zeros((2, int(a_end[-1]) + 1), bool)
        ends[0, a_end] = True
        ends[1, b_end] = True
        return ends[1, a_end], ends[0, b_end]

    def _digest(self, use: Coders, owner, a, b, a_last, b_last, a_group, b_group, b_before, a_through) -> None:
        """Hash the groups' ids as text: A's tokens of a group, then B's."""
        at = np.empty(len(a) + len(b), np.int64)
        at[np.arange(len(a)) + b_before[a_group]] = a + a_last * len(use.a_size)
        at[np.arange(len(b)) + a_through[b_group]] = 2 * len(use.a_size) + b + b_last * len(use.b_size)
        size = use.said_size[at]
        text = memoryview(use.said[at][np.arange(6) < size[:, None]])
        ends = np.cumsum(size)[np.cumsum(self.n_a[owner] + self.n_b[owner]) - 1]
        for k, start, end in zip(owner.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            self.sha[k] = hashlib.sha256(text[start : end - 1]).hexdigest()

    def _count(self, a, b, doc, of, a_group, a_n, b_n, a_at, b_at, links) -> None:
        """Each document's distinct linked pairs in order, and how often it links them."""
        wide = links > WIDE
        repeat = np.where(wide, 0, b_n)[a_group]
        a_index = np.repeat(np.arange(len(a)), repeat)
        within = np.arange(len(a_index)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        b_index = b_at[a_group[a_index]] + within
        pairs = doc[a_index].astype(np.uint64) << np.uint64(32) | (a[a_index] << 16 | b[b_index]).astype(np.uint64)
        pairs.sort()
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        pairs, weights = pairs[first], np.diff(np.r_[first, len(pairs)])
        if wide.any():
            more, much = [pairs], [weights]
            for g in np.flatnonzero(wide).tolist():
                (x, nx), (y, ny) = (np.unique(side[at[g] : at[g] + n[g]], return_counts=True) for side, at, n in ((a, a_at, a_n), (b, b_at, b_n)))
                more.append((np.uint64(int(of[g]) << 32) | (x[:, None] << 16 | y).astype(np.uint64)).ravel())
                much.append((nx[:, None] * ny).ravel())
            pairs, weights = _reduced(np.concatenate(more), np.concatenate(much))
        self.keys, self.weights = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), weights
        self.entries = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(self.ids))


SPILLED = "kind int, radix int, segment long, seq long, frames array<binary>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, entries array<long>"
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64())]
#: Rows of the spilled table: a block's documents with their pairs, and a run of a segment's counts.
DOCUMENTS, RUN = 0, 1


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


def _radix(a: np.ndarray, radixes: int) -> np.ndarray:
    return (mix(a + 1) % np.uint64(radixes)).astype(np.int64)


def _spill(paths: tuple[str, str, str], radixes: int, spill: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in SPILLED.split(", ")]
    blank = (None,) * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, segment, seq, held = coders(*paths), TaskContext.get().partitionId() << 33, 0, []

        def runs() -> Iterator[tuple]:
            """The segment's pairs with their documents counted, side-major within each radix partition."""
            keys, counts = _reduced(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            radix = _radix(keys >> np.uint32(16), radixes)
            order = np.argsort(radix, kind="stable")
            keys, counts, ends = keys[order], counts[order].astype(np.uint32), np.cumsum(np.bincount(radix, minlength=radixes))
            for r, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                frames = []
                while start < end:
                    stop = min(start + most, end)
                    if stop < end:  # a frame ends where an A id does
                        stop = start + int(np.searchsorted(keys[start:end], keys[stop] & np.uint32(0xFFFF0000)))
                        stop = stop if stop > start else start + int(np.searchsorted(keys[start:end], keys[start] | np.uint32(0xFFFF), side="right"))
                    frames.append(_pack(_deltas(keys[start:stop]), counts[start:stop]))
                    start = stop
                if frames:
                    yield (RUN, r, segment, 0, frames, *blank)

        for batch in (part for whole in batches for part in slices(whole, "text", BLOCK)):
            block = Block(use, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            known, counts = np.unique(block.keys, return_counts=True)
            rank = np.searchsorted(known, block.keys).astype(np.int64)
            starts = np.cumsum(block.entries) - block.entries
            steps = np.diff(rank, prepend=0)
            own = starts[block.entries > 0]
            steps[own] = rank[own]
            frames = [_pack(_deltas(known)), _pack(steps.astype(np.uint32), block.weights)]
            yield _batch([(DOCUMENTS, None, segment, seq, frames, block.ids, block.n_a.tolist(), block.n_b.tolist(), block.n_groups.tolist(), block.n_links.tolist(), block.sha, block.entries.tolist())], names, KINDS)
            seq += 1
            held.append((known, counts))
            if sum(len(k) for k, _ in held) > spill:
                yield _batch(list(runs()), names, KINDS)
                held.clear()
                segment += 1
        if held:
            yield _batch(list(runs()), names, KINDS)

    return run


class _Run:
    """A segment's pairs of one radix partition, frame by frame, one A id at a time; and what is to be said of them."""

    def __init__(self, segment: int, frames: list[bytes]) -> None:
        self.segment, self.frames, self.said, self.next = segment, frames, [], 0
        self.at = self.end = 0
        self.keys = np.zeros(0, np.uint32)
        self.back: list[np.ndarray] = []

    def head(self) -> int | None:
        """The next A id; the frame behind it is closed when it is done."""
        if self.at == len(self.keys):
            if self.back:
                self.said.append(_pack(np.concatenate(self.back)))
                self.back = []
            if self.next == len(self.frames):
                return None
            steps, self.counts = _unpack(self.frames[self.next], "<u4", "<u4")
            self.keys, self.at, self.next = np.cumsum(steps, dtype=np.uint32), 0, self.next + 1
            self.sides = np.r_[np.flatnonzero(np.diff(self.keys >> np.uint32(16))) + 1, len(self.keys)].tolist()
            self.sides.reverse()
        self.end = self.sides.pop()
        return int(self.keys[self.at] >> np.uint32(16))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        got = self.keys[self.at : self.end], self.counts[self.at : self.end].astype(np.int64)
        self.at = self.end
        return got


def _merged(runs: list[_Run]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of each A id in order, by a heap over the runs' next A ids; the highest counts are negative.

    Once an A id's runs have been merged its maximum is known, so what its pairs count goes back to the runs at once.
    """
    heap = [(a, k) for k, r in enumerate(runs) if (a := r.head()) is not None]
    heapq.heapify(heap)
    while heap:
        a, own, parts = heap[0][0], [], []
        while heap and heap[0][0] == a:
            k = heapq.heappop(heap)[1]
            own.append(runs[k])
            parts.append(runs[k].take())
        keys, counts = parts[0] if len(parts) == 1 else _reduced(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        said = np.where(counts == counts.max(), -counts, counts)
        for r, (k, _) in zip(own, parts, strict=True):
            r.back.append(said[np.searchsorted(keys, k)])
            if (following := r.head()) is not None:
                heapq.heappush(heap, (following, r.place))
        yield keys, said


ANSWERS, ANSWER_KINDS = "segment long, frames array<binary>, said array<binary>", [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
PAIRS, PAIR_KINDS = "a_id int, b_id int, documents long, best boolean", [pa.int32(), pa.int32(), pa.int64(), pa.bool_()]


def _count(pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the runs of each radix partition, sorted by it: the counted pairs, or the counts for each run."""

    def merge(runs: list[_Run]) -> Iterator[pa.RecordBatch]:
        for k, r in enumerate(runs):
            r.place = k
        for keys, said in _merged(runs):
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(np.abs(said)), pa.array(said < 0)], names=["a_id", "b_id", "documents", "best"])
        if not pairs:
            for at in range(0, len(runs), 64):
                yield _batch([(r.segment, r.frames, r.said) for r in runs[at : at + 64]], ["segment", "frames", "said"], ANSWER_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix, runs = None, []
        for batch in batches:
            for r, segment, frames in zip(*(batch.column(c).to_pylist() for c in ("radix", "segment", "frames")), strict=True):
                if r != radix and runs:
                    yield from merge(runs)
                    runs = []
                radix = r
                runs.append(_Run(segment, frames))
        if runs:
            yield from merge(runs)

    return run


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by segment, its counts before its documents: sum up what each document's links count."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    segment, held, keys, said = None, [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["segment"] != segment:
                segment, held = row["segment"], []
            if row["kind"] == RUN:
                held += [(np.cumsum(_unpack(f, "<u4", "<u4")[0], dtype=np.uint32), _unpack(s, "<i8")[0]) for f, s in zip(row["frames"], row["said"], strict=True)]
                continue
            if held:
                keys, said = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, said, held = keys[order], said[order], []
            entries = np.array(row["entries"], np.int64)
            counts = said[np.searchsorted(keys, np.cumsum(_unpack(row["frames"][0], "<u4")[0], dtype=np.uint32))]
            steps, weights = _unpack(row["frames"][1], "<u4", "<i8")
            bounds = np.r_[0, np.cumsum(entries)]
            offset = np.r_[0, np.cumsum(steps.astype(np.int64))]
            of_link = counts[offset[1:] - np.repeat(offset[bounds[:-1]], entries)]
            best, total = (np.r_[0, np.cumsum(x)] for x in (weights * (of_link < 0), weights * np.abs(of_link)))
            columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], best[bounds[1:]] - best[bounds[:-1]], total[bounds[1:]] - total[bounds[:-1]], row["sha"]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


def spilled(docs: DataFrame, *, ranks: str | None = None, vocabulary: str | None = None, pieces: str | None = None, radixes: int = RADIXES, spill: int = SPILL, frame: int = FRAME) -> DataFrame:
    """The table of blocks and runs of docs (doc_id, text), written once in the shared folder; see aligned."""
    paths = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(rows.mapInArrow(_spill(paths, radixes, spill, frame), SPILLED), "alignment")


def _counted(spills: DataFrame, pairs: bool) -> DataFrame:
    runs = spills.where(F.col("kind") == RUN).select("radix", "segment", "frames")
    return runs.repartition("radix").sortWithinPartitions("radix", "segment").mapInArrow(_count(pairs), PAIRS if pairs else ANSWERS)


def aligned(spills: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document of what `spilled` returned.

    Blocks of documents are tokenized by both vocabularies; places where tokens of both end cut them into groups, and
    every pair of a group is a link. A task counts the documents of each pair over its blocks and spills the counts,
    dealt by a hash of the A id into radix partitions and sorted by A and B id, as runs of zstd frames; the blocks keep
    their documents' pairs beside them. A radix partition's runs meet in one task, where a heap takes the least A id of
    all runs, adds its pairs up, and says at once of each run's pairs what they count and whether that is the A id's
    highest. These counts go back to the run's segment, where the blocks' links are summed. A pair that stands in
    every document is one entry a segment, so no key is hot.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have zeros and an empty digest.
    Special tokens' strings are plain text. Repeated rows count as documents of their own; a null doc_id stays; other
    columns are ignored; no rows give no rows.
    """
    answers = _counted(spills, False).withColumns({"kind": F.lit(RUN), "seq": F.lit(-1).cast("long")})
    events = spills.where(F.col("kind") == DOCUMENTS).drop("radix").unionByName(answers, allowMissingColumns=True)
    return events.repartition("segment").sortWithinPartitions("segment", "seq").mapInArrow(_finish, ALIGNED)


def pair_counts(spills: DataFrame) -> DataFrame:
    """a_id, b_id, documents, best: how many documents link each pair, and whether no pair of the A id is in more."""
    return _counted(spills, True)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spilled(table(spark, sf_dir, "documents")))
