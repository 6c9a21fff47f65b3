"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Sets too small for bins and bands to be sure get exact bucket keys instead: the rarest shingles of a set, as many as
any similar set must share one of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.llm.common import checkpointed, components, mix, slices, table
from dossier.llm.shingles import shingles, words

#: Bins of the permutation, and rows of a band: 32 bands of 4 miss a pair of similarity 0.75 once in 200,000.
BINS, ROWS = 128, 4
#: Sets of up to so many shingles have exact keys, no more than there are bands.
EXACT = 124
#: A candidate whose signatures agree in fewer bins than so many deviations below the similarity is no link.
DEVIATIONS = 5
#: Shingles of small sets for each counter of the table that tells the rare ones, and the most counters (a byte each).
EACH, COUNTERS = 8, 1 << 22
#: Members of a bucket that are compared with each other at once where stars leave more than one component.
BLOCK = 4096
#: Bytes of such blocks that one call handles, about.
UNIT = 8 << 20


def _orders() -> np.ndarray:
    """For each bin, the order in which an empty one asks the others for their value."""
    return np.argsort(mix((np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)) * np.uint64(0x9FB21C651E98DF25)).reshape(BINS, BINS), axis=1)


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The least hash of each bin (top bits) of sorted distinct hashes; an empty bin borrows from its first filled one."""
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]] = hashes[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        out[empty] = out[orders[empty, np.argmax(filled[orders[empty]], axis=1)]]
    return out


def reach(percent: int) -> int:
    """The largest set that can be similar to one of EXACT shingles."""
    return EXACT * 100 // percent


def screen(n: np.ndarray, percent: int) -> np.ndarray:
    """The least share of equal bins of a pair whose smaller set has n shingles: DEVIATIONS below the similarity, by the bins filled."""
    j = percent / 100
    return j - DEVIATIONS * np.sqrt(j * (1 - j) / (BINS * (1 - np.exp(-np.maximum(n, 1) / BINS))))


def _features(size: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("small", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, salt, most = _orders(), mix(np.arange(1, BINS // ROWS + 1, dtype=np.uint64)), reach(percent)
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, at = words(batch.column("text"))
                classes, counts, sigs, small = [], [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    got = shingles(hashes[a:b], size)
                    classes.append(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    counts.append(len(got))
                    sigs.append(signature(got, orders) if len(got) > EXACT else None)
                    small.append(got.tobytes() if 0 < len(got) <= most else None)
                full = [s for s in sigs if s is not None]
                keys = iter(())
                if full:
                    m = np.stack(full).reshape(len(full), -1, ROWS)
                    key = np.broadcast_to(salt, m.shape[:2]).copy()
                    for k in range(ROWS):
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + m[:, :, k])
                    keys = iter(key.view(np.int64))
                bands = pa.array([None if s is None else next(keys) for s in sigs], pa.list_(pa.int64()))
                bins = pa.array([None if s is None else mix(s).astype(np.uint16).tobytes() for s in sigs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), bands, bins, pa.array(small, pa.binary())], schema=schema)

    return run


def _rarity(small: DataFrame) -> np.ndarray:
    """How often shingles occur in the small sets, as steps of a logarithm in a table of counters by hash, of bounded size.

    Any order of shingles gives exact keys; the rarer first, the fewer sets share a key.
    """
    total = small.agg(F.sum("n")).first()[0] or 0
    slots = 1 << min(COUNTERS.bit_length() - 1, max(12, int(total // EACH).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column("small").to_pylist()), np.uint64)
            slot, n = np.unique(got & np.uint64(slots - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    def pack(rows: pa.Table) -> pa.Table:
        out, slot = np.zeros(4096, np.uint8), np.asarray(rows.column("slot"))
        out[slot % 4096] = np.minimum(255, 8 * np.log2(1 + np.asarray(rows.column("n"))))
        return pa.table({"chunk": pa.array([slot[0] // 4096], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})

    counts = small.select("small").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    levels = np.zeros(slots, np.uint8)
    for row in counts.groupBy(F.expr("slot div 4096")).applyInArrow(pack, "chunk int, levels binary").collect():
        levels[row["chunk"] * 4096 : (row["chunk"] + 1) * 4096] = np.frombuffer(row["levels"], np.uint8)
    return levels


def _prefixes(levels, percent: int):
    """Exact keys of small sets: the first n - ceil(percent * n) + 1 shingles, rare ones first; two similar sets share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for raw in batch.column("small"):
                got = np.frombuffer(raw.as_buffer(), np.uint64)
                n = len(got)
                order = np.lexsort((got, levels.value[(got & np.uint64(len(levels.value) - 1)).astype(np.int64)]))
                keys.append(mix(got[order[: n - -(-percent * n // 100) + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, at = words(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([shingles(hashes[a:b], size).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets reach the similarity; sets are made only of documents in a pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, shingles binary")
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def _screened(df: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose set sizes can reach the similarity and, unless one is small, whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"))
            keep, large = n <= EXACT, np.flatnonzero(n > EXACT)
            if len(large):
                p, q = (np.frombuffer(b"".join(batch.column(c).take(pa.array(large)).to_pylist()), np.uint16).reshape(-1, BINS) for c in ("sig_a", "sig_b"))
                keep[large] = (p == q).mean(axis=1) >= screen(n[large], percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    least = F.least("n_a", "n_b")
    sized = df.where(100 * least >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", least.alias("n"), "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _can(n: np.ndarray, pos: np.ndarray, size, place, percent: int) -> np.ndarray:
    """Whether sets of n shingles can be similar to one of `size`, if the bucket's shingle is the first that they share in order of rarity.

    Then what they share stands at or after its places in both, so it is no more than the lesser rest. A similar pair
    meets in the bucket of the first shingle that it shares, so it passes there. Bands have place 0.
    """
    return (100 + percent) * np.minimum(n - pos, size - place) >= percent * (n + size)


def _cells(cells: pa.Table) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of each cell of the grids, ordered by part, and the row from which all may stand on the other side.

    In a cell (i, i) each row meets all after it; in a cell (i, j) the rows of part i meet those of part j.
    """
    key, i, j, part = (np.asarray(cells.column(x)) for x in ("key", "i", "j", "part"))
    order = np.lexsort((part, j, i, key))
    edge = np.flatnonzero(np.r_[True, (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), True])
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        rows = order[lo:hi]
        yield rows, 0 if i[rows[0]] == j[rows[0]] else int(np.searchsorted(part[rows], i[rows[0]], side="right"))


def _met(cells: pa.Table, percent: int):
    """For each row of a cell that may be linked across components: the row, and the rows that pass size and signature."""
    n, component, pos = (np.asarray(cells.column(x)).copy() for x in ("n", "component", "pos"))
    sigs = np.frombuffer(b"".join(x or bytes(2 * BINS) for x in cells.column("sig").to_pylist()), np.uint16).reshape(-1, BINS)
    for rows, turn in _cells(cells):
        for k in range(turn or len(rows)):
            r, others = rows[k], rows[turn or k + 1 :]
            others = others[(component[others] != component[r]) & _can(n[others], pos[others], n[r], pos[r], percent)]
            if len(others):
                least = np.minimum(n[others], n[r])
                others = others[(least <= EXACT) | (np.count_nonzero(sigs[others] == sigs[r], axis=1) >= BINS * screen(least, percent))]
                if len(others):
                    yield rows, r, others, component


def _likely(percent: int):
    """The rows of cells that meet a likely partner of another component there; never the pairs."""

    def run(cells: pa.Table) -> pa.Table:
        keep = np.zeros(len(cells), bool)
        for _, r, others, _ in _met(cells, percent):
            keep[r] = keep[others] = True
        return cells.filter(pa.array(keep))

    return run


def _across(percent: int):
    """Links between components, confirmed on full sets; a link joins its components in the cell, so few are given."""

    def run(cells: pa.Table) -> pa.Table:
        ids = np.asarray(cells.column("id"))
        sets = [np.frombuffer(x, np.uint64) for x in cells.column("shingles").to_pylist()]
        a, b = [], []
        for rows, r, others, component in _met(cells, percent):
            flat = np.concatenate([sets[o] for o in others])
            sizes = np.array([len(sets[o]) for o in others])
            at = np.minimum(np.searchsorted(sets[r], flat), len(sets[r]) - 1)
            both = np.add.reduceat(sets[r][at] == flat, np.r_[0, np.cumsum(sizes)[:-1]])
            for o in others[100 * both >= percent * (len(sets[r]) + sizes - both)]:
                if component[o] != component[r]:
                    a.append(min(ids[r], ids[o]))
                    b.append(max(ids[r], ids[o]))
                    component[rows[component[rows] == component[o]]] = component[r]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(member: DataFrame) -> DataFrame:
    """key, doc_id, component and m (rows of the key), with the row's part of about BLOCK rows at most, of `parts`.

    A component of half a block or more has parts of its own, `own` of them from `first` on; the rest of a bucket
    share parts, where own is 0. Rows are dealt by their ids, so no component swells a part.
    """
    lone = lambda n: F.lit(n).cast("int")
    narrow = member.where(F.col("m") <= BLOCK).select("key", "doc_id", "component", lone(0).alias("part"), lone(0).alias("first"), lone(0).alias("own"), lone(1).alias("parts"))
    wide = member.where(F.col("m") > BLOCK)
    runs = F.ceil(F.col("c") / BLOCK).cast("int")
    large = wide.groupBy("key", "component").agg(F.count("*").alias("c")).where(F.col("c") >= max(2, BLOCK // 2)).withColumn("own", runs)
    large = checkpointed(large.withColumn("first", (F.sum("own").over(W.partitionBy("key").orderBy("component")) - F.col("own")).cast("int")))
    taken = large.groupBy("key").agg(F.sum("own").cast("int").alias("taken"), F.sum("c").alias("in_large"))
    # Both sides that are broadcast have less than one row for 2,000 of the buckets' members; a crowd's rows stay where they lie.
    rows = wide.join(F.broadcast(large.select("key", "component", "first", "own")), ["key", "component"], "left").join(F.broadcast(taken), "key", "left")
    rows = rows.withColumn("taken", F.coalesce("taken", lone(0))).withColumn("shared", F.ceil((F.col("m") - F.coalesce("in_large", F.lit(0))) / BLOCK).cast("int"))
    rows = rows.select("key", "doc_id", "component", F.coalesce("first", "taken").alias("first"), F.coalesce("own", lone(0)).alias("own"), "shared", (F.col("taken") + F.col("shared")).alias("parts"))
    part = F.col("first") + F.pmod(F.xxhash64("doc_id"), F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("shared"))).cast("int")
    return narrow.unionByName(rows.withColumn("part", part).drop("shared"))


def _grid(dealt: DataFrame) -> DataFrame:
    """Each row once for every part that it meets: all parts, but those of its own component alone, which hold no link that is missing."""
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    first, own = F.col("first"), F.col("own")
    met = F.when(own > 0, F.filter(others, lambda o: (o < first) | (o >= first + own))).otherwise(others)
    return dealt.select("*", F.explode(met).alias("o")).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked when 100 * intersection >= percent * union of their sets of `size`-word shingles.
    Equal word sequences form a class first, and only its smallest doc_id goes on. Large sets are dealt to the buckets of
    their bands, sets of up to EXACT shingles (and those that can be similar to one) to those of their rarest shingles,
    so no link of theirs is missed; a link of larger sets is missed by all bands once in 200,000. Each bucket links its
    members to two hubs (stars), so a bucket of m yields less than 2 m candidates; candidates are confirmed on full
    sets, large ones where their signatures let them. Where a star leaves several components in a bucket, members of
    different ones are compared in blocks, by signature and then on full sets, so no link between components is lost;
    blocks are bounded on both sides, and two blocks of one same component never meet.

    Nulls and texts without words have n_shingles 0 and stay alone; a null doc_id gets no component and is not
    kept; repeated rows get equal results; rows that share a doc_id but not a text count as one document;
    other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = checkpointed(docs.mapInArrow(_features(size, percent), "doc_id long, class binary, n long, bands array<long>, sig binary, small binary"))
    first = seen.where("class is not null and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "n", "bands", "sig", "small")).alias("r"))
    reps = checkpointed(first.select("class", "r.*"))
    small = reps.where("small is not null")
    levels = docs.sparkSession.sparkContext.broadcast(_rarity(small))
    exact = small.select("doc_id", "small").mapInArrow(_prefixes(levels, percent), "doc_id long, keys array<long>")

    # Stars: the buckets with company, two hubs of each (the smallest and the largest member), and everyone
    # else's candidate edges to them.
    rows = reps.select("doc_id", F.explode("bands").alias("key")).unionByName(exact.select("doc_id", F.explode("keys").alias("key")))
    hubs = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("second")).where("hub <> second")
    company = checkpointed(rows.join(hubs, "key").select("key", "hub", "second", "doc_id"))
    side = {x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"}
    edge = F.explode(F.array("hub", "second")).alias("h")
    stars = company.select("doc_id", edge).where("h <> doc_id").select(F.least("h", "doc_id").alias("a"), F.greatest("h", "doc_id").alias("b")).distinct()
    likely = checkpointed(_screened(stars.join(side["b"], "b").join(side["a"], "a"), percent))
    links = checkpointed(_linked(docs, likely, size, percent))
    found = components(links)

    # What stars leave: buckets that still hold several components.
    member = company.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y and m > 2").select("key", "m")
    open_rows = _dealt(checkpointed(member.join(open_keys, "key"))).join(reps.select("doc_id", "n", "sig"), "doc_id").join(exact, "doc_id", "left")
    dealt = checkpointed(open_rows.withColumn("pos", F.greatest(F.coalesce(F.array_position("keys", F.col("key")), F.lit(0)) - 1, F.lit(0)).cast("int")).drop("keys"))
    cells = _grid(dealt).select("key", "i", "j", "part", F.col("doc_id").alias("id"), "pos", "n", "component", "sig")
    unit = lambda bytes_: F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + int(bytes_ or 0) // UNIT)).alias("unit")
    kind = "key long, i int, j int, part int, id long, pos int, n long, component long, sig binary"
    rows = cells.select("*", unit(dealt.agg(F.sum((F.col("parts") - F.col("own")) * 300)).first()[0]))
    likely = checkpointed(rows.groupBy("unit").applyInArrow(lambda t: _likely(percent)(t.drop_columns("unit")), kind))
    sets = docs.join(likely.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, shingles binary")
    full = likely.join(sets.withColumnRenamed("doc_id", "id"), "id").select(unit(likely.agg(F.sum(300 + 8 * F.col("n"))).first()[0]), *likely.columns, "shingles")
    more = full.groupBy("unit").applyInArrow(_across(percent), "a long, b long")
    # The links that were missing join components, so these alone are joined again.
    label = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    again = components(joined)
    renamed = found.join(again.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    found = renamed.unionByName(again.join(found, "id", "left_anti").select("id", "component"))

    named = reps.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("class", F.coalesce("component", "doc_id").alias("component"))
    got = seen.select("doc_id", "class", "n").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, o.b FROM r JOIN o ON r.reached = o.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
