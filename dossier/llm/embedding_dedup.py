"""Near-duplicate vectors by an inverted multi-index: two codebooks on vector halves, and their product grid of cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import checkpointed, components, table

#: Vectors that the codebooks are fitted on and the visits are measured on: the smallest by a hash of their class.
SAMPLE, PROBES = 20_000, 1000
#: Vectors of an average cell, and the most centroids of a codebook.
OCCUPANCY, CENTROIDS = 4, 4096
#: Share of neighbours at the very threshold whose cell the visits must reach, seen from one of the two sides.
RECALL = 0.97
#: Visits beyond which cells are walked to one by one.
WALK = 256
#: Vectors of a cell that are compared at once, and rows of the cells that one task handles.
BLOCK, UNIT = 1024, 20_000
ITERATIONS = 8


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book**2).sum(axis=1)[None, :]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ITERATIONS):
        of = np.concatenate([_nearest(x[a : a + 4096], book).argmin(axis=1) for a in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, of, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


@dataclass
class Index:
    """Codebooks of both halves, and how many cells a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of rows' halves to the centroids of either book."""
        half = self.first.shape[1]
        return _nearest(unit[:, :half], self.first), _nearest(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The nearest cell of each row."""
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def places(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells come before the given one of each row in its multi-sequence order, counted without walking to it."""
        out = np.empty(len(unit), np.int64)
        for r, (a, b, cell) in enumerate(zip(*self.distances(unit), cells.tolist(), strict=True)):
            i, j = divmod(cell, len(self.second))
            total = a[i] + b[j]
            out[r] = np.searchsorted(np.sort(b), total - a - 1e-12 * (1 + abs(total)), side="left").sum()
        return out

    def sequence(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """The nearest `visits` cells of each row, nearest first: the order of sums of two sorted distance lists."""
        if visits > WALK:
            return np.array([list(islice(_traversal(a, b), visits)) for a, b in zip(*self.distances(unit), strict=True)], np.int64)
        # The cell at ranks (i, j) of the two lists comes after the (i + 1) * (j + 1) - 1 cells at smaller ranks, so few pairs matter.
        d = self.distances(unit)
        deep = [min(visits, x.shape[1]) for x in d]
        rank = [np.argsort(x, axis=1, kind="stable")[:, :n] for x, n in zip(d, deep, strict=True)]
        near = [np.take_along_axis(x, r, 1) for x, r in zip(d, rank, strict=True)]
        i, j = np.array([(i, j) for i in range(deep[0]) for j in range(min(deep[1], visits // (i + 1)))]).T
        total = near[0][:, i] + near[1][:, j]
        top = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return (rank[0][:, i].astype(np.int64) * len(self.second) + rank[1][:, j])[np.arange(len(unit))[:, None], top]


def _traversal(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """Cells by the sum of their two distances, as a walk over a heap: a cell is pushed once both cells before it are out."""
    order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    p, q = a[order[0]].tolist(), b[order[1]].tolist()
    out = [0] * len(p)  # how many cells of each row of the grid are out
    heap = [(p[0] + q[0], 0, 0)]
    while heap:
        _, i, j = heappop(heap)
        yield int(order[0][i]) * len(q) + int(order[1][j])
        out[i] = j + 1
        if i + 1 < len(p) and out[i + 1] == j:
            heappush(heap, (p[i + 1] + q[j], i + 1, j))
        if j + 1 < len(q) and (i == 0 or out[i - 1] > j + 1):
            heappush(heap, (p[i] + q[j + 1], i, j + 1))


def _unit(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, n: int, cosine: float) -> Index:
    """Codebooks from unit rows for an index of n vectors, and the visits that reach RECALL.

    For the visits, each probe gets a made neighbour at exactly `cosine` in a random direction, the hardest that
    counts. Either of the two may reach the other's cell.
    """
    rng = np.random.default_rng(7)
    half = (sample.shape[1] + 1) // 2
    k = int(min(CENTROIDS, len(sample), max(1, round((n / OCCUPANCY) ** 0.5))))
    index = Index(_codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng) if sample.shape[1] > 1 else np.zeros((1, 0)))
    p = sample[:PROBES]
    away = rng.normal(size=p.shape)
    away -= (away * p).sum(axis=1)[:, None] * p
    away /= np.maximum(np.sqrt((away**2).sum(axis=1))[:, None], 1e-300)
    q = cosine * p + (1 - cosine**2) ** 0.5 * away
    before = np.minimum(index.places(p, index.cells(q)), index.places(q, index.cells(p)))
    index.visits = int(np.sort(before)[min(len(before) - 1, int(np.ceil(RECALL * len(before))) - 1)]) + 1
    return index


def _clean(kind: type):
    """Vectors as bytes; those that are null, zero, without id or hold null or non-finite components as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, kind)
                out.append(x.tobytes() if i is not None and x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return run


def _rounded(unit: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Unit rows in a byte for each component, the scale of each row, and the length of what rounding took."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return [x.tobytes() for x in q], scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-6


def _sift(cosine: float):
    """The rows of a group of cells that may have a partner in a visited cell, by rounded vectors: cell, id and side, never the pairs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["size", "group", "i", "j"], sort=False):
            home, guest = part[part["home"]], part[~part["home"]]
            if not len(home) or not len(guest):
                continue
            vectors = [np.frombuffer(b"".join(x["q"]), np.int8).reshape(len(x), -1) * x["scale"].to_numpy(np.float32)[:, None] for x in (guest, home)]
            lost = [x["lost"].to_numpy() for x in (guest, home)]
            # |xy - pq| <= |x - p| |y| + |p| |y - q|, and |p| <= 1 + |x - p|.
            slack = lost[0][:, None] + (1 + lost[0][:, None]) * lost[1][None, :] + 1e-5
            cells, of = np.unique(home["own"].to_numpy(), return_inverse=True)
            lists = guest["cells"].to_numpy()
            flat, who = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            at = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
            visited = np.zeros((len(guest), len(cells)), bool)
            visited[who, at] = cells[at] == flat
            near = (vectors[0] @ vectors[1].T >= cosine - slack) & visited[:, of] & (guest["id"].to_numpy()[:, None] != home["id"].to_numpy()[None, :])
            g, h = np.nonzero(near)
            if len(g):
                pairs = np.unique(np.stack([np.r_[home["own"].to_numpy()[h], home["own"].to_numpy()[h]], np.r_[guest["id"].to_numpy()[g], home["id"].to_numpy()[h]], np.r_[np.zeros(len(g), np.int64), np.ones(len(h), np.int64)]]), axis=1)
                out.append(pd.DataFrame({"size": np.full(pairs.shape[1], part["size"].iloc[0], np.int32), "cell": pairs[0], "id": pairs[1], "home": pairs[2] == 1}))
        return pd.concat(out) if out else pd.DataFrame({"size": pd.Series(dtype="int32"), "cell": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "home": pd.Series(dtype="bool")})

    return run


def _in_blocks(homes: DataFrame, guests: DataFrame, keys: list[str]) -> DataFrame:
    """Homes and guests of the same keys, where a side has over BLOCK rows in a grid of blocks: columns i, j and unit, the task's share."""
    held, met = homes.groupBy(*keys).agg(F.count("*").alias("h")), guests.groupBy(*keys).agg(F.count("*").alias("g"))
    parts = checkpointed(held.join(met, keys).select(*keys, F.ceil(F.col("h") / BLOCK).cast("int").alias("hp"), F.ceil(F.col("g") / BLOCK).cast("int").alias("gp"), (F.col("h") + F.col("g")).alias("rows")))
    total = parts.agg(F.sum(F.col("rows") * F.greatest("hp", "gp"))).first()[0] or 0
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = homes.join(parts, keys).withColumn("i", block("hp")).withColumn("j", over("gp"))
    dealt = dealt.unionByName(guests.join(parts, keys).withColumn("j", block("gp")).withColumn("i", over("hp")), allowMissingColumns=True)
    return dealt.drop("hp", "gp", "rows").withColumn("unit", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(1 + total // UNIT)))


def _compare(kind: type, cosine: float):
    """Links inside the grid parts of cells: each vector's weight of links, and its smallest companion's id there."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out_id, out_n, out_low = [], [], []
        for _, part in rows.groupby(["size", "cell", "i", "j"], sort=False):
            home, guest = part[part["home"]], part[~part["home"]]
            if not len(home) or not len(guest):
                continue
            close = _unit(list(guest["v"]), kind) @ _unit(list(home["v"]), kind).T >= cosine
            g, h = np.nonzero(close & (guest["id"].to_numpy()[:, None] != home["id"].to_numpy()[None, :]))
            if not len(g):
                continue
            gi, hi = guest["id"].to_numpy()[g], home["id"].to_numpy()[h]
            # A pair that both sides' visits find counts once, from the side of its smaller id.
            lists = np.stack(home["visits"].to_numpy())[h]
            twice = (lists == guest["own"].to_numpy()[g][:, None]).any(axis=1)
            once = ~twice | (gi < hi)
            g, h, gi, hi = g[once], h[once], gi[once], hi[once]
            ids = np.union1d(gi, hi)
            a, b = np.searchsorted(ids, gi), np.searchsorted(ids, hi)
            n = np.bincount(a, home["copies"].to_numpy()[h], len(ids)) + np.bincount(b, guest["copies"].to_numpy()[g], len(ids))
            low = np.arange(len(ids))
            while True:
                new = low.copy()
                np.minimum.at(new, a, low[b])
                np.minimum.at(new, b, low[a])
                new = new[new]
                if (new == low).all():
                    break
                low = new
            out_id.append(ids)
            out_n.append(n.astype(np.int64))
            out_low.append(ids[low])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"id": cat(out_id), "n": cat(out_n), "low": cat(out_low)})

    return run


def near_vectors(vectors: DataFrame, *, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked where their cosine in double precision reaches `cosine`.

    Equal vectors form a class first. Each class lies in the cell of its nearest pair of centroids and visits the
    nearest cells in multi-sequence order, as many as reach the target recall for neighbours at the threshold. Vectors
    rounded to bytes go to the visited cells first, once for each group of cells, and only those that can have a partner
    there by the bound on what rounding takes are verified in full. Large cells are compared in a grid of blocks. A
    block reports sums and its own components, never pairs, and the components are joined at the end.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths with each other. Rows without vec_id link with nothing, have no component and are not kept;
    repeated rows link with each other; rows that share a vec_id but not a vector share a component; other columns
    are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    kind = np.float32 if "array<float>" in dict(vectors.dtypes)["embedding"] else np.float64
    rows = checkpointed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_clean(kind), "vec_id long, v binary"))
    classes = checkpointed(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("size", F.length("v")))
    found = None
    for size, n in [(r[0], r[1]) for r in classes.groupBy("size").count().orderBy("size").collect()]:
        own = classes.where(F.col("size") == size)
        share = min(1.0, 4 * SAMPLE / n)
        picked = own.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()
        index = spark.sparkContext.broadcast(fit(_unit(list(picked["v"]), kind), n, cosine))

        # Groups hold about BLOCK homes: the cells of a first centroid, cut by their second ones where they are many.
        k1, k2 = len(index.value.first), len(index.value.second)
        cuts = min(k2, 1 + n // (k1 * BLOCK))

        def place(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 512):
                    batch = whole.slice(a, 512)
                    unit = _unit(batch.column("v").to_pylist(), kind)
                    q, scale, lost = _rounded(unit)
                    cells = index.value.sequence(unit, index.value.visits)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64())), pa.array(q, pa.binary()), pa.array(scale), pa.array(lost)], names=[*batch.schema.names, "visits", "q", "scale", "lost"])

        placed = own.select("id", "copies", "size", "v").mapInArrow(place, "id long, copies long, size int, v binary, visits array<long>, q binary, scale double, lost double")
        placed = placed.withColumns({"k2": F.lit(k2), "cuts": F.lit(cuts)})
        found = placed if found is None else found.unionByName(placed)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    placed = checkpointed(found.withColumn("own", F.col("visits")[0]))
    group = lambda cell: F.floor(cell / F.col("k2")) * F.col("cuts") + F.floor((cell % F.col("k2")) * F.col("cuts") / F.col("k2"))
    light = ["id", "size", "q", "scale", "lost", "own"]
    homes = placed.select(*light, F.lit(True).alias("home"), group(F.col("own")).alias("group"))
    guests = placed.select(*light, "visits", "k2", "cuts", F.lit(False).alias("home"), F.explode(F.array_distinct(F.transform("visits", group))).alias("group"))
    guests = guests.withColumn("cells", F.filter("visits", lambda c: group(c) == F.col("group"))).drop("visits", "k2", "cuts")
    sifted = _in_blocks(homes, guests, ["size", "group"])
    survivors = checkpointed(sifted.groupBy("unit").applyInPandas(_sift(cosine), "size int, cell long, id long, home boolean").distinct())

    full = placed.select("id", "copies", "size", "v", "own", "visits")
    both = survivors.join(full, ["id", "size"])
    homes, guests = both.where("home"), both.where("not home").withColumn("visits", F.lit(None).cast("array<long>"))
    dealt = _in_blocks(homes, guests, ["size", "cell"])
    links = checkpointed(dealt.select("unit", "size", "cell", "i", "j", "id", "copies", "own", "visits", "home", "v").groupBy("unit").applyInPandas(_compare(kind, cosine), "id long, n long, low long"))
    found = components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    others = links.groupBy("id").agg(F.sum("n").alias("others"))
    per_class = classes.join(others, "id", "left").join(found, "id", "left")
    per_class = per_class.select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    got = rows.join(per_class, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
