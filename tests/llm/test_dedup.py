"""Near-duplicates of vectors and texts against brute force, and their edges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import embedding_dedup, minhash
from dossier.llm.common import components
from dossier.llm.shingles import shingles, words

import pyarrow as pa


def brute_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return label


def test_components_of_a_path_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectorised_words_are_words():
    texts = ["One  two\tTHREE", None, "", "  ", "é ÉÉ one", "two three", "x" * 3000]
    hashes, at = words(pa.array(texts))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    assert len({(w, h) for w, h in zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))
    sliced, at = words(pa.array(texts).slice(4, 2))
    assert sliced.tolist() == hashes[np.cumsum([0, *map(len, expected)])[4] :][:5].tolist()


def near_texts(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (3, 5, 8, 30, 60, 200):
        for _ in range(4):
            base = list(rng.choice(vocabulary, size))
            for edits in (0, 0, 1, 2, 4, 6):
                copy = list(base)
                for k in rng.integers(0, size, min(edits, size)):
                    copy[k] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
    # A chain whose ends are far apart, and a crowd around one text with few links among its members.
    chain = list(rng.choice(vocabulary, 120))
    for k in range(12):
        texts.append(" ".join(chain))
        chain[k * 9 : k * 9 + 3] = rng.choice(vocabulary, 3)
    core = list(rng.choice(vocabulary, 100))
    for _ in range(40):
        copy = list(core)
        for k in rng.choice(100, 3, replace=False):
            copy[k] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    return texts + ["", "   ", "a b", "A  B"]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    label = brute_components(len(texts), linked)
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(1000, None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))} | {1000: (0, 1000, True)}


def test_near_duplicate_edges(spark):
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, long), (1, long), (2, long + " more"), (3, "same"), (3, "other"), (None, "same"), (None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 59996, 1, True), (1, 59996, 1, True), (2, 59997, 1, False), (3, 1, 3, True), (3, 1, 3, True), (None, 1, None, False), (None, 0, None, False)], key=str)


def planted_vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = []
    for k in range(60):
        for noise in (0.0, 0.01, 0.02, 0.03, 0.039, 0.05):
            v = base[k] + rng.normal(size=64) * noise
            near.append(v * rng.uniform(0.5, 2))
    return np.concatenate([base, near]).astype(np.float32)


def test_vectors_equal_brute_force_within_the_recall(spark):
    vectors = planted_vectors()
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, id string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(frame.repartition(3)).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (n <= close.sum(axis=1)).all() and n.sum() >= 0.95 * close.sum() > 1000
    label = brute_components(len(vectors), list(zip(*np.nonzero(close), strict=True)))
    same = [got[i]["component_id"] == label[i] for i in range(len(vectors))]
    assert np.mean(same) > 0.95 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(1)
    vectors = np.concatenate([np.r_[[1.0], np.zeros(63)] + rng.normal(size=(50, 64)) * 0.001, rng.normal(size=(30, 64))]).astype(np.float32)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()}
    assert [got[i]["n_links"] for i in range(50)] == [49] * 50 and {got[i]["component_id"] for i in range(50)} == {0}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_edges(spark, kind):
    v = [0.6, 0.8, 0.0]
    rows = [(4, v), (4, v), (2, [1.2, 1.6, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0]), (10, []), (11, [0.6, 0.8]), (None, v)]
    got = sorted(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()), key=str)
    alone = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (None, 0, None, False), *alone], key=str)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], f"vec_id long, embedding array<{kind}>")).count() == 0


@pytest.mark.parametrize("crowds", [[(0, 400), (1, 1)], [(0, 100), (1, 150), *((k, 1) for k in range(2, 60)), (60, 7)]])
def test_blocks_of_a_bucket_are_bounded_and_meet_across_components_only_once(spark, monkeypatch, crowds):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    component = [c for c, n in crowds for _ in range(n)]
    member = spark.createDataFrame([(5, k, c, len(component)) for k, c in enumerate(component)], "key long, doc_id long, component long, m long")
    cells, copies = {}, 0
    for r in minhash._grid(minhash._dealt(member)).collect():
        cells.setdefault((r["i"], r["j"]), []).append((r["part"], r["doc_id"]))
        copies += 1
    assert max(map(len, cells.values())) <= 5 * minhash.BLOCK
    met = {}
    for (i, j), rows in cells.items():
        for p, a in rows:
            for q, b in rows:
                if a < b and component[a] != component[b] and (i == j or p != q):
                    met[a, b] = met.get((a, b), 0) + 1
    n = len(component)
    assert set(met.values()) == {1} and set(met) == {(a, b) for a in range(n) for b in range(a + 1, n) if component[a] != component[b]}
    if len(crowds) == 2:
        assert copies <= 2 * n


def test_wide_buckets_find_links_between_crowds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(near_texts())], "doc_id long, text string")
    small = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows).collect()}
    monkeypatch.undo()
    assert small == {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows).collect()}


def test_links_of_short_texts_at_exactly_the_similarity_are_all_found(spark):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(2000):
        m = 1 + k % 9
        if k % 2:  # both ends differ: 6 of 8 parts are shared
            base = [f"v{x}" for x in rng.integers(0, 1 << 40, 7 * m + 4)]
            texts += [" ".join(base), " ".join(base[:-m] + [f"u{x}" for x in rng.integers(0, 1 << 40, m)])]
        else:  # one set holds the other: 3 of 4 parts
            base = [f"v{x}" for x in rng.integers(0, 1 << 40, 4 * m + 4)]
            texts += [" ".join(base), " ".join(base[: 3 * m + 4])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


@pytest.mark.parametrize("size", [3, 20, 90, 124])
def test_similar_sets_share_an_exact_key(size):
    class levels:
        value = np.random.default_rng(2).integers(0, 9, 4096).astype(np.uint8)

    rng = np.random.default_rng(size)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        most = len(x) // 4
        y = np.unique(np.r_[rng.permutation(x)[rng.integers(0, most + 1) :], rng.integers(0, 1 << 60, rng.integers(0, most + 1)).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([x.tobytes(), y.tobytes()], pa.binary())], names=["doc_id", "small"])
            p, q = next(minhash._prefixes(levels, 75)(iter([batch]))).column("keys").to_pylist()
            first = next(k for k in p if k in set(q))
            assert minhash._can(np.array([len(x)]), np.array([p.index(first)]), len(y), q.index(first), 75).all()


@pytest.mark.parametrize("visits", [1, 5, 40, 144])
def test_cells_are_visited_in_order_of_distance(monkeypatch, visits):
    rng = np.random.default_rng(visits)
    index = embedding_dedup.Index(rng.normal(size=(12, 4)), rng.normal(size=(12, 3)))
    unit = rng.normal(size=(20, 7))
    a, b = index.distances(unit)
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    order = np.argsort(total, axis=1)
    for walk in (0, 1000):
        monkeypatch.setattr(embedding_dedup, "WALK", walk)
        assert (index.sequence(unit, visits) == order[:, :visits]).all()
    assert (index.cells(unit) == order[:, 0]).all()
    assert (index.places(unit, order[:, visits - 1]) == visits - 1).all()


def test_recall_over_many_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40_000, 64)).astype(np.float32)
    near = base[:12_000] / np.linalg.norm(base[:12_000], axis=1, keepdims=True)
    away = rng.normal(size=near.shape)
    away -= (away * near).sum(axis=1)[:, None] * near
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = rng.uniform(0.9505, 1.0, len(near))[:, None]
    vectors = np.concatenate([base, (cosine * near + (1 - cosine**2) ** 0.5 * away).astype(np.float32)])
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}))
    got = embedding_dedup.near_vectors(frame.repartition(8)).where("n_links > 0").collect()
    # Random vectors of 64 components never come near each other, so the planted pairs are all there is.
    assert all(r["component_id"] in (r["vec_id"], r["vec_id"] - 40_000) for r in got)
    assert 0.97 * 24_000 <= sum(r["n_links"] for r in got) <= 24_000
