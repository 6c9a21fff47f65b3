"""Vector search against all pairs, one by one, and its plan."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from dossier.operators import retrieval
from tests.test_similarity import plan_of

QUERY, CHUNK = "query_id long, doc string, vector array<float>", "doc string, chunk_id long, vector array<float>"


def unit(v):
    if not v or None in v:
        return None
    v = np.array(v, np.float32).astype(float).tolist()
    total = 0.0
    for x in v:
        total += x * x
    norm = math.sqrt(total)
    return None if norm <= 0 else [x / norm for x in v]


def score(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total if math.isnan(total) else float(Decimal(repr(total)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def all_pairs(queries, chunks, k):
    out = []
    for query, doc, v in queries:
        a, met = unit(v), []
        for other, chunk, w in chunks:
            b = unit(w)
            if doc is not None and doc == other and a and b and len(a) == len(b):
                met.append((score(a, b), chunk))
        met.sort(key=lambda m: (-math.inf if math.isnan(m[0]) else -m[0], m[1] is not None, m[1]))
        out += [(query, doc, chunk, str(s + 0.0), rank + 1) for rank, (s, chunk) in enumerate(met[:k])]
    return sorted(out, key=lambda r: (r[0], r[-1]))


def searched(spark, queries, chunks, **how):
    found = retrieval.cosine_top_k(spark.createDataFrame(queries, QUERY).repartition(3), spark.createDataFrame(chunks, CHUNK).repartition(3), **how)
    assert found.columns == ["query_id", "doc", "chunk_id", "score", "rank"]
    return sorted(((r["query_id"], r["doc"], r["chunk_id"], str(r["score"] + 0.0), r["rank"]) for r in found.collect()), key=lambda r: (r[0], r[-1]))


@pytest.mark.parametrize(("seed", "candidates", "queries", "least"), [(0, 8192, 2048, 1024), (1, 16, 4, 8)])
def test_cosine_top_k_equals_all_pairs(spark, monkeypatch, seed, candidates, queries, least):
    for name, value in (("CANDIDATES", candidates), ("QUERIES", queries), ("LEAST", least)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(seed)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(rng.choice([3, 3, 3, 4]))]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 1.0, 0.0], [1e-30, 0.0, 0.0]]
    docs = ["a", "a", "b", "c", None]
    asked = [(n, rng.choice(docs), vector()) for n in range(40)] + [(100 + n, "a", v) for n, v in enumerate(odd)] + [(200, "no chunks", [1.0])]
    given = [(rng.choice(docs), n, vector()) for n in range(300)] + [("b", 1000 + n, v) for n, v in enumerate(odd)] + [("a", None, [1.0, 1.0, 1.0]), ("no queries", 2000, [1.0])]
    assert searched(spark, asked, given, k=4) == all_pairs(asked, given, 4)
    assert searched(spark, asked, [], k=4) == searched(spark, [], given, k=4) == []


def test_copies_and_many_chunks_go_by_number(spark):
    """More copies than are scored together: the smallest numbers of them come first, and a better one that comes late still wins."""
    given = [("a", 9000 - n, [1.0, 2.0, 2.0]) for n in range(3000)] + [("a", 9500, [3.0, 0.0, 0.0])]
    asked = [(0, "a", [1.0, 2.0, 2.0]), (1, "a", [1.0, 0.0, 0.0])]
    assert searched(spark, asked, given, k=3) == [(0, "a", 6001 + n, "1.0", n + 1) for n in range(3)] + [(1, "a", 9500, "1.0", 1), (1, "a", 6001, "0.3333", 2), (1, "a", 6002, "0.3333", 3)]


def test_places_round_half_up_by_digits():
    scores = np.array([0.00005, 0.12345, 0.12344999999999999, -0.12345, 0.30005, 1.0, 0.0, math.nan])
    assert retrieval._places(scores).tolist() == [1, 1235, 1234, -1235, 3001, 10000, 0, math.inf]


def test_pairs_of_vectors_never_become_rows(spark):
    """Blocks meet in a task: no join brings a query's row together with a chunk's."""
    found = retrieval.cosine_top_k(spark.createDataFrame([(0, "a", [1.0])], QUERY), spark.createDataFrame([("a", 1, [1.0])], CHUNK))
    joins = [line for line in plan_of(found).split("\n") if "Join" in line]
    assert "FlatMapCoGroupsInArrow" in plan_of(found)
    assert joins and not [line for line in joins if "doc" in line]
