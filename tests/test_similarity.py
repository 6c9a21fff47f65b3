"""Joins of strings and of sets of words against all pairs, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import feedback
from dossier.operators.similarity import close, closest, with_blanks, within


def plan_of(df):
    return df._jdf.queryExecution().toString()


def strings(rng, n, least=0):
    return ["".join(rng.choices("ab é\U0001f600.", k=rng.randrange(least, 9))) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_within_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = ([(rng.randrange(3), t) for t in strings(rng, 60)] + [(0, None), (1, "")] for _ in range(2))
    frames = [spark.createDataFrame(x, "doc int, text string").repartition(3) for x in (a, b)]
    pairs = within(*frames, ["doc"])
    expected = {(d, x, y) for d, x in a for e, y in b if d == e and x and y and (x in y or y in x)}
    rows = [tuple(r) for r in pairs.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    blanks = {(d, x, y) for d, x in a for e, y in b if d == e and x is not None and y is not None and "" in (x, y)}
    rows = [tuple(r) for r in with_blanks(pairs, *frames, ["doc"]).collect()]
    assert set(rows) == expected | blanks and len(rows) == len(expected | blanks)
    assert within(frames[0].limit(0), frames[1], ["doc"]).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 1.0])
def test_close_equals_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    words = lambda: rng.choices("abcdefghij", k=rng.randrange(0, 7)) + (["common"] if rng.random() < 0.7 else [])
    a, b = ([(rng.randrange(2), words(), k % 20) for k in range(50)] for _ in range(2))
    frames = [spark.createDataFrame(x, "doc int, words array<string>, rank int") for x in (a, b)]
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0
    key = lambda w: tuple(sorted(set(w)))
    expected = {(d, key(x), key(y)) for d, x, _ in a for e, y, _ in b if d == e and share(x, y) >= least}
    rows = [(r["doc"], tuple(r["x"]), tuple(r["y"])) for r in close(*frames, ["doc"], least).collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    best = {}
    for d, x, _ in a:
        found = [(-share(x, y), rank) for e, y, rank in b if d == e and share(x, y) >= least]
        if found:
            best[d, key(x)] = min(found)[1]
    assert {(r["doc"], tuple(r["words"])): r["rank"] for r in closest(*frames, ["doc"], least).collect()} == best


def test_a_word_in_every_long_name_pairs_nothing(spark):
    """Names of eight words that share one word only: no pair reaches the verification."""
    frame = spark.range(2000).select(F.lit(1).alias("doc"), F.array(F.lit("the"), *[F.concat(F.lit(f"w{k} "), F.col("id").cast("string")) for k in range(7)]).alias("words"))
    got = close(frame, frame, ["doc"], 0.3)
    assert got.count() == 2000
    joins = [line for line in plan_of(got).split("\n") if "Join" in line]
    assert joins and not [line for line in joins if "NestedLoop" in line or "Cartesian" in line]


def test_contexts_meet_without_products(spark):
    names = spark.range(100_000).select(F.concat(F.lit("NAME-"), F.col("id").cast("string"), F.lit("-END")).alias("offering"), F.concat(F.lit("SOL "), (F.col("id") % 1000).cast("string"), F.lit(" X")).alias("solution"))
    pairs = feedback.context_pairs(names, names.where("offering like '%77-END'").withColumn("solution", F.lit("")))
    assert pairs.where("row_offering <> offering").count() == 0 and pairs.count() == 1000
    plan = plan_of(feedback.context_pairs(names, names))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contexts_and_rules_equal_all_pairs(spark):
    rng = random.Random(3)
    text = lambda: rng.choice(["", " ", "a", "AB", "abc", "b c", "C", "xAbCx", "é"])
    rows, targets = [(text(), text()) for _ in range(40)], [(text(), text()) for _ in range(40)]
    norm = lambda x: x.strip(" ").upper()
    meets = lambda p, q: not q or q in p or p in q
    expected = {(norm(a), norm(b), norm(c), norm(d)) for a, b in rows for c, d in targets if meets(norm(a), norm(c)) and meets(norm(b), norm(d))}
    frame = lambda x: spark.createDataFrame(x, "offering string, solution string")
    got = [tuple(r) for r in feedback.context_pairs(frame(rows), frame(targets)).select("row_offering", "row_solution", "offering", "solution").collect()]
    assert set(got) == expected and len(got) == len(expected)
    rules = [(k, rng.choice(["ld", "scope"]), *r, f"text {k}", k % 3 > 0) for k, r in enumerate(rows)]
    wanted = [(rng.choice(["ld", "scope"]), *t) for t in targets]
    learned = feedback.learned_rule(spark.createDataFrame(rules, "rule_id int, clause_type string, offering string, solution string, rule_text string, active boolean"), spark.createDataFrame(wanted, "clause_type string, offering string, solution string")).collect()
    first = lambda c, o, s: min((k for k, kind, ro, rs, _, active in rules if active and kind == c and meets(norm(ro), norm(o)) and meets(norm(rs), norm(s))), default=None)
    assert sorted(((r["clause_type"], r["offering"], r["solution"], r["rule_id"]) for r in learned), key=str) == sorted(((*t, first(*t)) for t in wanted), key=str)
