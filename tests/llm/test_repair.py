"""Conversation repair against a plain search over edit scripts, SQL, and its edges."""

import hashlib
import random
import re

import pytest

from dossier.llm import repair
from tests.compare import assert_same, connect

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The report of one conversation's rows (turn, role, text), by the least (cost, audit) of every suffix and state."""
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows = sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        mark = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not mark else "duplicate" if (role, text) in seen else "truncated" if mark not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        now = {}
        for q, (c, a, t) in best.items():
            ways = [(c + 4, "D" + a, t)]
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                c2, a2, t2 = best[after[q]]
                ways.append((c2 + 3 + late, "R" + a2, (f"{names[after[q]]}:{text}", *t2)))
                initial = role[:1]
                if initial == after[q] or (initial == "s" and q == ""):
                    c2, a2, t2 = best[initial]
                    ways.append((c2 + late, "K" + a2, (f"{role}:{text}", *t2)))
            now[q] = min(ways)
        for _ in range(3):
            now = {q: min(v, (now[after[q]][0] + 3, "I" + now[after[q]][1], (f"{names[after[q]]}:", *now[after[q]][2]))) for q, v in now.items()}
        best = now
    cost, audit, said = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    assert re.fullmatch("(s?(ua)+)?", "".join(x.split(":")[0][:1] for x in said))
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def made(rng, n, roles, texts):
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


SHAPES = [
    (["user", "assistant", "system", "tool", None, ""], ["a.", "b", "c!", "", " ", None, "x? \n", "é"]),
    (["user"], [f"t{k}" for k in range(40)]),  # truncated rows of one role, through which shapes may pass
    (["user", "assistant"], [f"t{k}." for k in range(40)]),
    (["system", "user"], ["same", "same."]),
]


@pytest.mark.parametrize("chunk, passes", [(4096, 3), (1, 3), (2, 0), (3, 1)])
def test_equal_to_a_plain_search(spark, chunk, passes):
    rng = random.Random(chunk * 10 + passes)
    conversations = {c: made(rng, rng.randrange(1, 24), *SHAPES[c % len(SHAPES)]) for c in range(40)} | {None: made(rng, 15, *SHAPES[0]), 900: made(rng, 60, *SHAPES[1]), 901: [(k, "user", "again.") for k in range(30)]}
    rows = [(c, *r, "own") for c, own in conversations.items() for r in own]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hash string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(frame, chunk=chunk, passes=passes).collect()}
    assert got == {c: brute(own) for c, own in conversations.items()}
    turns = repair.repaired_turns(frame, chunk=chunk, passes=passes).collect()
    said = {}
    for r in sorted(turns, key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(said.get(c, [])).encode()).hexdigest() for c in conversations} == {c: v[-1] for c, v in got.items()}


def test_a_rerun_stops_at_a_constant():
    rng = random.Random(5)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8]) for _ in range(rng.randrange(1, 12)))
        counts = [rng.randrange(1, 5) if c == 0 else 1 for c in codes]
        old, new = ([0, rng.randrange(0, 7), rng.randrange(0, 4), rng.randrange(-3, 4)] for _ in range(2))
        out = repair._shape(repair._run(codes, counts, old))
        assert repair._rerun(codes, counts, old, new, out) == repair._shape(repair._run(codes, counts, new))


def test_damage_follows_the_hash(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        one = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        expected += [one] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


def test_same_as_sql_on_larger_tables(spark):
    assert_same(repair.op11_conversation_repair(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), repair.ORACLE)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert repair.repair_report(none).count() == 0 and repair.repaired_turns(none).count() == 0
    known = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, (tuple(r) for r in repair.repair_report(none, known=known).collect()))) == sorted(map(str, [(7, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]))
    long = "x" * 3_000_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, 5, "user", "hot.")] * 5000
    got = {r["conv_id"]: r for r in repair.repair_report(spark.createDataFrame(rows, schema), chunk=100).collect()}
    assert got[1]["audit"] == "KK" and got[1]["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert got[2]["duplicate"] == 4999 and got[2]["audit"] == brute([(5, "user", "hot.")] * 5000)[6]
