"""Digests of feedback in parts against plain Python."""

import datetime
import random

import pytest

from dossier.operators.feedback import digest

SCHEMA = "who string, created_at timestamp, id long, agreement string, system_level string, suggested_level string, comment string"


def plain(rows, least, budget):
    out, groups = [], {}
    for r in rows:
        line = " | ".join(x for x in (r[3], "->".join(y for y in r[4:6] if y is not None), r[6]) if x is not None)
        groups.setdefault(r[0], []).append((r[1] is None, r[1] or datetime.datetime.min, r[2], line))
    for who, lines in groups.items():
        if len(lines) < least:
            continue
        parts, at = {}, 0
        for *_, line in sorted(lines):
            parts.setdefault(at // budget, []).append(line)
            at += len(line) + 1
        out += [(who, len(lines), k, len(parts), len(p), "\n".join(p)) for k, p in enumerate((parts[x] for x in sorted(parts)), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [1, 40, 2_000, 10**9])
def test_same_as_plain(spark, budget):
    rng, start = random.Random(budget), datetime.datetime(2020, 1, 1)
    rows = []
    for k in range(400):
        who = rng.choice(["hot"] * 6 + ["a", "b", None, "few"] if k > 380 else ["hot", "hot", "a", "b", None])
        when = None if k % 17 == 0 else start + datetime.timedelta(days=rng.randrange(200))
        rows.append((who, when, k, rng.choice(["agree", None]), rng.choice(["LOW", None]), rng.choice(["HIGH", None]), rng.choice([None, "", "é" * rng.randrange(90)])))
    rows.append(rows[5])  # a repeated row is a line of its own
    got = digest(spark.createDataFrame(rows, SCHEMA), ["who"], least=5, budget=budget)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 5, budget)


def test_no_rows(spark):
    assert digest(spark.createDataFrame([], SCHEMA), ["who"]).count() == 0
