"""Dictionaries of phrases found in texts: one pass over a text, however many phrases there are."""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the phrases of one automaton (some hundred bytes each in a worker), and of all phrases that go through the driver.
BLOCK, LIMIT = 500_000, 50_000_000
FOUND = pa.list_(pa.struct([("label", pa.string()), ("words", pa.int32()), ("times", pa.int64()), ("first", pa.int32())]))
_BUILT: dict[str, tuple] = {}  # the automata that a worker used last


class Dictionary:
    """Labels with their phrases in order: {phrase: [(label, place), ...]}."""

    def __init__(self, owners: dict[str, list[tuple[str, int]]]) -> None:
        self.owners, self.key = owners, uuid.uuid4().hex

    def built(self):
        if self.key not in _BUILT:
            machine = ahocorasick.Automaton()
            for phrase in self.owners:
                if phrase:
                    machine.add_word(phrase, phrase)
            machine.make_automaton()
            if len(_BUILT) >= 4:
                _BUILT.pop(next(iter(_BUILT)))
            _BUILT[self.key] = (machine if len(machine) else None,)
        return _BUILT[self.key][0]

    def found(self, text: str | None) -> list[dict]:
        """label, words (its phrases that stand in the text), times (their places, those of one phrase not overlapping), first (place from 1 of the first of them in its order)."""
        if text is None:
            return []
        machine, times, first, free = self.built(), defaultdict(int), {}, {}
        for end, phrase in machine.iter(text) if machine else ():
            start = end + 1 - len(phrase)
            if start >= free.get(phrase, 0):
                times[phrase] += 1
                free[phrase] = end + 1
                first.setdefault(phrase, start + 1)
        if "" in self.owners:
            times[""], first[""] = 0, 1
        got: dict[str, list] = {}
        for phrase, n in times.items():
            for label, place in self.owners[phrase]:
                words, total, best = got.get(label, (0, 0, (place, first[phrase])))
                got[label] = (words + 1, total + n, min(best, (place, first[phrase])))
        return [{"label": k, "words": w, "times": n, "first": b[1]} for k, (w, n, b) in sorted(got.items())]


def dictionaries(phrases: DataFrame, *, block: int = BLOCK, limit: int = LIMIT) -> list[Dictionary]:
    """phrases (label, place, phrase) as automata of at most `block` characters, all phrases of a label in one; null labels and phrases do not count.

    The characters are counted before anything is collected; more than `limit` are refused, as is a label of more than `block`.
    """
    rows = phrases.where("label is not null and phrase is not null")
    sizes = rows.groupBy("label").agg(F.sum(F.length("phrase") + F.length("label") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if sizes["total"] > limit or sizes["most"] > block:
        raise ValueError(f"a dictionary of {sizes['total']} characters, {sizes['most']} of one label; at most {limit} and {block} can be broadcast: join by grams (operators.similarity.within) instead")
    labels: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in rows.select("label", "place", "phrase").collect():  # at most `limit` characters
        labels[r["label"]].append((r["place"], r["phrase"]))
    out, owners, held = [], defaultdict(list), 0
    for label, words in sorted(labels.items()):
        n = sum(len(w) + len(label) + 1 for _, w in words)
        if owners and held + n > block:
            out.append(Dictionary(dict(owners)))
            owners, held = defaultdict(list), 0
        held += n
        for place, w in words:
            owners[w].append((label, place))
    return out + [Dictionary(dict(owners))] if owners else out


def _finder(spark, dictionary: Dictionary):
    shared = spark.sparkContext.broadcast(dictionary)

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.found(t.as_py()) for t in texts], FOUND)

    return F.arrow_udf(find, "array<struct<label string, words int, times long, first int>>")


def hits(texts: DataFrame, text: Column, phrases: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The rows of texts with label, words, times, first of each label of phrases (label, place, phrase) of which a phrase stands in the text.

    A row gives one row for each of its labels; phrases overlap freely. A text is read once for each automaton, which most
    dictionaries are one of; nothing is shuffled. Case counts: lower both where it should not. An empty phrase stands in every text that is not null, no times.
    """
    spark = texts.sparkSession
    passes = [texts.withColumn("_hit", F.explode(_finder(spark, d)(text))) for d in dictionaries(phrases, block=block)]
    none = lambda: texts.where("false").withColumn("_hit", F.lit(None).cast("struct<label string, words int, times long, first int>"))
    return (reduce(DataFrame.unionByName, passes) if passes else none()).select("*", "_hit.*").drop("_hit")
