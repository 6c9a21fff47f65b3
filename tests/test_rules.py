"""Rules of cues over words, and the patterns that say them."""

import re
import time

from pyspark.sql import functions as F

from dossier.functions.text import Cue, Rule, first_rule, pattern_of, value_behind
from dossier.operators import criteria as K

CLASSES = {"mark": ["mark", "marks"], "hundred": ["100"], "score": ["score", "scores"], "each": ["each", "per"]}
RULES = [
    Rule("twice", [Cue(("#",), unit=("mark",), times=2)]),
    Rule("order", [Cue(("score",)), Cue(("#",), ("more than",))], in_order=True),
    Rule("hundred", [Cue(("hundred",), ("# mark",))]),
    Rule("pair", [Cue(("each",), ("a", "b")), Cue(("mark",))]),
]


def _plain(text, rules, back=4):
    """The same by single words in Python."""
    class_of = {w: k for k, ws in CLASSES.items() for w in ws}
    kinds = [class_of.get(w, "#" if w[0].isdigit() else w) for w in re.findall(r"[a-z]+|\d[\d,]*(?:\.\d+)?", text.lower())]

    def fits(i, cue):
        lead = "".join(f" {k}" for k in kinds[max(0, i - back) : i])
        return kinds[i] in cue.kind and (not cue.lead or any(lead.endswith(f" {x}") for x in cue.lead)) and (not cue.unit or (i + 1 < len(kinds) and kinds[i + 1] in cue.unit))

    for rule in rules:
        if rule.in_order:
            at = -1
            for cue in rule.cues:
                at = next((i for i in range(at + 1, len(kinds)) if fits(i, cue)), None) if at is not None else None
            met = at is not None
        else:
            met = all(sum(fits(i, c) for i in range(len(kinds))) >= c.times for c in rule.cues)
        if met:
            return rule.label
    return None


def test_rules_as_by_single_words(spark):
    import random

    pick = random.Random(7)
    words = ["more than", "more than", "mark", "marks", "100", "1,000", "2.5", "7", "score", "scores", "each", "per", "a", "b", "more", "hundred", "Marks", "x,", "#"]
    texts = ["", *[" ".join(pick.choice(words) for _ in range(pick.randint(1, 9))) for _ in range(1500)]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.label for r in df.select("text", first_rule("text", CLASSES, RULES).alias("label")).collect()}
    assert {t: _plain(t, RULES) for t in texts} == got
    assert len(set(got.values())) == 5
    assert spark.createDataFrame([(None,)], "text string").select(first_rule("text", CLASSES, RULES)).first()[0] is None


def test_value_behind(spark):
    days = lambda t: spark.createDataFrame([(t,)], "t string").select(value_behind("t", {"day": ["day", "days"]}, Cue(("replacement",)), Cue(("#",), unit=("day",)))).first()[0]
    assert days("20 days; Replacement in 3 weeks or 1,045 Days, else 9 days") == 1045.0
    assert days("30 days for replacement") is None and days(None) is None


def test_formulas_are_cheap(spark):
    """A rule is one pattern; with a pass over the words for each cue this took minutes."""
    df = spark.range(60_000).select(F.concat(F.lit("the firm shall have "), F.col("id").cast("string"), F.lit(" offices in the region and shall give the marks of its team for every city and year")).alias("t"))
    df.limit(10).select(K.formula_type(F.col("t"), F.col("t")).alias("f")).collect()
    start = time.time()
    assert df.groupBy(K.formula_type(F.col("t"), F.col("t")).alias("f")).count().collect() == [("LLM", 60_000)]
    assert time.time() - start < 15
    assert re.compile(pattern_of(K.FORMULAS[0], K.CLASSES).replace("(?>", "(?:"))
