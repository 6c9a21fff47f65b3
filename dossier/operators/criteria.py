"""Marking schemes: validation, formulas, hierarchy, bands and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.functions.frames import bound
from dossier.functions.text import Cue, Rule, first_rule, normalised

#: Rows that are no criteria, sub-items and tasks.
SKIP = r"(?i)(total|sub.?total|grand|note|minimum qualifying)"
SUB_ITEM = r"^\(?[a-h]\)"
ACTION = r"(?i)^(prepare|assist|support|conduct|review|monitor)\b"
# The words that tell a scheme. Classes of words that count as one, and rules in the order in which they are tried.
CLASSES = {
    "mark": ["mark", "marks"], "crore": ["cr", "crs", "crore", "crores"], "lakh": ["lakh", "lakhs"], "professional": ["professional", "professionals"], "employee": ["employee", "employees"],
    "each": ["each", "per"], "single": ["one", "01"], "job": ["project", "projects", "assignment", "assignments"], "qualification": ["qualification", "qualifications"], "cv": ["cv", "cvs"],
    "competence": ["competence", "competences"], "experience": ["exp", "experience"], "score": ["score", "scores"], "msme": ["msme", "msmes"], "hundred": ["100"],
}
NUMBER = ("#", "hundred")
FORMULAS = [
    Rule("STEP", [Cue(NUMBER, ("every additional",), ("crore",))]),
    Rule("STEP", [Cue(("turnover",), ("for",)), Cue(("than",), ("more",))], in_order=True),
    Rule("STEP", [Cue(NUMBER, ("above",), ("crore",)), Cue(NUMBER, unit=("mark",))], in_order=True),
    Rule("BAND", [Cue(NUMBER, unit=("professional",), times=2)]),
    Rule("BAND", [Cue(NUMBER, unit=("employee",), times=2)]),
    Rule("BAND", [Cue(NUMBER, ("up to", "more than"), ("crore", "lakh")), Cue(NUMBER, unit=("mark",), times=2)]),
    Rule("PER_UNIT", [Cue(("job",), ("# mark for each", "# mark for single"))]),
    Rule("PER_UNIT", [Cue(("job",), ("each",)), Cue(NUMBER, unit=("mark",))], in_order=True),
    Rule("QUAL", [Cue(("qualification", "competence", "cv"))]),
    Rule("QUAL", [Cue(("vitae", "graduate", "experience"), ("curriculum", "post", "years of"))]),
    Rule("BINARY", [Cue(("registered", "certified", "accredited", "empanelled", "msme"))]),
    Rule("BINARY", [Cue((*NUMBER, "india"), ("iso", "startup"))]),
]
PERSONAL = [Rule("QUAL", [Cue(("qualification", "competence"))])]
RELATIVE = [
    Rule("share", [Cue(("score",), ("proportionate",))]),
    Rule("share", [Cue(("score",), ("maximum",)), Cue(("proportionate",))], in_order=True),
    Rule("rank", [Cue(("number",), ("highest",)), Cue(("score",), ("maximum",))], in_order=True),
    Rule("rank", [Cue(("lowest",), ("ranked from highest to",))]),
    Rule("relative", [Cue(("scoring",), ("relative",))]),
    Rule("relative", [Cue(("size", "quality", "evaluation"), ("comparative",))]),
    Rule("weighed", [Cue(("qcbs",))]),
    Rule("weighed", [Cue(("quality",)), Cue(("cost",)), Cue(("selection",), ("based",))], in_order=True),
    Rule("weighed", [Cue(("fm",), ("sf hundred", "sf hundred x"))]),
    Rule("weighed", [Cue(("score",), ("combined", "combined technical and financial"))]),
]
METHOD = [Rule("method", [Cue(("methodology",))]), Rule("method", [Cue(("plan",), ("work",))])]
THEMES = [("experience", "Experience"), ("turnover|revenue", "Financial strength"), ("team|expert|cv", "Team"), ("method|plan", "Methodology")]


def rejection(parameter: Column, marks: Column, low: int = 2, high: int = 80) -> Column:
    """Why a row is no criterion: empty, marks, skip, sub_item or action; null for a valid one."""
    name = F.trim(F.coalesce(parameter, F.lit("")))
    return F.when(name == "", "empty").when(~F.coalesce(marks, F.lit(0)).between(low, high), "marks").when(F.rlike(name, F.lit(SKIP)), "skip").when(F.rlike(name, F.lit(SUB_ITEM)), "sub_item").when(F.rlike(name, F.lit(ACTION)), "action")


def deduplicated(criteria: DataFrame, order: str) -> DataFrame:
    """One row for each (doc, normalised parameter, max_marks): the longest text, the first by `order` of equals."""
    key = F.lower(F.regexp_replace(F.trim("parameter"), r"\s+", " "))
    w = W.partitionBy("doc", "_key", "max_marks").orderBy(F.desc(F.length(F.coalesce("criteria_text", F.lit("")))), order)
    return criteria.withColumn("_key", key).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_key")


def formula_type(parameter: Column, text: Column, rules: list[Rule] = FORMULAS) -> Column:
    """STEP, BAND, PER_UNIT, QUAL, BINARY or LLM: the first rule that the text meets; a parameter about a person is QUAL before BINARY."""
    personal = first_rule(parameter, CLASSES, PERSONAL).isNotNull()
    return bound(first_rule(text, CLASSES, rules), lambda said: F.when(F.coalesce(said == "BINARY", F.lit(True)) & personal, "QUAL").otherwise(F.coalesce(said, F.lit("LLM"))))


def code_number(code: Column) -> Column:
    return F.coalesce(F.regexp_extract(code, r"^\s*(\d+)", 1).try_cast("int"), F.lit(9999))


def code_letter(code: Column) -> Column:
    return F.lower(F.regexp_extract(code, r"^\s*\d+\s*\(?([A-Za-z]?)\)?", 1))


def in_code_order(criteria: DataFrame) -> DataFrame:
    """position of each criterion in its document by natural order of codes: 3, 3(a), 3b, 10."""
    w = W.partitionBy("doc").orderBy(code_number(F.col("item_code")), code_letter(F.col("item_code")), "item_code", "parameter")
    return criteria.withColumn("position", F.row_number().over(w))


def theme(names: Column) -> Column:
    """The first theme that any of an array of names belongs to, else Criterion."""
    text = F.lower(F.array_join(names, " "))
    out = F.lit("Criterion")
    for pattern, name in reversed(THEMES):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def with_hierarchy(criteria: DataFrame) -> DataFrame:
    """Children (codes with a letter) know their parent; parents hold the larger of their own and their children's marks.

    A parent that is missing is made, named by its children's theme.
    """
    rows = criteria.withColumns({"number": code_number(F.col("item_code")), "is_sub_item": code_letter(F.col("item_code")) != ""})
    sums = rows.where("is_sub_item").groupBy("doc", "number").agg(F.sum("max_marks").alias("child_marks"), F.array_sort(F.collect_list("parameter")).alias("names"))
    top = rows.where("not is_sub_item")
    own = top.join(sums, ["doc", "number"], "left").withColumns({"is_parent": F.col("child_marks").isNotNull(), "max_marks": F.greatest("max_marks", F.coalesce("child_marks", F.lit(0))), "synthetic": F.lit(False)})
    made = sums.join(top.select("doc", "number").distinct(), ["doc", "number"], "left_anti").select("doc", "number", F.col("number").cast("string").alias("item_code"), theme(F.col("names")).alias("parameter"), F.col("child_marks").alias("max_marks"), F.lit(False).alias("is_sub_item"), F.lit(True).alias("is_parent"), F.lit(True).alias("synthetic"))
    cols = ["doc", "number", "item_code", "parameter", "max_marks", "is_sub_item", "is_parent", "synthetic"]
    heads = own.select(cols).unionByName(made.select(cols))
    first = heads.groupBy("doc", "number").agg(F.min_by("parameter", F.struct("item_code", "parameter")).alias("parent_parameter"))
    kids = rows.where("is_sub_item").withColumns({"is_parent": F.lit(False), "synthetic": F.lit(False)}).select(cols).join(first, ["doc", "number"])
    return heads.withColumn("parent_parameter", F.lit(None).cast("string")).unionByName(kids)


def comparative(criteria: DataFrame) -> DataFrame:
    """criteria with comparative: the row's text says so, or any text of the document does and the row is about methodology."""
    own = first_rule("criteria_text", CLASSES, RELATIVE).isNotNull()
    return criteria.withColumn("comparative", own | (F.max(own).over(W.partitionBy("doc")) & first_rule("parameter", CLASSES, METHOD).isNotNull()))


def most_marks(text: Column) -> Column:
    """N of the first "N marks" from 3 to 60, else the largest integer there that no Cr, lakh or % follows."""
    said = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(\d+)\s*marks?"), F.lit(1)), lambda x: x.try_cast("int")), lambda n: n.between(3, 60))
    free = F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(?i)\d+\s*(cr|lakh|%)", " "), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int")), lambda n: n.between(3, 60))
    return F.coalesce(F.get(said, F.lit(0)), F.array_max(free))


def parsed_bands(criteria: DataFrame, keys: list[str], text: str = "criteria_text") -> DataFrame:
    """keys, lo, hi, score of the bands that a text states: "a to b: s marks", "more than n: s marks", "n+: s marks".

    An n+ band is left out where a more-than band opens at n.
    """
    number = r"(\d[\d,]*(?:\.\d+)?)"
    shapes = [(rf"(?i){number}\s*(?:to|-)\s*{number}\s*(?:crs?|crores?|years?|projects?)?\s*[:-]\s*(\d+)\s*marks?", 1, 2, 3, 0), (rf"(?i)(?:more\s+than|above|over|greater\s+than)\s*{number}\s*(?:\w+\s*)?[:-]\s*(\d+)\s*marks?", 1, None, 2, 1), (rf"(?i){number}\s*\+\s*[:-]\s*(\d+)\s*marks?", 1, None, 2, 2)]
    out = None
    for p, lo, hi, score, kind in shapes:
        every = lambda g, p=p: F.regexp_extract_all(text, F.lit(p), F.lit(g))
        value = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
        zipped = F.arrays_zip(every(lo).alias("lo"), (every(hi) if hi else F.transform(every(lo), lambda x: F.lit(None).cast("string"))).alias("hi"), every(score).alias("score"))
        rows = criteria.select(*keys, F.explode(zipped).alias("b")).select(*keys, value(F.col("b.lo")).alias("lo"), value(F.col("b.hi")).alias("hi"), value(F.col("b.score")).alias("score"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "lo", F.col("hi").isNull()).orderBy("kind", "score"))).where("kind < 2 or _k = 1").drop("_k", "kind")


def default_bands(formula: Column, most: Column) -> Column:
    """present and absent scores of a yes-or-no criterion."""
    return F.when(formula == "BINARY", F.struct(most.alias("present"), F.lit(0).alias("absent")))


def quality(criteria: DataFrame, declared: DataFrame) -> DataFrame:
    """doc, n, total, warnings: few marks, few criteria, a total far from the declared one (doc, declared)."""
    got = criteria.groupBy("doc").agg(F.count("*").alias("n"), F.sum("max_marks").alias("total")).join(declared, "doc", "left")
    return got.withColumn("warnings", F.array_compact(F.array(F.when(F.col("total") < 20, "low total"), F.when(F.col("n") < 3, "few criteria"), F.when(F.abs(F.col("total") - F.col("declared")) > 10, "differs from declared"))))


def reconciled(criteria: DataFrame, declared: DataFrame, additions: DataFrame, vague: list[str], slack: int = 2) -> DataFrame:
    """doc, total, declared, decision: whether added criteria (doc, parameter, max_marks) may mend a total that misses the declared one.

    ok within the slack; refused for a vague name; taken where the difference shrinks, else kept.
    """
    name = normalised("parameter")
    add = additions.groupBy("doc").agg(F.sum("max_marks").alias("more"), F.max(name.isin(vague)).alias("is_vague"))
    got = criteria.groupBy("doc").agg(F.sum("max_marks").alias("total")).join(declared, "doc").join(add, "doc", "left")
    off, after = F.abs(F.col("total") - F.col("declared")), F.abs(F.col("total") + F.coalesce("more", F.lit(0)) - F.col("declared"))
    return got.select("doc", "total", "declared", F.when(off <= slack, "ok").when(F.col("is_vague"), "refused").when(after < off, "taken").otherwise("kept").alias("decision"))


def cleaned_text(text: Column, most: int = 500) -> Column:
    """Without a leading serial number and the "(N marks)" note, spaces collapsed, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s*\d+[.)]\s*", ""), r"(?i)\(?\d+\s*marks?\)?", " "), r"\s+", " ")), 1, most)


def chosen_source(first: DataFrame, second: DataFrame, *, rows: int = 3, marks: int = 15) -> DataFrame:
    """Criteria of the first source, unless it has under `rows` rows or `marks` marks in a document and the second no fewer rows; method says which."""
    count = lambda df, n, m: df.groupBy("doc").agg(F.count("*").alias(n), F.sum("max_marks").alias(m))
    both = count(first, "n1", "m1").join(count(second, "n2", "m2"), "doc", "full_outer").na.fill(0, ["n1", "m1", "n2", "m2"])
    use = both.select("doc", (((F.col("n1") < rows) | (F.col("m1") < marks)) & (F.col("n2") >= F.col("n1"))).alias("other"))
    return first.join(use.where("not other").select("doc"), "doc", "left_semi").withColumn("method", F.lit("first")).unionByName(second.join(use.where("other").select("doc"), "doc", "left_semi").withColumn("method", F.lit("second")))
