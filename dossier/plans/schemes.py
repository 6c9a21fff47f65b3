"""Marking-scheme queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import criteria as K
from dossier.plans.registry import Registry, Tables

R = Registry()
# Criteria: parts, a text for each type, codes with and without letters.
_TEXT = {
    "STANDARD": ("'10 to 20: 5 marks; more than 20: ' || p_size || ' marks; 30+: 12 marks; 20+: 9 marks; up to 50 cr'", "'20 professionals: 5 marks, 40 professionals: ' || p_size || ' marks'"),
    "PROMO": ("'3 marks for each project, maximum 15'", "'Per assignment in the sector 2 marks'"),
    "LARGE": ("'Turnover above 50 Cr gets 10 marks, every additional 10 Cr 1 mark'", "'For turnover of the firm more than 50 the highest marks'"),
    "ECONOMY": ("'2. Qualification and CV of the team leader  (8 Marks)'", "'Years of experience of the expert'"),
    "MEDIUM": ("'Registered under ISO 9001, 40 % within 90 lakh, 7 of 9'", "'Recognised by Startup India'"),
    "SMALL": ("'proportionate score by ranked methodology'", "'QCBS: the highest number of experts gets the maximum score'"),
}
_PICK = " ".join(f"WHEN '{k}' THEN CASE WHEN p_size % 3 > 0 THEN {v} ELSE {w} END" for k, (v, w) in _TEXT.items())
CRITERIA_SQL = f"""crit AS (SELECT p_partkey AS seq, p_partkey % 100 AS doc, p_size % 12 || CASE p_size % 4 WHEN 1 THEN '(a)' WHEN 2 THEN 'b' ELSE '' END AS item_code, CASE WHEN p_size % 9 = 0 THEN 'Total ' || p_name WHEN p_size % 10 = 0 THEN 'Prepare ' || p_name WHEN p_size % 11 = 0 THEN 'Methodology ' || p_name ELSE p_name END AS parameter,
CASE p_type {_PICK} END AS criteria_text, p_size % 30 AS max_marks FROM part)"""


def criteria(t: Tables):
    pick = F.expr(f"CASE p_type {_PICK} END")
    n = F.col("p_size")
    name = F.when(n % 9 == 0, F.concat(F.lit("Total "), F.col("p_name"))).when(n % 10 == 0, F.concat(F.lit("Prepare "), F.col("p_name"))).when(n % 11 == 0, F.concat(F.lit("Methodology "), F.col("p_name"))).otherwise(F.col("p_name"))
    code = F.concat((n % 12).cast("string"), F.when(n % 4 == 1, "(a)").when(n % 4 == 2, "b").otherwise(""))
    return t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 100).alias("doc"), code.alias("item_code"), name.alias("parameter"), pick.alias("criteria_text"), (n % 30).alias("max_marks"))


_REASON_SQL = "CASE WHEN trim(parameter) = '' THEN 'empty' WHEN max_marks NOT BETWEEN 2 AND 80 THEN 'marks' WHEN regexp_matches(parameter, '(?i)(total|sub.?total|grand|note|minimum qualifying)') THEN 'skip' WHEN regexp_matches(parameter, '^\\(?[a-h]\\)') THEN 'sub_item' WHEN regexp_matches(parameter, '(?i)^(prepare|assist|support|conduct|review|monitor)\\b') THEN 'action' END"


@R.query("k1_validate", f"WITH {CRITERIA_SQL} SELECT seq, {_REASON_SQL} AS reason FROM crit")
def _(t: Tables):
    return criteria(t).select("seq", K.rejection(F.col("parameter"), F.col("max_marks")).alias("reason"))


@R.query("k2_dedupe", f"WITH {CRITERIA_SQL} SELECT seq, doc, parameter, max_marks FROM crit QUALIFY row_number() OVER (PARTITION BY doc, lower(parameter), max_marks ORDER BY length(criteria_text) DESC, seq) = 1")
def _(t: Tables):
    return K.deduplicated(criteria(t), "seq").select("seq", "doc", "parameter", "max_marks")


_FORMULA_SQL = """CASE WHEN regexp_matches(lower(criteria_text), 'every\\s+additional\\s+\\d+\\s*cr') OR regexp_matches(lower(criteria_text), 'above\\s+\\d+\\s*cr.*?\\d+\\s*marks?') OR (contains(lower(criteria_text), 'for turnover') AND contains(split_part(lower(criteria_text), 'for turnover', 2), 'more than')) THEN 'STEP'
WHEN len(regexp_extract_all(lower(criteria_text), '\\d+\\s*professional')) >= 2 OR (regexp_matches(lower(criteria_text), '(up\\s+to|more\\s+than)\\s+\\d+\\s*(cr|crore|lakh)') AND len(regexp_extract_all(lower(criteria_text), '\\d+\\s*marks?')) >= 2) THEN 'BAND' WHEN regexp_matches(lower(criteria_text), '\\d+\\s*marks?\\s+for\\s+(each|01|per|one)\\s+(project|assignment)') OR regexp_matches(lower(criteria_text), 'per assignment.*\\d+ mark') THEN 'PER_UNIT'
WHEN contains(lower(criteria_text), 'qualification') OR contains(lower(criteria_text), 'years of exp') THEN 'QUAL' WHEN regexp_matches(lower(criteria_text), 'registered|iso\\s+\\d+|startup india') THEN 'BINARY' ELSE 'LLM' END"""


@R.query("k3_formula", f"WITH {CRITERIA_SQL} SELECT seq, {_FORMULA_SQL} AS formula FROM crit")
def _(t: Tables):
    return criteria(t).select("seq", K.formula_type(F.col("parameter"), F.col("criteria_text")).alias("formula"))


_NUM = "coalesce(try_cast(nullif(regexp_extract(item_code, '^\\s*(\\d+)', 1), '') AS INT), 9999)"
_LET = "lower(regexp_extract(item_code, '^\\s*\\d+\\s*\\(?([A-Za-z]?)\\)?', 1))"


@R.query("k4_code_order", f"WITH {CRITERIA_SQL} SELECT doc, item_code, parameter, row_number() OVER (PARTITION BY doc ORDER BY {_NUM}, {_LET}, item_code, parameter)::INT AS position FROM crit")
def _(t: Tables):
    return K.in_code_order(criteria(t)).select("doc", "item_code", "parameter", "position")


_THEME_SQL = "CASE WHEN regexp_matches({0}, 'experience') THEN 'Experience' WHEN regexp_matches({0}, 'turnover|revenue') THEN 'Financial strength' WHEN regexp_matches({0}, 'team|expert|cv') THEN 'Team' WHEN regexp_matches({0}, 'method|plan') THEN 'Methodology' ELSE 'Criterion' END"
_TREE_SQL = f"""{CRITERIA_SQL}, n AS (SELECT *, {_NUM} AS number, {_LET} <> '' AS sub FROM crit), kid AS (SELECT doc, number, sum(max_marks) AS child_marks, lower(string_agg(parameter, ' ' ORDER BY parameter)) AS names FROM n WHERE sub GROUP BY ALL),
heads AS (SELECT doc, number, item_code, parameter, greatest(max_marks, coalesce(child_marks, 0))::BIGINT AS max_marks, child_marks IS NOT NULL AS is_parent, false AS synthetic FROM n LEFT JOIN kid USING (doc, number) WHERE NOT sub UNION ALL SELECT doc, number, number::VARCHAR, {_THEME_SQL.format('names')}, child_marks, true, true FROM kid WHERE NOT EXISTS (SELECT 1 FROM n WHERE NOT sub AND n.doc = kid.doc AND n.number = kid.number)),
par AS (SELECT doc, number, min_by(parameter, (item_code, parameter)) AS parent_parameter FROM heads GROUP BY ALL), tree AS (SELECT *, false AS is_sub_item, NULL AS parent_parameter FROM heads UNION ALL SELECT doc, number, item_code, parameter, max_marks, false, false, true, parent_parameter FROM n JOIN par USING (doc, number) WHERE sub)"""


@R.query("k5_hierarchy", f"WITH {_TREE_SQL} SELECT doc, item_code, parameter, max_marks, is_parent, is_sub_item, synthetic, parent_parameter FROM tree")
def _(t: Tables):
    return K.with_hierarchy(criteria(t)).drop("number")


@R.query("k6_theme", f"WITH {CRITERIA_SQL} SELECT doc, {_THEME_SQL.format(chr(39) + chr(39) + ' || lower(string_agg(parameter, chr(32) ORDER BY parameter))')} AS theme FROM crit GROUP BY doc")
def _(t: Tables):
    return criteria(t).groupBy("doc").agg(K.theme(F.array_sort(F.collect_list("parameter"))).alias("theme"))


@R.query("k7_comparative", f"WITH {CRITERIA_SQL}, o AS (SELECT *, (regexp_matches(lower(criteria_text), 'proportionate score|qcbs') OR contains(split_part(lower(criteria_text), 'highest number', 2), 'maximum score')) AS own FROM crit) SELECT seq, own OR (bool_or(own) OVER (PARTITION BY doc) AND regexp_matches(parameter, '(?i)(methodology|work\\s+plan)')) AS comparative FROM o")
def _(t: Tables):
    return K.comparative(criteria(t)).select("seq", "comparative")


@R.query("k8_most_marks", f"WITH {CRITERIA_SQL} SELECT seq, coalesce(list_filter(list_transform(regexp_extract_all(criteria_text, '(?i)(\\d+)\\s*marks?', 1), lambda x: x::INT), lambda x: x BETWEEN 3 AND 60)[1], list_max(list_filter(list_transform(regexp_extract_all(regexp_replace(criteria_text, '(?i)\\d+\\s*(cr|lakh|%)', ' ', 'g'), '(\\d+)', 1), lambda x: x::INT), lambda x: x BETWEEN 3 AND 60))) AS marks FROM crit")
def _(t: Tables):
    return criteria(t).select("seq", K.most_marks(F.col("criteria_text")).alias("marks"))


@R.query("k9_bands", f"""WITH {CRITERIA_SQL} SELECT seq, lo::DOUBLE AS lo, hi::DOUBLE AS hi, score::DOUBLE AS score FROM (SELECT seq, p_size, unnest([10, 20, 30, 20]) AS lo, unnest([20, NULL, NULL, NULL]) AS hi, unnest([5, p_size, 12, 9]) AS score, unnest([0, 1, 2, 3]) AS k FROM crit JOIN part ON seq = p_partkey WHERE p_type = 'STANDARD' AND p_size % 3 > 0) WHERE k < 3""")
def _(t: Tables):
    return K.parsed_bands(criteria(t), ["seq"])


@R.query("k10_binary_bands", f"WITH {CRITERIA_SQL} SELECT seq, max_marks AS present, 0 AS absent FROM crit WHERE {_FORMULA_SQL} = 'BINARY'")
def _(t: Tables):
    got = criteria(t).select("seq", K.default_bands(K.formula_type(F.col("parameter"), F.col("criteria_text")), F.col("max_marks")).alias("b"))
    return got.where("b is not null").select("seq", "b.*")


_DECLARED_SQL = f"{CRITERIA_SQL}, decl AS (SELECT DISTINCT doc, (150 + doc * 3)::INT AS declared FROM crit), tt AS (SELECT doc, count(*) AS n, sum(max_marks)::BIGINT AS total FROM crit GROUP BY doc)"


def _declared(t: Tables):
    return criteria(t).select("doc", (150 + F.col("doc") * 3).cast("int").alias("declared")).distinct()


@R.query("k11_warnings", f"WITH {_DECLARED_SQL} SELECT doc, n, total, concat_ws(',', CASE WHEN total < 20 THEN 'low total' END, CASE WHEN n < 3 THEN 'few criteria' END, CASE WHEN abs(total - declared) > 10 THEN 'differs from declared' END) AS warnings FROM tt JOIN decl USING (doc)")
def _(t: Tables):
    return K.quality(criteria(t), _declared(t)).select("doc", "n", "total", F.array_join("warnings", ",").alias("warnings"))


@R.query("k12_reconcile", f"""WITH {_DECLARED_SQL}, ad AS (SELECT doc, sum(max_marks) AS more, bool_or(lower(parameter) IN ('small ring', 'red widget')) AS vague FROM crit WHERE seq % 5 = 0 GROUP BY doc)
SELECT doc, total, declared, CASE WHEN abs(total - declared) <= 2 THEN 'ok' WHEN vague THEN 'refused' WHEN abs(total + coalesce(more, 0) - declared) < abs(total - declared) THEN 'taken' ELSE 'kept' END AS decision FROM tt JOIN decl USING (doc) LEFT JOIN ad USING (doc)""")
def _(t: Tables):
    return K.reconciled(criteria(t), _declared(t), criteria(t).where("seq % 5 = 0"), ["small ring", "red widget"])


@R.query("k13_cleaned_text", f"WITH {CRITERIA_SQL} SELECT seq, left(trim(regexp_replace(regexp_replace(regexp_replace(criteria_text, '^\\s*\\d+[.)]\\s*', ''), '(?i)\\(?\\d+\\s*marks?\\)?', ' ', 'g'), '\\s+', ' ', 'g')), 40) AS text FROM crit")
def _(t: Tables):
    return criteria(t).select("seq", K.cleaned_text(F.col("criteria_text"), 40).alias("text"))


@R.query("k14_chosen_source", f"""WITH {CRITERIA_SQL}, a AS (SELECT * FROM crit WHERE seq % 7 < doc % 5), b AS (SELECT * FROM crit WHERE seq % 2 = 0), ca AS (SELECT doc, count(*) AS n1, sum(max_marks) AS m1 FROM a GROUP BY doc), cb AS (SELECT doc, count(*) AS n2 FROM b GROUP BY doc),
u AS (SELECT doc, (coalesce(n1, 0) < 3 OR coalesce(m1, 0) < 15) AND coalesce(n2, 0) >= coalesce(n1, 0) AS o FROM ca FULL JOIN cb USING (doc)) SELECT seq, 'first' AS method FROM a JOIN u USING (doc) WHERE NOT o UNION ALL SELECT seq, 'second' FROM b JOIN u USING (doc) WHERE o""")
def _(t: Tables):
    rows = criteria(t)
    return K.chosen_source(rows.where("seq % 7 < doc % 5"), rows.where("seq % 2 = 0")).select("seq", "method")


QUERIES, ORACLE = R.queries, R.oracle
