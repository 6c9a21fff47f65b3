"""Scoring and gap queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import gaps, scoring as S
from dossier.plans.bindings import ITEMS_SQL, items
from dossier.plans.registry import Registry, Tables

R = Registry()

def _bands():
    return F.array(*[F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.lit(s).cast("double").alias("score")) for lo, hi, s in ((0, 10, 5), (10, 25, 10), (25, None, 15))])
_D = "::DECIMAL(20,6)"


@R.query("f1_numbers", r"""SELECT page_id, list_transform(regexp_extract_all(replace(url, ',', ''), '(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE)[1] AS first_number, len(regexp_extract_all(replace(url, ',', ''), '(\d+(?:\.\d+)?)', 1)) AS n_numbers FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", X.first_number("url").alias("first_number"), F.size(X.numbers("url")).cast("long").alias("n_numbers"))


@R.query("f2_name_overlap", """
WITH n AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS a, string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ') AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS overlap FROM n""")
def _(t: Tables):
    return t.part.select("p_partkey", X.jaccard(X.tokens("p_name"), X.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("overlap"))


@R.query("f3_upper_trimmed", "SELECT c_custkey, upper(trim(coalesce(c_mktsegment, ''))) AS segment FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", X.upper_trimmed("c_mktsegment").alias("segment"))


@R.query("m1_step_score", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0.0 ELSE least(5 + floor((p_size - 10) / 4.0) * 2, 20) END::DOUBLE AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.step_score(F.col("p_size"), F.lit(10), F.lit(5), F.lit(4), F.lit(2), F.lit(20)).cast("double").alias("score"))


@R.query("m2_band_upper", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 5.0 WHEN p_size <= 25 THEN 10.0 ELSE 15.0 END::DOUBLE AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.band_score(_bands(), F.col("p_size"), "upper").alias("score"))


@R.query("m3_band_half_open", """
WITH b(lo, hi, score) AS (VALUES (0.0, 10.0, 5.0), (10.0, 25.0, 10.0), (25.0, NULL, 15.0)), v AS (SELECT p_partkey, p_size + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS v FROM part)
SELECT p_partkey, max_by(score, lo)::DOUBLE AS score FROM v JOIN b ON v >= lo AND (hi IS NULL OR v < hi) GROUP BY p_partkey""")
def _(t: Tables):
    # "More than n" counts as n + 1; here the type PROMO stands for such a claim.
    value = F.col("p_size") + F.when(F.col("p_type") == "PROMO", 1).otherwise(0)
    return t.part.select("p_partkey", S.band_score(_bands(), value).alias("score"))


@R.query("m4_band_inclusive", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 5.0 WHEN p_size <= 25 THEN 10.0 ELSE 15.0 END::DOUBLE AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.band_score(_bands(), F.col("p_size"), "inclusive").alias("score"))


@R.query("m5_per_unit", "SELECT p_partkey, least(least(p_size, CASE WHEN p_type = 'SMALL' THEN 3 ELSE p_size END) * 4.5, 20)::DOUBLE AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.per_unit_score(F.col("p_size"), F.lit(4.5), F.when(F.col("p_type") == "SMALL", 3), F.lit(20)).cast("double").alias("score"))


@R.query("m6_qual_evidence", f"""
WITH f AS (SELECT p_partkey, [p_size % 2 = 0, p_size % 3 = 0, p_size % 5 = 0, p_type = 'PROMO', p_retailprice > 1000] AS f FROM part), w AS (SELECT *, [0.10, 0.25, 0.25, 0.25, 0.15] AS w, ['named_experts', 'education_stated', 'experience_years_stated', 'relevant_projects_listed', 'cvs_attached'] AS n FROM f)
SELECT p_partkey, round((list_sum(list_transform(range(1, 6), lambda i: CASE WHEN f[i] THEN w[i] ELSE 0 END))::DECIMAL(6,2) * 20){_D}, 1)::DOUBLE AS score, list_aggregate(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN f[i] THEN n[i] END), lambda x: x IS NOT NULL), 'string_agg', ',') AS found FROM w""")
def _(t: Tables):
    flags = dict(zip(S.QUAL_WEIGHTS, (F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.col("p_size") % 5 == 0, F.col("p_type") == "PROMO", F.col("p_retailprice") > 1000), strict=True))
    score, found, _ = S.qual_score(flags, F.lit(20))
    return t.part.select("p_partkey", score.cast("double").alias("score"), F.nullif(F.array_join(found, ","), F.lit("")).alias("found"))


@R.query("m7_binary", "SELECT p_partkey, CASE WHEN p_size > 10 AND lower(trim(CASE WHEN p_type = 'SMALL' THEN 'Not found' ELSE p_type END)) <> 'not found' THEN 10.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.binary_score(F.col("p_size") > 10, F.when(F.col("p_type") == "SMALL", "Not found").otherwise(F.col("p_type")), F.lit(10)).alias("score"))


@R.query("m8_clamp", f"SELECT p_partkey, round(least(greatest(p_retailprice / 40 - 20, 0), p_size){_D}, 1)::DOUBLE AS score, round((100 * round(least(greatest(p_retailprice / 40 - 20, 0), p_size){_D}, 1) / p_size){_D}, 1)::DOUBLE AS percentage FROM part")
def _(t: Tables):
    score = S.clamp(F.col("p_retailprice") / 40 - 20, F.col("p_size"))
    return t.part.select("p_partkey", score.cast("double").alias("score"), S.percent_of(score, F.col("p_size")).cast("double").alias("percentage"))


@R.query("m9_cv_confidence", "SELECT p_partkey, round((CASE WHEN p_size > 30 THEN 1.0 WHEN p_size > 15 THEN 0.75 ELSE 0.25 END * p_size * 2)::DECIMAL(20,6), 0)::DOUBLE / 2 AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.cv_score(F.when(F.col("p_size") > 30, "High").when(F.col("p_size") > 15, "medium").otherwise("low"), F.col("p_size")).alias("score"))


_MATCH_SQL = r"""
crit AS (SELECT p_partkey % 50 AS doc, (p_partkey // 50)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END AS item_code, p_name || ' ' || lower(p_type) AS parameter, p_partkey FROM part),
rws AS (SELECT p_partkey % 50 AS doc, (p_partkey // 50 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000 END)::VARCHAR AS item_code, lower(p_type) || ' ' || p_name AS parameter FROM part),
exact AS (SELECT c.*, r.item_code AS row_code FROM crit c LEFT JOIN rws r ON c.doc = r.doc AND c.item_code = r.item_code),
pre AS (SELECT e.*, r.item_code AS prefix_code FROM exact e LEFT JOIN rws r ON e.doc = r.doc AND length(e.item_code) > 1 AND left(e.item_code, length(e.item_code) - 1) = r.item_code),
tok AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(parameter), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4)) AS a FROM pre),
rtok AS (SELECT doc, item_code AS name_code, list_distinct(list_filter(string_split(trim(regexp_replace(lower(parameter), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4)) AS b FROM rws),
cand AS (SELECT t.doc, t.item_code, name_code, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS o FROM tok t JOIN rtok r ON t.doc = r.doc WHERE row_code IS NULL AND prefix_code IS NULL AND len(list_intersect(a, b)) > 0),
best AS (SELECT doc, item_code, min_by(name_code, (-o, name_code)) AS name_code FROM cand WHERE o >= 0.30 GROUP BY ALL),
matched AS (SELECT doc, item_code, parameter, p_partkey, coalesce(row_code, prefix_code, name_code) AS row_code, CASE WHEN row_code IS NOT NULL THEN 'code' WHEN prefix_code IS NOT NULL THEN 'prefix' WHEN name_code IS NOT NULL THEN 'name' ELSE 'none' END AS "match" FROM tok LEFT JOIN best USING (doc, item_code))"""


def _matched(t: Tables):
    code = (F.floor(F.col("p_partkey") / 50)).cast("long")
    crit = t.part.select((F.col("p_partkey") % 50).alias("doc"), F.concat(code.cast("string"), F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("")).alias("item_code"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("parameter"), "p_partkey")
    rows = t.part.select((F.col("p_partkey") % 50).alias("doc"), (code + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1000)).cast("string").alias("item_code"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("parameter"))
    return S.matched_rows(crit, rows)


@R.query("m10_match_waterfall", f'WITH {_MATCH_SQL} SELECT doc, item_code, row_code, "match" FROM matched')
def _(t: Tables):
    return _matched(t).select("doc", "item_code", "row_code", "match")


@R.query("m11_matrix_score", f"""WITH {_MATCH_SQL}, v AS (SELECT m.*, p.p_size, p.p_type, CASE WHEN "match" = 'none' THEN 0.0 WHEN p_type = 'PROMO' THEN least(p_size * 2.0, 20) WHEN p_size < 10 THEN 5.0 WHEN p_size < 25 THEN 10.0 ELSE 15.0 END AS raw FROM matched m JOIN part p USING (p_partkey))
SELECT p_partkey, round(least(greatest(CASE WHEN p_size % 2 = 0 THEN round((raw * 0.9){_D}, 1) ELSE raw{_D} END, 0), 20){_D}, 1)::DOUBLE AS score, "match" FROM v""")
def _(t: Tables):
    # Marks by the criterion's formula, a tenth less where a cited page did not confirm the claim.
    got = _matched(t).join(t.part.select("p_partkey", "p_size", "p_type"), "p_partkey")
    raw = F.when(F.col("match") == "none", 0.0).when(F.col("p_type") == "PROMO", S.per_unit_score(F.col("p_size"), F.lit(2.0), F.lit(None).cast("double"), F.lit(20))).otherwise(S.band_score(_bands(), F.col("p_size")))
    score = F.when(F.col("p_size") % 2 == 0, S.one_decimal(raw * 0.9)).otherwise(raw.cast("decimal(20,6)"))
    return got.select("p_partkey", S.clamp(score, F.lit(20)).cast("double").alias("score"), "match")


@R.query("m12_score_source", """SELECT p_partkey, coalesce(CASE WHEN p_size < 20 THEN CASE WHEN p_size < 10 THEN 5.0 ELSE 10.0 END END, CASE WHEN p_type = 'LARGE' THEN 20.0 END, CASE WHEN p_retailprice > 1000 THEN 12.0 END, 0.0)::DOUBLE AS score,
CASE WHEN p_size < 20 THEN 'bands' WHEN p_type = 'LARGE' THEN 'binary' WHEN p_retailprice > 1000 THEN 'external' ELSE 'none' END AS source FROM part""")
def _(t: Tables):
    candidates = {"bands": F.when(F.col("p_size") < 20, S.band_score(_bands(), F.col("p_size"))), "binary": F.when(F.col("p_type") == "LARGE", 20.0), "external": F.when(F.col("p_retailprice") > 1000, 12.0), "none": F.lit(0.0)}
    return t.part.select("p_partkey", F.coalesce(*candidates.values()).alias("score"), F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in candidates.items()]).alias("source"))


@R.query("m13_fact_score_notes", r"""
WITH q AS (SELECT o_orderkey, list_sort(list_distinct([year(o_orderdate)::INT, (year(o_orderdate) - o_orderkey % 2)::INT])) AS need, list_sort(list_distinct([1997, (1996 + o_orderkey % 4)::INT])) AS have FROM orders),
d AS (SELECT *, list_sort(list_filter(need, lambda x: NOT list_contains(have, x))) AS missing, list_sort(list_filter(have, lambda x: NOT list_contains(need, x))) AS extra FROM q)
SELECT o_orderkey, concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'missing ' || list_aggregate(list_transform(missing, lambda x: x::VARCHAR), 'string_agg', ',') END, CASE WHEN len(extra) > 0 THEN 'not asked ' || list_aggregate(list_transform(extra, lambda x: x::VARCHAR), 'string_agg', ',') END) AS note, CASE WHEN len(missing) = 0 THEN 10.0 ELSE 0.0 END::DOUBLE AS score FROM d""")
def _(t: Tables):
    year = F.year("o_orderdate")
    need, have = F.array_distinct(F.array(year, (year - F.col("o_orderkey") % 2).cast("int"))), F.array_distinct(F.array(F.lit(1997), (1996 + F.col("o_orderkey") % 4).cast("int")))
    missing, extra = F.array_sort(F.array_except(need, have)), F.array_sort(F.array_except(have, need))
    said = lambda word, years: F.when(F.size(years) > 0, F.concat(F.lit(word), F.array_join(years.cast("array<string>"), ",")))
    return t.orders.select("o_orderkey", F.concat_ws("; ", said("missing ", missing), said("not asked ", extra)).alias("note"), F.when(F.size(missing) == 0, 10.0).otherwise(0.0).alias("score"))


_TOTALS_SQL = f"""sums AS (SELECT evaluation_id, sum(CASE WHEN NOT is_sub_item AND score_state = 'scored' THEN max_marks ELSE 0 END) AS doc_max, round(coalesce(sum(CASE WHEN score_state = 'scored' THEN score END), 0){_D}, 1) AS total_score,
  sum(CASE WHEN score_state = 'comparative' THEN max_marks ELSE 0 END) AS comparative_marks, sum(CASE WHEN score_state = 'pending_live' THEN max_marks ELSE 0 END) AS live_marks FROM items GROUP BY evaluation_id),
totals AS (SELECT *, CASE WHEN doc_max > 0 THEN round((100 * total_score / doc_max){_D}, 1) ELSE 0 END AS percentage, round((0.7 * doc_max){_D}, 1) AS min_marks FROM sums)"""


def _plain(df):
    return df.select(*[F.col(c).cast("double").alias(c) if k.startswith("decimal") else F.col(c) for c, k in df.dtypes])


@R.query("m14_evaluation_totals", f"WITH {ITEMS_SQL}, {_TOTALS_SQL} SELECT evaluation_id, doc_max::BIGINT AS doc_max, total_score::DOUBLE AS total_score, percentage::DOUBLE AS percentage FROM totals")
def _(t: Tables):
    return _plain(S.totals(items(t)).select("evaluation_id", "doc_max", "total_score", "percentage"))


@R.query("m15_comparative_excluded", f"WITH {ITEMS_SQL}, {_TOTALS_SQL} SELECT evaluation_id, comparative_marks::BIGINT AS comparative_marks, live_marks::BIGINT AS live_marks, total_score::DOUBLE AS total_score FROM totals")
def _(t: Tables):
    return _plain(S.totals(items(t)).select("evaluation_id", "comparative_marks", "live_marks", "total_score"))


@R.query("m16_gate", f"WITH {ITEMS_SQL}, {_TOTALS_SQL} SELECT evaluation_id, min_marks::DOUBLE AS min_marks, total_score >= min_marks AS passed FROM totals")
def _(t: Tables):
    return _plain(S.totals(items(t)).select("evaluation_id", "min_marks", "passed"))


@R.query("m17_override", f"""WITH {ITEMS_SQL}, ov AS (SELECT evaluation_id, item_seq, (score + 10)::DECIMAL(10,1) AS score, ts FROM items WHERE item_seq % 3 = 0), ok AS (SELECT o.* FROM ov o JOIN items USING (evaluation_id, item_seq) WHERE o.score BETWEEN 0 AND max_marks),
ch AS (SELECT i.* EXCLUDE (score, score_state), coalesce(o.score, i.score) AS score, CASE WHEN o.score IS NOT NULL THEN 'scored' ELSE i.score_state END AS score_state FROM items i LEFT JOIN ok o USING (evaluation_id, item_seq)),
x AS (SELECT evaluation_id, sum(CASE WHEN NOT is_sub_item AND score_state = 'scored' THEN max_marks ELSE 0 END)::BIGINT AS doc_max, round(coalesce(sum(CASE WHEN score_state = 'scored' THEN score END), 0){_D}, 1)::DOUBLE AS total_score FROM ch GROUP BY evaluation_id) SELECT * FROM x""")
def _(t: Tables):
    rows = items(t)
    overrides = rows.where("item_seq % 3 = 0").select("evaluation_id", "item_seq", (F.col("score") + 10).cast("decimal(10,1)").alias("score"), "ts")
    return _plain(S.totals(S.overridden(rows, overrides)).select("evaluation_id", "doc_max", "total_score"))


_WORDS = ["large", "red"]
_GAPS_SQL = f"""lv AS (SELECT *, round((max_marks - score){_D}, 1) AS marks_lost FROM items WHERE score IS NOT NULL),
ty AS (SELECT *, CASE WHEN NOT evidence_found THEN 'missing_evidence' WHEN NOT verified THEN 'unverified' ELSE 'partial' END AS gap_type, contains(lower(parameter), 'large') OR contains(lower(parameter), 'red') AS rests FROM lv WHERE marks_lost > 0),
df AS (SELECT *, CASE WHEN rests AND gap_type = 'missing_evidence' THEN 'hard' WHEN rests THEN 'medium' WHEN gap_type = 'unverified' THEN 'easy' WHEN gap_type = 'partial' AND marks_lost <= 5 THEN 'easy' ELSE 'medium' END AS difficulty FROM ty),
pr AS (SELECT *, round((marks_lost * CASE difficulty WHEN 'easy' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.25 END){_D}, 2) AS priority FROM df),
gaps AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY priority DESC, item_seq)::INT AS rank FROM pr),
ev AS (SELECT evaluation_id, round(sum(score){_D}, 1) AS total_scored, sum(max_marks) AS doc_max, round((0.7 * sum(max_marks)){_D}, 1) AS min_required FROM lv GROUP BY evaluation_id),
gs AS (SELECT evaluation_id, count(*) AS n_gaps, sum(CASE WHEN difficulty = 'easy' THEN marks_lost ELSE 0 END) AS recoverable, min_by(parameter, rank) AS wp, min(CASE WHEN rank = 1 THEN marks_lost END) AS wl FROM gaps GROUP BY evaluation_id),
rk AS (SELECT *, min_required - total_scored AS deficit, CASE WHEN total_scored >= min_required THEN CASE WHEN total_scored >= min_required * 1.15 THEN 'safe' ELSE 'marginal' END WHEN min_required - total_scored <= 10 THEN 'at_risk' ELSE 'failed' END AS risk FROM ev LEFT JOIN gs USING (evaluation_id))"""


@R.query("q1_leaves", f"WITH {ITEMS_SQL} SELECT evaluation_id, item_seq FROM items WHERE score IS NOT NULL AND extracted_value <> 'Sum of sub-criteria'")
def _(t: Tables):
    return gaps.leaves(items(t)).select("evaluation_id", "item_seq")


@R.query("q2_gap_type", f"WITH {ITEMS_SQL}, {_GAPS_SQL} SELECT evaluation_id, item_seq, gap_type FROM gaps")
def _(t: Tables):
    return gaps.gap_rows(items(t), experience=_WORDS).select("evaluation_id", "item_seq", "gap_type")


@R.query("q3_difficulty", f"WITH {ITEMS_SQL}, {_GAPS_SQL} SELECT evaluation_id, item_seq, difficulty FROM gaps")
def _(t: Tables):
    return gaps.gap_rows(items(t), experience=_WORDS).select("evaluation_id", "item_seq", "difficulty")


@R.query("q4_priorities", f"WITH {ITEMS_SQL}, {_GAPS_SQL} SELECT evaluation_id, item_seq, priority::DOUBLE AS priority, rank FROM gaps WHERE rank <= 3")
def _(t: Tables):
    return gaps.gap_rows(items(t), experience=_WORDS).where("rank <= 3").select("evaluation_id", "item_seq", F.col("priority").cast("double").alias("priority"), "rank")


@R.query("q5_risk", f"WITH {ITEMS_SQL}, {_GAPS_SQL} SELECT evaluation_id, deficit::DOUBLE AS deficit, coalesce(recoverable, 0)::DOUBLE AS recoverable, risk FROM rk")
def _(t: Tables):
    return _plain(gaps.gap_summary(items(t), experience=_WORDS).select("evaluation_id", "deficit", "recoverable", "risk"))


SUMMARY_SQL = f"""concat_ws(' ', 'Scored ' || printf('%.1f', total_scored::DOUBLE) || '/' || doc_max || ' (' || printf('%.1f', round((100 * total_scored / doc_max){_D}, 1)::DOUBLE) || '%).',
  CASE risk WHEN 'safe' THEN 'Qualifies with room.' WHEN 'marginal' THEN 'Qualifies narrowly.' WHEN 'at_risk' THEN 'At risk, short by ' || printf('%.1f', deficit::DOUBLE) || '.' ELSE 'Fails, short by ' || printf('%.1f', deficit::DOUBLE) || '.' END,
  CASE WHEN recoverable > 0 THEN printf('%.1f', recoverable::DOUBLE) || ' marks easily won.' END, CASE WHEN wp IS NOT NULL THEN 'Largest gap: ' || wp || ' (' || printf('%.1f', wl::DOUBLE) || '/50).' END)"""
#: The same with the operator's own words of experience, of which no part's name has one.
PLAIN_GAPS_SQL = _GAPS_SQL.replace("contains(lower(parameter), 'large') OR contains(lower(parameter), 'red')", "regexp_matches(lower(parameter), 'experience|turnover|years|tsa|ddu')")


@R.query("q6_summary", f"WITH {ITEMS_SQL}, {_GAPS_SQL} SELECT evaluation_id, {SUMMARY_SQL} AS summary FROM rk")
def _(t: Tables):
    return gaps.gap_summary(items(t), experience=_WORDS).select("evaluation_id", "summary")


QUERIES, ORACLE = R.queries, R.oracle
