"""Feedback and learning queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import feedback as B
from dossier.plans.bindings import CLAUSES, FEEDBACK_SQL, feedback
from dossier.plans.registry import Registry, Tables

R = Registry()
_KEY = "doc, clause_type, user_id"
_KEPT_SQL = f"{FEEDBACK_SQL}, kept AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY created_at DESC, id DESC) AS k FROM feedback) WHERE k = 1)"
_MEETS = "(o = '' OR contains(ro, o) OR contains(o, ro)) AND (s = '' OR contains(rs, s) OR contains(s, rs))"
# Targets: customers' nations and regions, one for each clause type; every fifth has a shortened name.
_TARGETS_SQL = f"""types(clause_type) AS (VALUES {", ".join(f"('{c}')" for c in CLAUSES)}),
targets AS (SELECT clause_type, CASE WHEN n_nationkey % 5 = 0 THEN left(n_name, 8) ELSE n_name END AS offering, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE r_name END AS solution, CASE WHEN n_nationkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS system_level FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN types)"""
_ADJ_SQL = f"""{_KEPT_SQL}, {_TARGETS_SQL},
met AS (SELECT t.clause_type, t.offering, t.solution, f.id, f.agreement, f.suggested_level FROM (SELECT DISTINCT clause_type, offering, solution, upper(trim(offering)) AS o, upper(trim(solution)) AS s FROM targets) t JOIN (SELECT *, upper(trim(offering)) AS ro, upper(trim(solution)) AS rs FROM kept) f ON t.clause_type = f.clause_type AND {_MEETS}),
cn AS (SELECT clause_type, offering, solution, count(*) AS feedback_count, avg((agreement = 'too_high')::INT) AS high, avg((agreement = 'too_low')::INT) AS low FROM met GROUP BY ALL),
lv AS (SELECT clause_type, offering, solution, suggested_level, count(*) AS n, min(id) AS f FROM met WHERE suggested_level IS NOT NULL GROUP BY ALL),
tp AS (SELECT clause_type, offering, solution, min_by(suggested_level, (-n, f)) AS top_suggested FROM lv GROUP BY ALL),
dr AS (SELECT t.*, coalesce(feedback_count, 0) AS feedback_count, top_suggested, CASE WHEN high >= 0.25 THEN 'LOWER' WHEN low >= 0.25 THEN 'HIGHER' ELSE 'NONE' END AS direction FROM targets t LEFT JOIN cn USING (clause_type, offering, solution) LEFT JOIN tp USING (clause_type, offering, solution)),
adj AS (SELECT *, CASE direction WHEN 'LOWER' THEN coalesce(top_suggested, CASE system_level WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END) WHEN 'HIGHER' THEN coalesce(top_suggested, 'HIGH') ELSE system_level END AS adjusted_level FROM dr)"""


def _kept(t: Tables):
    return B.submitted(feedback(t), CLAUSES)


def _targets(t: Tables):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.explode(F.array(*[F.lit(c) for c in CLAUSES])).alias("clause_type"), F.when(F.col("n_nationkey") % 5 == 0, F.substring("n_name", 1, 8)).otherwise(F.col("n_name")).alias("offering"),
        F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.col("r_name")).alias("solution"), F.when(F.col("n_nationkey") % 3 == 0, "HIGH").otherwise("MEDIUM").alias("system_level"))


@R.query("b1_upsert", f"WITH {_KEPT_SQL} SELECT {_KEY}, id, agreement FROM kept")
def _(t: Tables):
    return _kept(t).select("doc", "clause_type", "user_id", "id", "agreement")


@R.query("b2_context_match", f"""WITH {FEEDBACK_SQL}, {_TARGETS_SQL}, a AS (SELECT DISTINCT upper(trim(offering)) AS ro, upper(trim(solution)) AS rs FROM feedback), b AS (SELECT DISTINCT upper(trim(offering)) AS o, upper(trim(solution)) AS s FROM targets)
SELECT ro AS row_offering, rs AS row_solution, o AS offering, s AS solution FROM a JOIN b ON {_MEETS}""")
def _(t: Tables):
    return B.context_pairs(feedback(t), _targets(t))


@R.query("b3_consensus", f"WITH {_ADJ_SQL} SELECT clause_type, offering, solution, feedback_count, direction, top_suggested, adjusted_level, adjusted_level <> system_level AS applied FROM adj")
def _(t: Tables):
    return B.adjustments(_kept(t), _targets(t), share=0.25).select("clause_type", "offering", "solution", "feedback_count", "direction", "top_suggested", "adjusted_level", "applied")


_INSIGHT_SQL = f"""{_KEPT_SQL}, g AS (SELECT user_id, clause_type, count(*) AS feedback_count, {", ".join(f"round(avg((agreement = '{a}')::INT), 2) AS {a}" for a in B.AGREEMENTS)} FROM kept GROUP BY ALL),
sy AS (SELECT user_id, clause_type, min_by(system_level, (-n, f)) AS typical_level FROM (SELECT user_id, clause_type, system_level, count(*) AS n, min(id) AS f FROM kept WHERE system_level IS NOT NULL GROUP BY ALL) GROUP BY ALL),
su AS (SELECT user_id, clause_type, min_by(suggested_level, (-n, f)) AS top_suggested FROM (SELECT user_id, clause_type, suggested_level, count(*) AS n, min(id) AS f FROM kept WHERE suggested_level IS NOT NULL GROUP BY ALL) GROUP BY ALL),
insights AS (SELECT *, recommendation <> 'mixed' AS strong FROM (SELECT g.*, coalesce(typical_level, 'UNKNOWN') AS typical_level, top_suggested, CASE WHEN too_high >= 0.5 THEN 'lower' WHEN too_low >= 0.5 THEN 'raise' WHEN agree >= 0.5 THEN 'keep' ELSE 'mixed' END AS recommendation FROM g LEFT JOIN sy USING (user_id, clause_type) LEFT JOIN su USING (user_id, clause_type)))"""


def _insights(t: Tables):
    return B.insights(_kept(t), ["user_id", "clause_type"])


@R.query("b4_insights", f"WITH {_INSIGHT_SQL} SELECT user_id, clause_type, feedback_count, agree, too_high, too_low, incorrect, typical_level, top_suggested, recommendation, strong FROM insights")
def _(t: Tables):
    return _insights(t)


_RESULTS_SQL = f"results AS (SELECT c_custkey AS doc, t.clause_type, t.offering, t.solution, t.system_level FROM customer JOIN targets t ON ('NATION_' || c_nationkey) = t.offering AND t.clause_type IN ('ld', 'scope'))"


def _results(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("doc"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("offering")).join(_targets(t).where("clause_type in ('ld', 'scope')"), "offering")


@R.query("b5_recompute", f"WITH {_ADJ_SQL}, {_RESULTS_SQL} SELECT doc, r.clause_type, a.direction, CASE WHEN a.adjusted_level <> system_level THEN a.adjusted_level END AS adjusted_level FROM results r JOIN (SELECT DISTINCT clause_type, offering, solution, system_level, direction, adjusted_level FROM adj) a USING (clause_type, offering, solution, system_level)")
def _(t: Tables):
    return B.adjustments(_kept(t), _results(t), share=0.25).select("doc", "clause_type", "direction", F.when(F.col("applied"), F.col("adjusted_level")).alias("adjusted_level"))


@R.query("b6_effective_level", f"WITH {FEEDBACK_SQL} SELECT id, coalesce(suggested_level, system_level) AS level FROM feedback")
def _(t: Tables):
    return feedback(t).select("id", F.coalesce("suggested_level", "system_level").alias("level"))


@R.query("b7_clause_breakdown", f"WITH {_KEPT_SQL} SELECT clause_type, agreement, count(*) AS n, max_by(id, (created_at, id)) AS last_id FROM kept GROUP BY ALL")
def _(t: Tables):
    return _kept(t).groupBy("clause_type", "agreement").agg(F.count("*").alias("n"), F.max_by("id", F.struct("created_at", "id")).alias("last_id"))


@R.query("b8_review_status", f"""WITH {_KEPT_SQL}, d AS (SELECT doc, list_sort(list_distinct(list(clause_type))) AS done, {", ".join(f"count(*) FILTER (agreement = '{a}') AS n_{a}" for a in B.AGREEMENTS)} FROM kept GROUP BY doc)
SELECT doc, array_to_string(done, ',') AS done, array_to_string(list_filter({CLAUSES}, lambda c: NOT list_contains(done, c)), ',') AS pending, n_agree, n_too_high, n_too_low, n_incorrect FROM d""")
def _(t: Tables):
    got = B.review_status(_kept(t), CLAUSES)
    return got.withColumns({c: F.array_join(c, ",") for c in ("done", "pending")})


@R.query("b9_headline", f"WITH {_INSIGHT_SQL} SELECT (SELECT count(*) FROM kept) AS total, (SELECT count(*) FROM insights WHERE strong) AS strong_groups, (SELECT count(*) FROM kept WHERE agreement <> 'agree' AND length(trim(comment)) > 0) AS examples")
def _(t: Tables):
    kept = _kept(t)
    examples = F.count_if((F.col("agreement") != "agree") & (F.length(F.trim("comment")) > 0))
    return kept.agg(F.count("*").alias("total"), examples.alias("examples")).crossJoin(B.insights(kept, ["user_id", "clause_type"]).agg(F.count_if("strong").alias("strong_groups")))


@R.query("b10_log", f"WITH {FEEDBACK_SQL} SELECT id, created_at, comment FROM feedback WHERE comment ILIKE '%NUMBER 1%' AND clause_type = 'ld' ORDER BY created_at DESC, id DESC LIMIT 50")
def _(t: Tables):
    return feedback(t).where(F.ilike("comment", F.lit("%NUMBER 1%")) & (F.col("clause_type") == "ld")).orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "created_at", "comment")


_SNIPPETS_SQL = "snip AS (SELECT doc_id AS doc, lang, text AS clause_text FROM documents)"


def _new_examples(t: Tables):
    kept = _kept(t)
    existing = kept.where("id % 4 = 0").select(F.col("id").alias("feedback_id"))
    snippets = t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("ld"), F.lit("scope"))).alias("clause_type"), F.col("text").alias("clause_text"))
    return B.learning_examples(kept, existing, snippets)


@R.query("b11_promote", f"""WITH {_KEPT_SQL}, {_SNIPPETS_SQL} SELECT id AS feedback_id, k.doc, clause_type, suggested_level AS correct_level, comment AS reason, CASE WHEN clause_type IN ('ld', 'scope') THEN coalesce(left(clause_text, 300), '') ELSE '' END AS snippet
FROM kept k LEFT JOIN snip USING (doc) WHERE agreement <> 'agree' AND length(trim(comment)) > 0 AND id % 4 <> 0""")
def _(t: Tables):
    return _new_examples(t).select("feedback_id", "doc", "clause_type", "correct_level", "reason", "snippet")


@R.query("b12_few_shot", f"""WITH {FEEDBACK_SQL}, a AS (SELECT {CLAUSES}[(doc_id % 10 + 1)::INT] AS clause_type, 0 AS kind, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY quality DESC, doc_id DESC) AS k, 'document ' || doc_id AS line FROM labels WHERE toxic = 0),
b AS (SELECT clause_type, 1 AS kind, row_number() OVER (PARTITION BY clause_type ORDER BY created_at DESC, id DESC) AS k, comment AS line FROM feedback WHERE agreement <> 'agree' AND comment IS NOT NULL),
u AS (SELECT * FROM a WHERE k <= 4 UNION ALL SELECT * FROM b WHERE k <= 30 AND length(trim(line)) > 10), r AS (SELECT *, count(*) OVER (PARTITION BY clause_type) AS n, row_number() OVER (PARTITION BY clause_type ORDER BY kind, k) AS at_ FROM u)
SELECT clause_type, string_agg(at_ || '. ' || line, chr(10) ORDER BY at_) AS block, count(*) AS used FROM r WHERE n >= 2 AND at_ <= 4 GROUP BY clause_type""")
def _(t: Tables):
    kind = F.element_at(F.array(*[F.lit(c) for c in CLAUSES]), (F.col("doc_id") % 10 + 1).cast("int"))
    examples = t.labels.where("toxic = 0").select(kind.alias("clause_type"), F.col("doc_id").alias("example_id"), F.col("quality").alias("usefulness"), F.col("doc_id").alias("created_at"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("line"))
    return B.few_shot(examples, feedback(t))


@R.query("b13_digest", f"""WITH {FEEDBACK_SQL}, l AS (SELECT user_id, clause_type, created_at, id, concat_ws(' | ', agreement, concat_ws('->', system_level, suggested_level), comment) AS line, count(*) OVER (PARTITION BY user_id, clause_type) AS n FROM feedback),
s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY user_id, clause_type ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS p FROM l WHERE n >= 5),
d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, clause_type ORDER BY p) AS part FROM s)
SELECT user_id, clause_type, n, part, max(max(part)) OVER (PARTITION BY user_id, clause_type) AS n_parts, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY created_at, id) AS digest FROM d GROUP BY user_id, clause_type, n, part""")
def _(t: Tables):
    return B.digest(feedback(t), ["user_id", "clause_type"])


@R.query("b14_rule_upsert", """WITH cur AS (SELECT n_name AS offering, 'old ' || n_nationkey AS rule_text, n_regionkey AS rev FROM nation WHERE n_nationkey < 20), new AS (SELECT n_name AS offering, 'new ' || n_nationkey AS rule_text, NULL::INT AS rev FROM nation WHERE n_nationkey >= 10)
SELECT offering, coalesce(new.rule_text, cur.rule_text) AS rule_text, coalesce(new.rev, cur.rev) AS rev FROM cur FULL JOIN new USING (offering)""")
def _(t: Tables):
    rule = lambda word, rev: t.nation.select(F.col("n_nationkey"), F.col("n_name").alias("offering"), F.concat(F.lit(word), F.col("n_nationkey").cast("string")).alias("rule_text"), rev.alias("rev"))
    return B.merged(rule("old ", F.col("n_regionkey")).where("n_nationkey < 20").drop("n_nationkey"), rule("new ", F.lit(None).cast("int")).where("n_nationkey >= 10").drop("n_nationkey"), ["offering"])


_RULES_SQL = "rules AS (SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 2 = 0 THEN 'ld' ELSE 'scope' END AS clause_type, 'NATION_' || c_nationkey AS offering, '' AS solution, c_mktsegment AS rule_text, c_acctbal > 5000 AS active FROM customer)"


def _rules(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("rule_id"), F.when(F.col("c_custkey") % 2 == 0, "ld").otherwise("scope").alias("clause_type"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("offering"), F.lit("").alias("solution"), F.col("c_mktsegment").alias("rule_text"), (F.col("c_acctbal") > 5000).alias("active"))


@R.query("b15_learned_rule", f"""WITH {_TARGETS_SQL}, {_RULES_SQL}, m AS (SELECT t.clause_type, t.offering, t.solution, min(rule_id) AS rule_id FROM (SELECT *, upper(trim(offering)) AS o FROM targets) t LEFT JOIN (SELECT *, upper(trim(offering)) AS ro FROM rules WHERE active) r ON t.clause_type = r.clause_type AND (o = '' OR contains(ro, o) OR contains(o, ro)) GROUP BY ALL)
SELECT clause_type, offering, solution, m.rule_id, rule_text FROM targets JOIN m USING (clause_type, offering, solution) LEFT JOIN (SELECT rule_id, rule_text FROM rules) r ON m.rule_id = r.rule_id""")
def _(t: Tables):
    return B.learned_rule(_rules(t), _targets(t))


@R.query("b16_rule_edits", f"WITH {_RULES_SQL}, p AS (SELECT c_custkey AS rule_id, c_acctbal < 0 AS active FROM customer WHERE c_custkey % 3 = 0) SELECT rule_id, coalesce(p.active, rules.active) AS active FROM rules LEFT JOIN p USING (rule_id)")
def _(t: Tables):
    patch = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("rule_id"), (F.col("c_acctbal") < 0).alias("active"))
    return B.merged(_rules(t).select("rule_id", "active"), patch, ["rule_id"])


@R.query("b17_cascade", f"WITH {_KEPT_SQL}, e AS (SELECT id FROM kept WHERE comment IS NOT NULL) SELECT (SELECT count(*) FROM kept WHERE doc >= 10) AS feedback_left, (SELECT count(*) FROM e JOIN kept USING (id) WHERE doc >= 10) AS examples_left")
def _(t: Tables):
    kept = _kept(t)
    gone = kept.where("doc < 10").select("id")
    rows, examples = B.without(kept, kept.where("comment is not null").select(F.col("id").alias("feedback_id")), gone, "id", "feedback_id")
    return rows.agg(F.count("*").alias("feedback_left")).crossJoin(examples.agg(F.count("*").alias("examples_left")))


@R.query("b18_comments", f"WITH {FEEDBACK_SQL} SELECT doc, id, c_name AS author, comment, row_number() OVER (PARTITION BY doc ORDER BY created_at, id)::INT AS position FROM feedback LEFT JOIN customer ON user_id = c_custkey WHERE comment IS NOT NULL")
def _(t: Tables):
    from pyspark.sql.window import Window as W

    rows = feedback(t).where("comment is not null").join(t.customer, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select("doc", "id", F.col("c_name").alias("author"), "comment", F.row_number().over(W.partitionBy("doc").orderBy("created_at", "id")).alias("position"))


@R.query("b19_document_list", """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS primary_offering, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS n_offerings FROM orders""")
def _(t: Tables):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.array("o_orderpriority", "o_orderstatus"))).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus"))
    got = t.orders.select(F.col("o_orderkey").alias("doc"), B.as_list(raw).alias("offerings"))
    return got.select("doc", F.get("offerings", F.lit(0)).alias("primary_offering"), F.size("offerings").alias("n_offerings"))


@R.query("b20_latest_evaluation", "SELECT o_custkey AS doc, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS evaluation_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def _(t: Tables):
    return t.orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("doc")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("evaluation_id"), F.count("*").alias("n"))


@R.query("b21_field_union", "SELECT p_partkey, array_to_string(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END, ',') || ',' || p_name AS offerings FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.array_join(B.first_distinct(F.array("p_type", "p_brand"), F.array("p_type", "p_name")), ",").alias("offerings"))


@R.query("b22_document_patch", "SELECT c_custkey AS doc, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'completed' ELSE c_mktsegment END AS status FROM customer")
def _(t: Tables):
    now = t.customer.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    patch = now.where("doc % 2 = 0").select("doc", F.upper("name").alias("name"), F.when(F.col("doc") % 3 == 0, "completed").alias("status"))
    return B.merged(now, patch, ["doc"])


@R.query("b23_score_decode", "SELECT l_orderkey AS evaluation_id, count(*) AS n, sum(CASE WHEN l_quantity > 2 THEN l_quantity END)::DOUBLE AS total, count(*) FILTER (l_quantity <= 1) AS pending, count(*) FILTER (l_quantity > 1 AND l_quantity <= 2) AS comparative FROM lineitem GROUP BY ALL")
def _(t: Tables):
    # Scores stored as text, "-1" for pending and "-2" for comparative, read back as numbers and states.
    raw = F.when(F.col("l_quantity") <= 1, "-1").when(F.col("l_quantity") <= 2, "-2").otherwise(F.col("l_quantity").cast("string"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("evaluation_id"), raw.alias("raw")).withColumns({"score": F.when(~F.col("raw").isin("-1", "-2"), F.col("raw").cast("double")), "state": F.when(F.col("raw") == "-1", "pending").when(F.col("raw") == "-2", "comparative").otherwise("scored")})
    return rows.groupBy("evaluation_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "comparative").alias("comparative"))


QUERIES, ORACLE = R.queries, R.oracle
