"""Operators on small frames with known results, edges included."""

from pyspark.sql import functions as F

from dossier.operators import batches, chunking, claims, criteria, feedback, gaps, graph, pages, retrieval, risk, scoring
from dossier.sources import tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


def test_bands_at_their_edges(spark):
    bands = F.array(*[F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.lit(s).cast("double").alias("score")) for lo, hi, s in ((0, 10, 5), (10, 25, 10), (25, None, 15))])
    for boundary, expected in (("half_open", [5, 10, 15, 15]), ("inclusive", [5, 5, 10, 15]), ("upper", [5, 5, 10, 15])):
        got = [one(spark, scoring.band_score(bands, F.col("v"), boundary), v=float(v)) for v in (9, 10, 25, 99)]
        assert got == expected
    assert one(spark, scoring.band_score(bands, F.col("v")), v=-1.0) is None


def test_steps_clamps_and_flags(spark):
    args = [F.lit(x) for x in (50, 5, 10, 1, 20)]
    assert [one(spark, scoring.step_score(F.col("v"), *args), v=v) for v in (49.0, 50.0, 79.0, 999.0)] == [0, 5, 7, 20]
    assert [float(one(spark, scoring.clamp(F.col("v"), F.lit(10)), v=v)) for v in (-1.0, 2.25, 11.0)] == [0, 2.3, 10]
    score, found, missing = scoring.qual_score({n: F.lit(n == "cvs_attached") for n in scoring.QUAL_WEIGHTS}, F.lit(20))
    assert float(one(spark, score)) == 3.0 and one(spark, found) == ["cvs_attached"] and len(one(spark, missing)) == 4
    assert one(spark, scoring.binary_score(F.lit(True), F.col("v"), F.lit(4)), v=" None ") == 0
    assert one(spark, scoring.cv_score(F.lit("medium"), F.lit(5))) == 4.0


def test_gap_analysis_of_one_evaluation(spark):
    rows = [(1, 1, "Turnover", 20, "15", True, True), (1, 2, "Past experience", 30, "0", False, False), (1, 3, "Team", 20, "17", True, True), (1, 4, "Approach", 20, "12", True, False), (1, 5, "Tools", 10, "10", True, None)]
    items = spark.createDataFrame(rows, "evaluation_id int, item_seq int, parameter string, max_marks int, score string, evidence_found boolean, verified boolean").withColumns({"score": F.col("score").cast("decimal(10,1)"), "is_parent": F.lit(False), "evaluation_layer": F.lit("document"), "extracted_value": F.lit(None).cast("string")})
    got = {r["parameter"]: (r["gap_type"], r["difficulty"], r["rank"]) for r in gaps.gap_rows(items).collect()}
    assert got == {"Turnover": ("partial", "medium", 4), "Past experience": ("missing_evidence", "hard", 2), "Team": ("partial", "easy", 3), "Approach": ("unverified", "easy", 1)}
    summary = gaps.gap_summary(items).first()
    assert (float(summary["deficit"]), summary["risk"], float(summary["recoverable"])) == (16.0, "failed", 11.0)


def test_matching_falls_back_from_code_to_prefix_to_name(spark):
    crit = spark.createDataFrame([("d", "4", "x"), ("d", "5a", "x"), ("d", "9", "average annual turnover"), ("d", "8", "nothing alike")], "doc string, item_code string, parameter string")
    rows = spark.createDataFrame([("d", "4", "q"), ("d", "5", "q"), ("d", "7", "annual turnover last years")], "doc string, item_code string, parameter string")
    assert {r["item_code"]: (r["row_code"], r["match"]) for r in scoring.matched_rows(crit, rows).collect()} == {"4": ("4", "code"), "5a": ("5", "prefix"), "9": ("7", "name"), "8": (None, "none")}


def test_hierarchy_orders_codes_and_makes_parents(spark):
    rows = [("d", "3(a)", "Team leader", 10), ("d", "3(b)", "Expert", 15), ("d", "10", "Approach", 20), ("d", "2", "Turnover", 30), ("d", "2a", "Net worth", 5)]
    frame = spark.createDataFrame(rows, "doc string, item_code string, parameter string, max_marks int")
    order = [r["item_code"] for r in criteria.in_code_order(frame).orderBy("position").collect()]
    assert order == ["2", "2a", "3(a)", "3(b)", "10"]
    tree = criteria.with_hierarchy(frame.withColumn("criteria_text", F.lit(""))).collect()
    made = next(r for r in tree if r["synthetic"])
    assert (made["item_code"], made["parameter"], made["max_marks"]) == ("3", "Team", 25)
    assert sum(r["max_marks"] for r in tree if not r["is_sub_item"]) == 75


def test_risk_rules(spark):
    rows = [("liability", "Liability is unlimited", "contract value"), ("liability", "capped", "2x contract"), ("liability", "capped", "contract value"), ("liability", "", None), ("ld", "cap", "15 %"), ("ld", "cap", "10%"), ("ld", "cap", None), ("mystery", "", None)]
    got = risk.assessed(spark.createDataFrame([(a, b, c, c) for a, b, c in rows], "clause_type string, clause_text string, cap_info string, ld_cap_text string")).collect()
    assert [r["risk_level"] for r in got] == ["HIGH", "HIGH", "ACCEPTABLE", "NEEDS_REVIEW", "MEDIUM", "ACCEPTABLE", "NEEDS_REVIEW", "NEEDS_REVIEW"]


def test_consensus_ties_and_blank_contexts(spark):
    fb = spark.createDataFrame([(1, "ld", "Energy", "", "too_high", "LOW"), (2, "ld", "ENERGY & gas", "Wind", "too_low", "MEDIUM")], "id int, clause_type string, offering string, solution string, agreement string, suggested_level string")
    targets = spark.createDataFrame([("ld", "energy", "wind", "HIGH"), ("ld", "water", "wind", "HIGH")], "clause_type string, offering string, solution string, system_level string")
    got = {r["offering"]: r for r in feedback.adjustments(fb, targets).collect()}
    assert (got["energy"]["direction"], got["energy"]["adjusted_level"], got["energy"]["feedback_count"]) == ("LOWER", "LOW", 2)
    assert (got["water"]["direction"], got["water"]["applied"], got["water"]["feedback_count"]) == ("NONE", False, 0)


def test_capped_chunks_restart_after_each_flush(spark):
    lines = spark.createDataFrame([("d", i, "x" * 6) for i in range(5)], "doc string, line_no int, text string")
    assert [r["text"] for r in chunking.capped_chunks(lines, ["doc"], 10).orderBy("chunk_no").collect()] == ["xxxxxx\nxxx", "xxxxxx\nxxx", "xxxxxx"]


def test_headings_and_references(spark):
    assert [one(spark, chunking.is_heading(F.col("t")), t=t) for t in ("4.1 Scope", "SCOPE OF WORK", "the scope", "x" * 300, "")] == [True, True, False, False, False]
    assert one(spark, chunking.clause_reference(F.col("t")), t="see Clause 7.2 on") == "Clause 7.2"


def test_bands_from_text(spark):
    frame = spark.createDataFrame([("d", "100 to 200 Crs: 5 marks; more than 200: 10 marks; 200+: 9 marks; 1,000+ : 12 marks")], "doc string, criteria_text string")
    assert sorted((r["lo"], r["hi"], r["score"]) for r in criteria.parsed_bands(frame, ["doc"]).collect()) == [(100, 200, 5), (200, None, 10), (1000, None, 12)]


def test_facts_and_guards(spark):
    assert one(spark, claims.fact(F.col("r"), F.lit("annual turnover")), r="average annual turnover of Rs 250 lakh")["value"] == 2.5
    assert one(spark, claims.fact(F.col("r"), F.lit("years of experience")), r="established in 1999")["value"] == 25
    assert one(spark, claims.fact(F.col("r"), F.lit("projects")), r="5 marks for each project, maximum marks 20") is None
    assert one(spark, claims.guarded(F.col("v"), F.lit(True), F.lit("turnover"), F.lit("BAND")), v="20 marks") is None
    assert one(spark, claims.cited_pages(F.col("t")), t="pages 12-14, p. 3 and pg. 12") == [3, 12]


def test_facts_by_their_words(spark):
    said = {
        ("annual turnover", "Rs. 1,250.5 Cr in all"): ("turnover", 1250.5, "amount in rupees"),
        ("similar projects", "handled 12 large scale projects"): ("projects", 12, "handled projects"),
        ("similar projects", "enclosed details of 4 such projects"): ("projects", 4, "enclosed projects"),
        ("similar projects", "9 assignments have been completed"): ("projects", 9, "completed projects"),
        ("similar projects", "as below\n1. Roads\n2. Ports\n3. Rail"): ("projects", 3, "numbered list"),
        ("similar projects", "handled 120 projects"): None,
        ("staff on rolls", "1,200+ technically qualified people"): ("staff", 1200, "technically qualified"),
        ("staff on rolls", "a payroll of 300"): ("staff", 300, "payroll"),
        ("years since", "12+ years of relevant experience"): ("years", 12, "years of experience"),
        ("years since", "working since 2004"): ("years", 20, "since"),
        ("registration", "Yes"): ("present", 1, "stated"),
        ("registration", "no"): None,
    }
    for (criterion, response), expected in said.items():
        got = one(spark, claims.fact(F.col("r"), F.col("c")), r=response, c=criterion)
        assert (tuple(got) if got else None) == expected, response
    assert one(spark, claims.fact(F.col("r"), F.lit("turnover")), r=None) is None


def test_claims_by_family(spark):
    said = {
        ("Financial strength", "BAND", "average 480.23 crores over 3 years"): ("turnover", 480.23),
        ("Experience in the area", "STEP", "Plan, Mar 2016 to Jan 2018; Roads, June 2012 to till date; 1999 to date"): ("years", 12),
        ("Handling of projects", "LLM", "details of the following 5 such assignments"): ("projects", 5),
        ("Handling of projects", "LLM", "1 State Technical unit\n2 Technical Support cell\nnone"): ("projects", 2),
        ("Manpower", "LLM", "more than 1,500 technically qualified personnel"): ("staff", 1500),
        ("Manpower", "LLM", "more than 80 on the payroll"): ("staff", 80),
        ("Registration", "BINARY", "We have a work order"): ("present", 1),
        ("Tools", "PER_UNIT", "there are 7.5 of them"): ("number", 7.5),
        ("Tools", "QUAL", "there are 7.5 of them"): None,
        ("Turnover", "LLM", None): None,
    }
    for (parameter, formula, block), expected in said.items():
        got = one(spark, claims.claimed(F.col("p"), F.col("f"), F.col("b")), p=parameter, f=formula, b=block)
        assert (tuple(got) if got else None) == expected, block


def test_formulas_and_comparisons_by_their_words(spark):
    texts = {"every additional 5 Cr": "STEP", "For turnover of\n2 Cr and more than that": "STEP", "20 professionals or 40 professionals": "BAND", "2 marks for each assignment": "PER_UNIT", "CV of the leader": "QUAL", "ISO 9001": "BINARY", "Startup India": "BINARY", "a good plan": "LLM"}
    assert {t: one(spark, criteria.formula_type(F.lit("x"), F.col("t")), t=t) for t in texts} == texts
    rows = [("a", "x", "SF = 100 x FM / F"), ("b", "x", "highest number of staff gets the maximum score"), ("c", "x", "combined technical and financial score"), ("d", "x", "Quality and Cost Based Selection"), ("e", "x", "nothing"), ("e", "Work plan", None)]
    got = criteria.comparative(spark.createDataFrame(rows, "doc string, parameter string, criteria_text string"))
    assert sorted((r["doc"], bool(r["comparative"])) for r in got.collect()) == [("a", True), ("b", True), ("c", True), ("d", True), ("e", False), ("e", False)]


def test_fingerprints_cut_bytes(spark):
    same = [one(spark, tables.fingerprint(F.col("t"), 5), t=t) for t in ("éé\u00e9x", "éé\u00e9y", "ééa")]
    assert same[0] == same[1] != same[2]


def test_cut_answers_are_repaired(spark):
    rows = [(1, '```json\n{"k": 1,}\n```'), (2, 'so {"k": 2, "note": "cut of'), (3, "none"), (4, ""), (5, "{]"), (6, None)]
    got = {r["id"]: (r["parsed"]["k"] if r["parsed"] else None, r["error"]) for r in batches.answers(spark.createDataFrame(rows, "id int, raw string"), "k int, note string").collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (None, "no_json"), 4: (None, "empty"), 5: (None, "parse_error"), 6: (None, "empty")}


def test_runs_and_clusters_of_pages(spark):
    scores = spark.createDataFrame([("d", p, float(s), False) for p, s in enumerate([1, 13, 5, 5, 2, 2, 9], 1)], "doc string, page_no int, score double, is_break boolean")
    assert sorted(r["page_no"] for r in pages.table_run(scores).collect()) == [2, 3, 4, 5]
    assert sorted(r["page_no"] for r in pages.best_cluster(scores).collect()) == [2]


def test_context_stops_at_its_budget(spark):
    blocks = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, "bbbb"), ("d", 3, "cccc")], "doc string, page_no int, text string")
    assert retrieval.context(blocks, ["doc"], "page_no", budget=6).first()["context"] == "[1]\naaaa\n\n[2]\nbb"


def test_expansion_of_first_place_only(spark):
    assert one(spark, graph.expanded(F.col("t"), [("LD", "damages")]), t="LD and LD, not LDX") == "LD (damages) and LD, not LDX"


FORMULAS = {
    "Base 50 Cr, every additional 10 crore gets 2": "STEP", "for turnover of the firm more than 50": "STEP", "above 1,000 Crs gets 5 marks": "STEP", "5 marks above 50 cr": "LLM", "more than 5, for turnover": "LLM",
    "20 professionals 5, 40 Professional 9": "BAND", "20 employees, 40 employees": "BAND", "20 employees, 40 professionals": "LLM", "up to 50 lakhs: 2 marks, more: 5 marks": "BAND", "up to 50 lakhs: 2 marks": "LLM",
    "2 marks for each project": "PER_UNIT", "2 marks for 01 assignment": "PER_UNIT", "per assignment in the sector 2 marks": "PER_UNIT", "2 marks are for firms per project": "LLM",
    "CV of the lead": "QUAL", "curriculum vitae": "QUAL", "ten years of experience": "QUAL", "recvd": "LLM", "ISO 9001": "BINARY", "ISO 100": "BINARY", "under Startup India": "BINARY", "iso": "LLM", "MSMEs": "BINARY", "": "LLM", None: "LLM",
}


def test_formulas_by_words(spark):
    rows = [(k, "x", t) for k, t in enumerate(FORMULAS)] + [(99, "Qualification of staff", "registered"), (98, "Competence", "none"), (97, "Qualification", "every additional 5 cr")]
    got = {r["k"]: r["f"] for r in spark.createDataFrame(rows, "k int, p string, t string").select("k", criteria.formula_type(F.col("p"), F.col("t")).alias("f")).collect()}
    assert [got[k] for k in range(len(FORMULAS))] == list(FORMULAS.values())
    assert (got[99], got[98], got[97]) == ("QUAL", "QUAL", "STEP")


def test_comparative_by_words(spark):
    yes = ["proportionate scores apply", "the highest number gets the maximum score", "maximum score, others proportionate", "ranked from highest to lowest", "comparative quality", "QCBS", "Quality and Cost Based Selection", "Sf = 100 x Fm", "SF=100×FM", "combined technical and financial score", "combined score"]
    no = ["maximum score to the highest number", "proportionate", "cost and quality based selection", "relative", "sf = 90 x fm", "", None]
    rows = [(k, k, "x", t) for k, t in enumerate(yes + no)] + [(100, 0, "Work plan", "none"), (101, 50, "Methodology", "none")]
    got = {r["k"]: r["comparative"] for r in criteria.comparative(spark.createDataFrame(rows, "k int, doc int, parameter string, criteria_text string")).collect()}
    assert [got[k] for k in range(len(yes + no))] == [True] * len(yes) + [False] * len(no) and got[100] and not got[101]


def test_payment_and_replacement_by_words(spark):
    texts = [("payment", "Payment within 30", "no approval timeline"), ("payment", "30 days from billing; 15 days for comments", ""), ("payment", "days after invoice; deemed to be fully approved", "no invoice cycle"), ("payment", "approved, deemed", "no invoice cycle,no approval timeline"), ("personnel", "45 days, replacement in 60 days or 90 days", "60"), ("personnel", "60 days, replacement at once", "")]
    frame = spark.createDataFrame([(k, c, t) for k, (c, t, _) in enumerate(texts)], "k int, clause_type string, clause_text string")
    got = {r["k"]: ",".join(r["triggers"]) for r in risk.assessed(frame).collect()}
    assert [got[k] for k in range(len(texts))] == [x for _, _, x in texts]
