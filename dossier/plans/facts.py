"""Claim and knowledge-graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import claims as E, graph as N
from dossier.plans.bindings import LINES_SQL, lines
from dossier.plans.evidence import _PAGES_SQL, page_texts
from dossier.plans.registry import Registry, Tables

R = Registry()
# Responses: sentences for each type of part, an even and an odd one, with numbers of the part.
_RESPONSES = {
    "STANDARD": ("turnover of the firm", ["Average annual turnover of Rs ", "p_retailprice", " lakh, see page ", "p_size"], ["Revenue INR ", "p_retailprice", " Cr on page ", "p_size"]),
    "PROMO": ("similar projects", ["The following ", "p_size", " projects, pg. ", "p_size"], ["Details of ", "p_size", " relevant assignments at page ", "p_size"]),
    "LARGE": ("professional staff", ["We have deployed ", "p_partkey", " professionals, p. ", "p_size"], ["More than ", "p_partkey", " technically qualified people"]),
    "ECONOMY": ("years of work", ["Established in 19", "p_size + 40", " with pages ", "p_size"], ["More than ", "p_size", " years of relevant experience"]),
    "MEDIUM": ("registration", ["Yes, registered under ", "p_size", " acts"], ["Nothing of the kind"]),
    "SMALL": ("methodology", ["Maximum marks ", "p_size", "."], ["Maximum marks 20. The approach has ", "p_size", " steps in this proposal, each of them with its own team"]),
}
_say = lambda parts: " || ".join(f"'{x}'" if i % 2 == 0 else f"({x})" for i, x in enumerate(parts))
_RESP_SQL = "resp AS (SELECT p_partkey AS claim_id, p_partkey % 200 AS doc, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (c, _, _) in _RESPONSES.items()) + " END AS criterion, CASE p_type " + " ".join(f"WHEN '{k}' THEN CASE WHEN p_size % 2 = 0 THEN {_say(a)} ELSE {_say(b)} END" for k, (_, a, b) in _RESPONSES.items()) + " END AS response FROM part)"


def _responses(t: Tables):
    said = lambda parts: F.concat(*[F.lit(x) if i % 2 == 0 else F.expr(x).cast("string") for i, x in enumerate(parts)])
    criterion, response = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (c, even, odd) in _RESPONSES.items():
        mine = F.col("p_type") == k
        criterion, response = F.when(mine, c).otherwise(criterion), F.when(mine, F.when(F.col("p_size") % 2 == 0, said(even)).otherwise(said(odd))).otherwise(response)
    return t.part.select(F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") % 200).alias("doc"), criterion.alias("criterion"), response.alias("response"))


# The same facts out of the text, by other means than the operator's: one pattern for each sentence that may stand there.
_SCORING_SQL = r"(regexp_matches(response, '(?i)\bmaximum marks?\b') AND length(trim(regexp_replace(response, '(?i)[^.]*\bmaximum marks?\b[^.]*\.', '', 'g'))) < 40)"
_num = lambda p: rf"try_cast(nullif(regexp_extract(response, '(?i){p}', 1), '') AS DOUBLE)"
_FACT_SQL = f"""{_RESP_SQL}, found AS (SELECT claim_id, CASE WHEN {_SCORING_SQL} THEN NULL
WHEN contains(criterion, 'turnover') AND {_num('turnover of rs ([0-9.]+) lakh')} IS NOT NULL THEN {{'family': 'turnover', 'value': round(({_num('turnover of rs ([0-9.]+) lakh')} / 100)::DECIMAL(20,6), 2)::DOUBLE, 'label': 'average turnover'}}
WHEN contains(criterion, 'turnover') AND {_num('inr ([0-9.]+) cr')} IS NOT NULL THEN {{'family': 'turnover', 'value': {_num('inr ([0-9.]+) cr')}, 'label': 'amount in rupees'}}
WHEN contains(criterion, 'project') AND {_num('following ([0-9]+) projects')} BETWEEN 1 AND 50 THEN {{'family': 'projects', 'value': {_num('following ([0-9]+) projects')}, 'label': 'following projects'}}
WHEN contains(criterion, 'project') AND {_num('([0-9]+) relevant assignments')} BETWEEN 1 AND 50 THEN {{'family': 'projects', 'value': {_num('([0-9]+) relevant assignments')}, 'label': 'eligible projects'}}
WHEN contains(criterion, 'staff') AND {_num('([0-9]+) technically qualified')} >= 1 THEN {{'family': 'staff', 'value': {_num('([0-9]+) technically qualified')}, 'label': 'technically qualified'}}
WHEN contains(criterion, 'staff') AND {_num('deployed ([0-9]+) professionals')} >= 1 THEN {{'family': 'staff', 'value': {_num('deployed ([0-9]+) professionals')}, 'label': 'deployed'}}
WHEN contains(criterion, 'year') AND {_num('([0-9]+) years of relevant experience')} BETWEEN 1 AND 50 THEN {{'family': 'years', 'value': {_num('([0-9]+) years of relevant experience')}, 'label': 'years of experience'}}
WHEN contains(criterion, 'year') AND {_num('established in ([0-9]+)')} >= 1900 THEN {{'family': 'years', 'value': 2024 - {_num('established in ([0-9]+)')}, 'label': 'established'}}
WHEN regexp_matches(response, '(?i)\\byes\\b|\\bregistered (with|under)\\b') THEN {{'family': 'present', 'value': 1.0::DOUBLE, 'label': 'stated'}} END AS f FROM resp)"""


@R.query("e1_facts", f"WITH {_FACT_SQL} SELECT claim_id, f.family, f.value, f.label FROM found")
def _(t: Tables):
    return _responses(t).select("claim_id", E.fact(F.col("response"), F.col("criterion")).alias("f")).select("claim_id", "f.*")


@R.query("e2_scoring_language", f"WITH {_RESP_SQL} SELECT claim_id, {_SCORING_SQL} AS scoring FROM resp")
def _(t: Tables):
    return _responses(t).select("claim_id", E.is_scoring_language(F.col("response")).alias("scoring"))


_CITED = r"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(response, '(?i)\b(?:pages?|pg\.?|p\.)\s*(?:no\.?\s*)?(\d{1,4})', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND 1000))), ',')"


@R.query("e3_cited_pages", f"WITH {_RESP_SQL} SELECT claim_id, {_CITED} AS pages FROM resp")
def _(t: Tables):
    return _responses(t).select("claim_id", F.array_join(E.cited_pages(F.col("response")), ",").alias("pages"))


_CLAIM_SQL = f"{_PAGES_SQL}, claims AS (SELECT p_partkey AS claim_id, p_partkey % 200 AS doc, CASE WHEN p_size % 3 = 0 THEN 'the ' || p_size ELSE left(p_name, 3) END AS value, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 4 + 1 END AS page_no FROM part), terms AS (SELECT *, CASE WHEN value LIKE 'the %' THEN substr(value, 5) ELSE lower(value) END AS term FROM claims), ver AS (SELECT c.*, p.text IS NOT NULL AND contains(lower(p.text), term) AS hit FROM terms c LEFT JOIN ptext p ON c.doc = p.doc AND c.page_no = p.page_no)"


def _verified(t: Tables):
    size = F.col("p_size")
    claims = t.part.select(F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") % 200).alias("doc"), F.when(size % 3 == 0, F.concat(F.lit("the "), size.cast("string"))).otherwise(F.substring("p_name", 1, 3)).alias("value"), F.when(size % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((size % 4 + 1).cast("int"))).alias("pages"))
    return E.verified(claims, page_texts(t))


@R.query("e4_on_cited_page", f"WITH {_CLAIM_SQL} SELECT claim_id, hit AS verified FROM ver WHERE page_no IS NOT NULL")
def _(t: Tables):
    return _verified(t).where("size(pages) > 0").select("claim_id", "verified")


@R.query("e5_verification_policy", f"WITH {_CLAIM_SQL} SELECT claim_id, page_no IS NULL OR hit AS verified FROM ver")
def _(t: Tables):
    return _verified(t).select("claim_id", "verified")


@R.query("e6_criterion_block", "WITH p AS (SELECT doc_id, text, list_min(list_filter([strpos(lower(text), 'thtion'), strpos(lower(text), 'attion'), strpos(lower(text), 'ener')], lambda x: x > 0)) AS a FROM documents), b AS (SELECT doc_id, substr(text, a, 3000) AS block FROM p) SELECT doc_id, left(CASE WHEN strpos(block, 'that') > 0 THEN substr(block, strpos(block, 'that')) ELSE block END, 2000) AS block FROM b")
def _(t: Tables):
    return t.documents.select("doc_id", E.criterion_block(F.col("text"), F.lit("Thtion attion ener"), "that").alias("block"))


# Blocks of self-assessments: a parameter, a formula and a text for each type of part.
_BLOCKS = {
    "STANDARD": ("Financial strength", "BAND", ["Statement for ", "p_partkey % 9", " years, INR ", "p_retailprice", " crores on average"]),
    "PROMO": ("Area of work", "STEP", ["1 Plan Mar ", "2001 + p_size % 20", " to Apr 2022; 2 Roads June ", "2003 + p_partkey % 15", " to till date; since Jan 1998 to date"]),
    "LARGE": ("Handling of projects", "PER_UNIT", ["Details of the following ", "p_size", " such assignments"]),
    "ECONOMY": ("Manpower", "BAND", ["over ", "p_partkey * 10", " technically qualified personnel; more than ", "p_size", " others"]),
    "MEDIUM": ("Work in the state", "LLM", ["Rows: ", "p_size", " work order copies"]),
    "SMALL": ("Tools", "BAND", ["The tools number ", "p_size", " in all"]),
}
_case = lambda f: "CASE p_type " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in _BLOCKS.items()) + " END"
_BLOCK_SQL = f"blk AS (SELECT p_partkey AS claim_id, {_case(lambda v: chr(39) + v[0] + chr(39))} AS parameter, {_case(lambda v: chr(39) + v[1] + chr(39))} AS formula, {_case(lambda v: _say(v[2]))} AS block FROM part)"
_of = lambda p: rf"try_cast(nullif(regexp_extract(block, '(?i){p}', 1), '') AS DOUBLE)"
_CLAIMED_SQL = f"""{_BLOCK_SQL}, val AS (SELECT claim_id, formula, block, CASE WHEN regexp_matches(lower(parameter), 'turnover|financial|revenue') THEN 'turnover' WHEN regexp_matches(lower(parameter), 'experience|area|year') THEN 'years' WHEN regexp_matches(lower(parameter), 'project|handling') THEN 'projects'
  WHEN regexp_matches(lower(parameter), 'manpower|staff|personnel') THEN 'staff' WHEN formula = 'BINARY' OR regexp_matches(lower(parameter), 'state|region') THEN 'present' END AS kind FROM blk),
read AS (SELECT *, CASE kind WHEN 'turnover' THEN {_of('([0-9.]+) *cr')} WHEN 'years' THEN 2024 - list_min(list_filter(list_transform(regexp_extract_all(block, '(?i)(?:jan|mar|june) ([0-9]{{4}}) to (?:apr [0-9]{{4}}|date|till date)', 1), lambda y: y::INT), lambda y: y BETWEEN 2000 AND 2024))
  WHEN 'projects' THEN {_of('following ([0-9]+) such assign')} WHEN 'staff' THEN {_of('([0-9]+) technically qualified')} WHEN 'present' THEN CASE WHEN contains(lower(block), 'work order') THEN 1.0 END END::DOUBLE AS value, {_of('([0-9]+([.][0-9]+)?)')} AS n FROM val)"""


@R.query("e7_claim_families", f"WITH {_CLAIMED_SQL} SELECT claim_id, CASE WHEN value IS NOT NULL THEN kind WHEN formula IN ('BAND', 'STEP', 'PER_UNIT') AND n IS NOT NULL THEN 'number' END AS kind, coalesce(value, CASE WHEN formula IN ('BAND', 'STEP', 'PER_UNIT') THEN n END) AS value FROM read")
def _(t: Tables):
    pick = lambda f: F.coalesce(*[F.when(F.col("p_type") == k, f(v)) for k, v in _BLOCKS.items()])
    block = pick(lambda v: F.concat(*[F.lit(x) if i % 2 == 0 else F.expr(x).cast("string") for i, x in enumerate(v[2])]))
    return t.part.select(F.col("p_partkey").alias("claim_id"), E.claimed(pick(lambda v: F.lit(v[0])), pick(lambda v: F.lit(v[1])), block).alias("f")).select("claim_id", "f.*")


@R.query("e8_value_guard", r"""WITH v AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Not Found' WHEN 1 THEN '20 marks' WHEN 2 THEN p_size * 30 || ' done' ELSE ' ' || p_size || ' items ' END AS raw, CASE WHEN p_partkey % 2 = 0 THEN 'BAND' ELSE 'QUAL' END AS formula FROM part),
n AS (SELECT *, trim(raw) AS t, try_cast(nullif(regexp_extract(raw, '([0-9]+)', 1), '') AS DOUBLE) AS num FROM v)
SELECT p_partkey, CASE WHEN lower(t) = 'not found' OR regexp_matches(lower(t), '\b(mark|marks|point|points|score|criteria)\b') OR (formula IN ('BAND', 'STEP') AND num > 500) THEN NULL ELSE t END AS value FROM n""")
def _(t: Tables):
    n = F.col("p_size")
    value = F.when(n % 6 == 0, "Not Found").when(n % 6 == 1, "20 marks").when(n % 6 == 2, F.concat((n * 30).cast("string"), F.lit(" done"))).otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit(" items ")))
    return t.part.select("p_partkey", E.guarded(value, F.lit(True), F.lit("Project count"), F.when(F.col("p_partkey") % 2 == 0, "BAND").otherwise("QUAL")).alias("value"))


_TOK = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"


@R.query("e9_remap", f"""WITH c AS (SELECT DISTINCT p_brand AS doc, p_name || ' ' || p_type AS parameter FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT p_brand AS doc, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) || '-' || p_type WHEN p_partkey % 4 = 1 THEN p_name ELSE p_type || ' zz' || p_partkey END AS name FROM part),
ex AS (SELECT n.doc, name, min(parameter) AS exact FROM n LEFT JOIN c ON n.doc = c.doc AND {_TOK.format('name')} = {_TOK.format('parameter')} GROUP BY ALL),
cd AS (SELECT ex.doc, name, parameter, len(list_intersect({_TOK.format('name')}, {_TOK.format('parameter')}))::DOUBLE / len(list_distinct(list_concat({_TOK.format('name')}, {_TOK.format('parameter')}))) AS o FROM ex JOIN c ON ex.doc = c.doc WHERE exact IS NULL), nr AS (SELECT doc, name, min_by(parameter, (-o, parameter)) AS near FROM cd WHERE o >= 0.3 GROUP BY ALL)
SELECT ex.doc, ex.name, coalesce(exact, near, ex.name) AS parameter, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'near' ELSE 'own' END AS how FROM ex LEFT JOIN nr USING (doc, name)""")
def _(t: Tables):
    key = F.col("p_partkey") % 4
    names = t.part.select(F.col("p_brand").alias("doc"), F.when(key == 0, F.concat(F.upper("p_name"), F.lit("-"), F.col("p_type"))).when(key == 1, F.col("p_name")).otherwise(F.concat("p_type", F.lit(" zz"), F.col("p_partkey").cast("string"))).alias("name"))
    return E.remapped(names, t.part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("parameter")))


_ROLES = [("leader", ["thtion", "license"]), ("expert", ["attion", "ener", "anti"])]


@R.query("e10_role_evidence", f"""WITH {_PAGES_SQL}, roles(role, ws) AS (VALUES {", ".join(f"('{r}', {w})" for r, w in _ROLES)}), s AS (SELECT doc, role, page_no, len(list_filter(ws, lambda w: contains(lower(text), w))) AS hits, len(regexp_extract_all(lower(text), 'that|with')) AS sig FROM ptext, roles),
b AS (SELECT doc, role, page_no, (2 * hits + sig)::INT AS score FROM s WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc, role ORDER BY 2 * hits + sig DESC, page_no) = 1) SELECT *, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, score >= 2 AS present FROM b""")
def _(t: Tables):
    return E.role_evidence(page_texts(t), t.spark.createDataFrame(_ROLES, "role string, words array<string>"), "that|with").drop("snippet")


@R.query("e11_fiscal_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR year(o_orderdate) < 2000 THEN '' ELSE year(o_orderdate) || '-' || right((year(o_orderdate) + 1)::VARCHAR, 2) END AS years FROM orders")
def _(t: Tables):
    y = F.year("o_orderdate")
    long, short = F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string")), F.concat(y.cast("string"), F.lit(" - "), F.right((y + 1).cast("string"), F.lit(2)))
    text = F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.concat(F.lit("for "), long, F.lit(" and again "), short, F.lit(".")))
    return t.orders.select("o_orderkey", F.array_join(E.fiscal_years(text), ",").alias("years"))


@R.query("e12_year_mismatch", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE (year(o_orderdate) + 1)::VARCHAR END AS missing, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE year(o_orderdate)::VARCHAR END AS extra FROM orders")
def _(t: Tables):
    y = F.year("o_orderdate")
    asked, offered = F.array((y + F.col("o_orderkey") % 2).cast("string")), F.array(y.cast("string"))
    return t.orders.select("o_orderkey", E.year_mismatch(asked, offered).alias("m")).select("o_orderkey", F.array_join("m.missing", ",").alias("missing"), F.array_join("m.extra", ",").alias("extra"))


@R.query("e13_binary_presence", f"WITH {_PAGES_SQL} SELECT DISTINCT doc, topic AS criterion FROM ptext, topics WHERE page_no <= 200 AND len(list_filter(words, lambda w: contains(lower(text), w))) > 0")
def _(t: Tables):
    from dossier.plans.evidence import _TOPICS

    pages = page_texts(t)
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.array(*map(F.lit, w)).alias("terms")) for c, w in _TOPICS]))
    criteria = pages.select("doc").distinct().select("doc", asked.alias("c")).select("doc", "c.*")
    return E.present_in_pages(criteria, pages).select("doc", "criterion")


@R.query("e14_cleaned_names", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS name FROM customer")
def _(t: Tables):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "Client: n/a").when(k == 1, "xy").when(k == 2, F.concat(F.lit("Client: "), F.col("c_name"))).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    return t.customer.select("c_custkey", E.cleaned_name(raw, r"(?i)^client:\s*", ["n/a", "unknown"]).alias("name"))


_TERMS = [("The", "the article", "word"), ("With", "together", "word"), ("Zz", "nothing", "word")]
_TERM_SQL = "terms(term, expansion, kind) AS (VALUES " + ", ".join(map(str, _TERMS)) + ")"
_EDGE_SQL = f"""{_PAGES_SQL.replace('topics(', 'topics0(')}, {_TERM_SQL}, mt AS (SELECT DISTINCT t.term AS source, doc || ':' || page_no AS target, 'MENTIONED_AT' AS label FROM ptext JOIN terms t ON list_contains(string_split(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), ' '), t.term)),
og AS (SELECT DISTINCT doc::VARCHAR AS source, left(trim(unnest(regexp_extract_all(text, '([A-Z][a-z]+ing)', 1)[1:10])), 100) AS target, 'INVOLVES' AS label FROM ptext), sg AS (SELECT DISTINCT risk AS source, doc::VARCHAR AS target, 'DETECTED_IN' AS label FROM ptext JOIN (VALUES ('license', 'licensing'), ('copyright', 'licensing'), ('idiot', 'conduct')) p(phrase, risk) ON contains(lower(text), phrase))"""


def _terms(t: Tables):
    return t.spark.createDataFrame(_TERMS, "term string, expansion string, kind string")


def _chunks(t: Tables):
    return page_texts(t).withColumn("chunk", F.col("page_no"))


def _organisations(t: Tables):
    return N.organisations(_chunks(t), r"([A-Z][a-z]+ing)")


def _signals(t: Tables):
    phrases = t.spark.createDataFrame([("license", "licensing"), ("copyright", "licensing"), ("idiot", "conduct")], "phrase string, risk string")
    return N.signals(_chunks(t), phrases)


@R.query("n1_ontology", "SELECT p_name AS source, p_type AS target, 'SYNONYM_OF' AS label FROM part GROUP BY ALL")
def _(t: Tables):
    return N.ontology(t.part.select(F.col("p_type").alias("term"), F.col("p_name").alias("expansion"), F.lit("type").alias("kind")))[1]


@R.query("n2_mentions", f"WITH {_EDGE_SQL} SELECT source, target, label FROM mt")
def _(t: Tables):
    return N.mentions(page_texts(t), _terms(t))


@R.query("n3_organisations", f"WITH {_EDGE_SQL} SELECT source, target, label FROM og")
def _(t: Tables):
    return _organisations(t)


@R.query("n4_amounts", "SELECT p_partkey AS doc, p_size AS chunk, 0 AS k, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice / 100 ELSE p_retailprice / 10000000 END AS crores FROM part")
def _(t: Tables):
    key = F.col("p_partkey") % 3
    text = F.concat(F.lit("worth Rs. "), F.col("p_retailprice").cast("string"), F.when(key == 0, " Cr").when(key == 1, " lakh").otherwise(""), F.lit(" in all"))
    return N.amounts(t.part.select(F.col("p_partkey").alias("doc"), F.col("p_size").alias("chunk"), text.alias("text")))


@R.query("n5_risk_signals", f"WITH {_EDGE_SQL} SELECT source, target, label FROM sg")
def _(t: Tables):
    return _signals(t)


@R.query("n6_expanded", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\pL\pN_])The([^\pL\pN_]|$)', '\1The (the article)\2'), '(^|[^\pL\pN_])with([^\pL\pN_]|$)', '\1with (together)\2') AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", N.expanded(F.col("text"), [("The", "the article"), ("with", "together")]).alias("text"))


@R.query("n7_offering_hint", f"WITH {_PAGES_SQL} SELECT doc, min_by(offering, place) AS offering FROM ptext JOIN (VALUES (1, 'license', 'rights'), (2, 'that', 'words'), (3, 'der', 'worte')) k(place, keyword, offering) ON contains(lower(text), keyword) WHERE page_no <= 50 GROUP BY doc")
def _(t: Tables):
    return N.first_offering(_chunks(t), t.spark.createDataFrame([(1, "license", "rights"), (2, "that", "words"), (3, "der", "worte")], "place int, keyword string, offering string"))


@R.query("n8_graph_summary", f"WITH {_EDGE_SQL}, ed AS (SELECT * FROM mt UNION ALL SELECT * FROM og UNION ALL SELECT * FROM sg) SELECT (SELECT count(*) FROM (SELECT source FROM ed UNION SELECT target FROM ed)) AS n_nodes, (SELECT count(*) FROM ed) AS n_edges, (SELECT count(DISTINCT target) FROM og) AS n_organisations, (SELECT count(DISTINCT source) FROM sg) AS n_risks")
def _(t: Tables):
    edges = N.mentions(page_texts(t), _terms(t)).unionByName(_organisations(t)).unionByName(_signals(t))
    return N.summary(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), edges)


@R.query("n9_context", f"WITH {_EDGE_SQL}, ed AS (SELECT * FROM og UNION ALL SELECT * FROM sg), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY label, source) AS k FROM ed) SELECT target, string_agg(label || ' ' || source, '; ' ORDER BY k) AS context FROM r WHERE k <= 10 GROUP BY target")
def _(t: Tables):
    return N.context(_organisations(t).unionByName(_signals(t)))


QUERIES, ORACLE = R.queries, R.oracle
