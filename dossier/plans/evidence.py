"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import chunking as C, retrieval as X
from dossier.plans.bindings import HEADING_SQL, LINES_SQL, lines
from dossier.plans.registry import Registry, Tables

R = Registry()
# Vectors: documents are labels, queries every fiftieth vector, four query numbers in turn.
_HITS_SQL = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, q.label AS doc, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 4) AS score FROM unit q JOIN unit c USING (label) WHERE q.vec_id % 50 = 0)) WHERE rank <= 5)"""


def _hits(t: Tables):
    v = t.embeddings.select(F.col("vec_id"), F.col("label").alias("doc"), F.col("embedding").alias("vector"))
    return X.cosine_top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"))


@R.query("x1_cosine_top_k", f"WITH {_HITS_SQL} SELECT query_id, doc, chunk_id, score, rank FROM hits")
def _(t: Tables):
    return _hits(t)


_MULTI_SQL = f"{_HITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc, topic, chunk_id ORDER BY query_no, rank) AS k FROM (SELECT *, query_id % 2 AS topic, query_id AS query_no FROM hits) WHERE rank <= 3 AND score > 0.15), multi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, topic ORDER BY score DESC, chunk_id)::INT AS position FROM o WHERE k = 1) WHERE position <= 6)"


def _multi(t: Tables):
    return X.multi_query(_hits(t).withColumns({"topic": F.col("query_id") % 2, "query_no": F.col("query_id")}), "topic", "chunk_id", least=0.15)


@R.query("x2_multi_query", f"WITH {_MULTI_SQL} SELECT doc, topic, chunk_id, score, position FROM multi")
def _(t: Tables):
    return _multi(t).select("doc", "topic", "chunk_id", "score", "position")


@R.query("x3_page_ordered", f"WITH {_MULTI_SQL} SELECT doc, topic, chunk_id, row_number() OVER (PARTITION BY doc, topic ORDER BY coalesce(nullif(chunk_id % 7, 0), 999), score DESC, position)::INT AS page_order FROM multi WHERE position <= 5")
def _(t: Tables):
    return X.page_ordered(_multi(t).withColumn("page_no", F.col("chunk_id") % 7), "topic", 5).select("doc", "topic", "chunk_id", "page_order")


@R.query("x4_cascade", """WITH p AS (SELECT l_orderkey AS doc, l_returnflag || l_linestatus || l_linenumber AS text, l_quantity / 50 AS score FROM lineitem WHERE l_linenumber <= 3), s AS (SELECT l_orderkey AS doc, l_returnflag || l_linestatus || l_linenumber AS text, l_quantity / 50 AS score FROM lineitem WHERE l_linenumber > 2),
n AS (SELECT doc, count(*) AS n FROM p GROUP BY doc), u AS (SELECT *, 'primary' AS source FROM p UNION ALL SELECT s.*, 'secondary' FROM s LEFT JOIN n USING (doc) WHERE score > 0.2 AND coalesce(n, 0) < 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc, left(text, 80) ORDER BY source, score DESC, text) AS k FROM u) SELECT doc, text, score, source FROM r WHERE k = 1""")
def _(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_quantity") / 50).alias("score"), "l_linenumber")
    return X.cascade(rows.where("l_linenumber <= 3").drop("l_linenumber"), rows.where("l_linenumber > 2").drop("l_linenumber"), ["doc"])


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 1))"


@R.query("x5_keyword_overlap", f"""WITH {LINES_SQL}, q AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM lines WHERE line_no = 1), qw AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM q), cw AS (SELECT doc_id, line_no, unnest({_WORDS.format('text')}) AS w FROM lines),
s AS (SELECT doc_id AS query_id, line_no AS chunk_id, count(*)::DOUBLE / max(n) AS score FROM qw JOIN cw USING (doc_id, w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def _(t: Tables):
    rows = lines(t).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("chunk_id"), "text")
    return X.keyword_overlap(rows.where("chunk_id = 1").select(F.col("doc").alias("query_id"), "doc", "text"), rows)


_SEC_SQL = f"{LINES_SQL}, hd AS (SELECT *, {HEADING_SQL} AS h FROM lines), sc AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section_no FROM hd), sections AS (SELECT doc_id AS doc, section_no, coalesce(max(CASE WHEN h THEN trim(text) END), 'Preamble') AS heading FROM sc GROUP BY ALL)"
_TOK = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_CHOSEN_SQL = f"""{_SEC_SQL}, q AS (SELECT doc_id AS query_id, doc_id AS doc, left(text, 6) AS title FROM documents WHERE text <> ''),
m AS (SELECT query_id, s.doc, section_no FROM q JOIN sections s ON q.doc = s.doc AND (contains(lower(heading), lower(title)) OR contains(lower(title), lower(heading)) OR len(list_intersect({_TOK.format('lower(title)')}, {_TOK.format('lower(heading)')}))::DOUBLE / greatest(len(list_distinct(list_concat({_TOK.format('lower(title)')}, {_TOK.format('lower(heading)')}))), 1) > 0.5)),
chosen AS (SELECT query_id, doc, section_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section_no) AS k FROM m) WHERE k <= 20)"""


def _sectioned(t: Tables):
    return C.sections(lines(t), C.is_heading(F.col("text"), [r"^[A-Z]"], 60)).withColumnRenamed("doc_id", "doc")


def _chosen(t: Tables):
    queries = t.documents.where("text <> ''").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("doc"), F.substring("text", 1, 6).alias("title"))
    return X.section_matches(queries, _sectioned(t).select("doc", "section_no", "heading"))


@R.query("x6_section_match", f"WITH {_CHOSEN_SQL} SELECT query_id, doc, section_no FROM chosen")
def _(t: Tables):
    return _chosen(t)


# Chunks for the tree: every line, its section's first word and the page as reference.
_TREE_SQL = f"""{_SEC_SQL}, ch AS (SELECT doc_id AS doc, line_no AS chunk_no, CASE WHEN s.section_no = 0 THEN '' ELSE split_part(heading, ' ', 1) END AS top0, CASE WHEN line_no % 3 = 0 THEN '' ELSE 'ref ' || (page_no % 4) END AS clause_ref, nullif(page_no - 1, 0) AS page FROM sc JOIN sections s ON sc.doc_id = s.doc AND sc.section_no = s.section_no),
cc AS (SELECT *, CASE WHEN trim(top0) = '' THEN 'General' ELSE trim(top0) END AS top FROM ch),
nodes AS (SELECT doc, 0 AS level, 'document' AS title, NULL AS parent, min(page) AS start_page, max(page) AS end_page, count(*) AS n_chunks, min(chunk_no) AS f FROM cc GROUP BY doc UNION ALL SELECT doc, 1, top, 'document', min(page), max(page), count(*), min(chunk_no) FROM cc GROUP BY doc, top UNION ALL SELECT doc, 2, clause_ref, top, min(page), max(page), count(*), min(chunk_no) FROM cc WHERE clause_ref <> '' GROUP BY doc, top, clause_ref HAVING count(*) >= 2),
tree AS (SELECT * EXCLUDE f, (row_number() OVER (PARTITION BY doc ORDER BY level, f, title) - 1)::INT AS node FROM nodes)"""


def _tree(t: Tables):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines(t).withColumn("_h", C.is_heading(F.col("text"), [r"^[A-Z]"], 60))
    rows = rows.withColumn("heading", F.last(F.when(F.col("_h"), F.trim("text")), ignorenulls=True).over(w))
    return X.section_tree(rows.select(F.col("doc_id").alias("doc"), F.col("line_no").alias("chunk_no"), F.coalesce(F.get(F.split("heading", " "), F.lit(0)), F.lit("")).alias("section_heading"), F.when(F.col("line_no") % 3 == 0, "").otherwise(F.concat(F.lit("ref "), (F.col("page_no") % 4).cast("string"))).alias("clause_ref"), (F.col("page_no") - 1).alias("page_no")))


@R.query("x7_section_tree", f"WITH {_TREE_SQL} SELECT doc, level, title, parent, start_page, end_page, n_chunks, node FROM tree")
def _(t: Tables):
    return _tree(t)


@R.query("x8_contents", f"""WITH {_TREE_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc, level, parent ORDER BY node) AS k FROM tree WHERE level > 0), kp AS (SELECT * FROM rk WHERE k <= 10),
pl AS (SELECT doc, level, node, node AS home, title, start_page FROM kp WHERE level = 1 UNION ALL SELECT c.doc, c.level, c.node, h.node, c.title, c.start_page FROM kp c JOIN kp h ON c.doc = h.doc AND c.parent = h.title AND h.level = 1 AND c.level = 2)
SELECT doc, string_agg(CASE WHEN level = 2 THEN '  ' ELSE '' END || title || ' (p' || coalesce(start_page::VARCHAR, '?') || ')', chr(10) ORDER BY home, level, node) AS contents FROM pl GROUP BY doc""")
def _(t: Tables):
    return X.contents(_tree(t))


@R.query("x9_tree_size", f"WITH {_TREE_SQL} SELECT doc, count(*) AS n_nodes FROM tree GROUP BY doc")
def _(t: Tables):
    return _tree(t).groupBy("doc").agg(F.count("*").alias("n_nodes"))


@R.query("x10_external_ranking", f"WITH {_HITS_SQL}, r AS (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN chunk_id % 4 END AS place FROM hits) SELECT query_id, chunk_id, CASE WHEN place IS NOT NULL THEN round(greatest(1 - 0.1 * place, 0), 2) ELSE 0.3 END::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY place IS NULL, place, rank, chunk_id)::INT AS position FROM r QUALIFY position <= 10")
def _(t: Tables):
    hits = _hits(t).select("query_id", "chunk_id", "rank")
    return X.externally_ranked(hits, hits.where("chunk_id % 2 = 0").select("query_id", "chunk_id", (F.col("chunk_id") % 4).alias("place")))


_TOPICS = [("the", ["the ", "and ", "that"]), ("tion", ["thtion", "attion", "tion"]), ("none", ["zzqq"])]
_TOPIC_SQL = "topics(topic, words) AS (VALUES " + ", ".join(f"('{n}', {w})" for n, w in _TOPICS) + ")"
_PAGES_SQL = f"{LINES_SQL}, ptext AS (SELECT doc_id AS doc, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL), {_TOPIC_SQL}"
_KEYHITS_SQL = f"{_PAGES_SQL}, kh AS (SELECT * FROM (SELECT doc, topic, page_no, len(list_filter(words, lambda w: contains(lower(text), w)))::INT AS hits FROM ptext, topics) WHERE hits > 0), best AS (SELECT *, row_number() OVER (PARTITION BY doc, topic ORDER BY hits DESC, page_no DESC)::INT AS rank FROM kh QUALIFY rank <= 3)"


def page_texts(t: Tables):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return lines(t).groupBy(F.col("doc_id").alias("doc"), "page_no").agg(F.array_join(rows, "\n").alias("text"))


def _topics(t: Tables):
    return t.spark.createDataFrame(_TOPICS, "topic string, words array<string>")


@R.query("x11_keyword_pages", f"WITH {_KEYHITS_SQL} SELECT doc, topic, page_no, hits, rank FROM best")
def _(t: Tables):
    return X.keyword_pages(page_texts(t), _topics(t), most=3)


@R.query("x12_keyword_occurrences", f"WITH {_PAGES_SQL}, kh AS (SELECT * FROM (SELECT doc, topic, page_no, list_sum(list_transform(words, lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)))::BIGINT AS hits FROM ptext, topics) WHERE hits > 0) SELECT *, row_number() OVER (PARTITION BY doc, topic ORDER BY hits DESC, page_no DESC)::INT AS rank FROM kh QUALIFY rank <= 4")
def _(t: Tables):
    return X.keyword_pages(page_texts(t), _topics(t), most=4, occurrences=True)


_BACK_SQL = f"{_KEYHITS_SQL}, evidence AS (SELECT * FROM best UNION ALL SELECT p.doc, t.topic, page_no, 0, page_no FROM ptext p, topics t WHERE page_no <= 8 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.doc = p.doc AND b.topic = t.topic))"


def _evidence(t: Tables):
    pages = page_texts(t)
    return X.or_first_pages(X.keyword_pages(pages, _topics(t), most=3), pages, _topics(t))


@R.query("x13_first_pages", f"WITH {_BACK_SQL} SELECT doc, topic, page_no, hits, rank FROM evidence")
def _(t: Tables):
    return _evidence(t)


@R.query("x14_context_budget", f"""WITH {_BACK_SQL}, e AS (SELECT doc, topic, page_no, text, 500 - coalesce(sum(length(text)) OVER (PARTITION BY doc, topic ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM evidence JOIN ptext USING (doc, page_no))
SELECT doc, topic, string_agg('[' || page_no || ']' || chr(10) || left(text, room::INT), chr(10) || chr(10) ORDER BY page_no) AS context, count(*) AS n_blocks FROM e WHERE room > 0 GROUP BY ALL""")
def _(t: Tables):
    return X.context(_evidence(t).join(page_texts(t), ["doc", "page_no"]), ["doc", "topic"], "page_no", budget=500)


_RULES = [("ring|bolt", "hardware"), ("red|blue", "colour"), ("large", "size")]
_RULE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{p}') THEN '{x}'" for p, x in _RULES) + " ELSE 'generic' END"


@R.query("x15_keyword_set", f"SELECT p_partkey, {_RULE_SQL} AS kind FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", X.first_rule(t.part, F.col("p_name"), _RULES, "generic").alias("kind"))


@R.query("x16_fact_question", f"SELECT p_partkey, CASE {_RULE_SQL} WHEN 'hardware' THEN 'How many parts of ' WHEN 'colour' THEN 'Which colour has ' ELSE 'What is said of ' END || p_name || '?' AS question FROM part")
def _(t: Tables):
    kind = X.first_rule(t.part, F.col("p_name"), _RULES, "generic")
    return t.part.select("p_partkey", F.concat(F.when(kind == "hardware", "How many parts of ").when(kind == "colour", "Which colour has ").otherwise("What is said of "), F.col("p_name"), F.lit("?")).alias("question"))


@R.query("x17_phrase_keywords", """WITH w AS (SELECT p_brand AS doc, unnest(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' of the ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '))) AS w FROM part WHERE p_type NOT IN ('PROMO', 'SMALL'))
SELECT doc, array_to_string(list_sort(list_distinct(list(w))), ',') AS keywords FROM w WHERE length(w) >= 3 AND w NOT IN ('the', 'for') AND regexp_matches(w, '^[a-z]+$') GROUP BY doc""")
def _(t: Tables):
    formula = F.when(F.col("p_type") == "PROMO", "QUAL").when(F.col("p_type") == "SMALL", "LLM").otherwise("BAND")
    rows = t.part.select(F.col("p_brand").alias("doc"), formula.alias("formula_type"), F.array(F.col("p_name"), F.concat(F.lit("of the "), F.col("p_type"))).alias("search_keywords"))
    return X.phrase_keywords(rows, ["the", "for"]).withColumn("keywords", F.array_join("keywords", ","))


@R.query("x18_section_retrieval", f"""WITH {_CHOSEN_SQL}, byc AS (SELECT query_id, line_no AS chunk_id, 1.0::DOUBLE AS score, 'section' AS method FROM chosen c JOIN sc ON c.doc = sc.doc_id AND c.section_no = sc.section_no),
qw AS (SELECT query_id, doc, unnest({_WORDS.format('title')}) AS w, len({_WORDS.format('title')}) AS n FROM q WHERE query_id NOT IN (SELECT query_id FROM byc)), cw AS (SELECT doc_id, line_no, unnest({_WORDS.format('text')}) AS w FROM lines),
s AS (SELECT query_id, line_no AS chunk_id, count(*)::DOUBLE / max(n) AS score FROM qw JOIN cw ON qw.doc = cw.doc_id AND qw.w = cw.w GROUP BY ALL)
SELECT * FROM byc UNION ALL SELECT query_id, chunk_id, score, 'keyword' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) WHERE k <= 20""")
def _(t: Tables):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    chunks = lines(t).withColumn("section_no", F.sum(C.is_heading(F.col("text"), [r"^[A-Z]"], 60).cast("long")).over(w)).select(F.col("doc_id").alias("doc"), "section_no", F.col("line_no").alias("chunk_id"), "text")
    queries = t.documents.where("text <> ''").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("doc"), F.substring("text", 1, 6).alias("text"))
    return X.section_retrieval(queries, _chosen(t), chunks)


QUERIES, ORACLE = R.queries, R.oracle
