"""Source, sink, batch-inference and streaming queries over the driver's tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from dossier.operators import batches as D, gaps, risk
from dossier.plans.bindings import CLAUSES, FEEDBACK_SQL, ITEMS_SQL, LINES_SQL, clauses, feedback, items, lines
from dossier.plans.registry import Registry, Tables
from dossier.plans.scores import PLAIN_GAPS_SQL, SUMMARY_SQL
from dossier.plans.reviews import _ADJ_SQL as ADJUSTED_SQL, _targets as targets
from dossier.plans.risks import _SQL as ASSESSED_SQL
from dossier.sources import tables as S
from dossier.sources.files import document_files, document_stream, write_files
from dossier.sources.keyed import KeyedTable, shared_folder
from dossier.streaming import jobs as J

R = Registry()


def _table(t: Tables, key: str) -> KeyedTable:
    """An empty table of this run in the shared folder."""
    return KeyedTable(t.spark, f"{shared_folder(t.spark)}/table-{uuid.uuid4().hex}", key, buckets=8)



def _docx(text: str) -> bytes:
    """A docx file with a paragraph for each line of a text."""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def _as_files(t: Tables):
    """The documents as files of mixed types: xls, txt, md, docx, pdf, and pdf files that are none."""
    kind, text = F.col("doc_id") % 6, F.col("text").cast("binary")
    name = F.when(kind == 0, "XLS").when(kind == 1, "txt").when(kind == 2, "md").when(kind == 3, "docx").otherwise("pdf")
    content = F.when(kind == 3, F.udf(_docx, "binary", useArrow=True)("text")).when(kind == 4, F.concat(F.lit("%PDF-1.7\n").cast("binary"), text)).otherwise(text)
    return t.documents.select("doc_id", "text", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), name).alias("path"), content.alias("content"))


@R.query("s1_scan", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'xls' WHEN 1 THEN 'txt' WHEN 2 THEN 'md' WHEN 3 THEN 'docx' ELSE 'pdf' END AS kind, CASE WHEN doc_id % 6 IN (1, 2, 3) THEN sha256(text) END AS digest,
CASE doc_id % 6 WHEN 0 THEN 'unsupported type: xls' WHEN 5 THEN 'unreadable: ValueError' END AS error FROM documents""")
def _(t: Tables):
    # Every document is written as a file of its kind and read back from the folder.
    folder = f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"
    write_files(_as_files(t), folder)
    return document_files(t.spark, folder, content="false").select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "kind", F.sha2("text", 256).alias("digest"), "error")


@R.query("s2_fingerprint", "SELECT doc_id, left(sha256(text), 16) AS fingerprint FROM documents")
def _(t: Tables):
    # No text of the driver's is longer than the 512 KB that count; a unit test holds the cut in bytes.
    return t.documents.select("doc_id", S.fingerprint(F.col("text")).alias("fingerprint"))


@R.query("s3_pending", "WITH k AS (SELECT p_brand AS doc, md5(string_agg(p_name, '|' ORDER BY p_name)) AS criteria_key FROM part GROUP BY p_brand) SELECT doc, criteria_key FROM k WHERE NOT (doc < 'Brand#2' AND length(doc) > 7)")
def _(t: Tables):
    keys = S.criteria_key(t.part.select(F.col("p_brand").alias("doc"), F.col("p_name").alias("parameter")))
    registry = keys.where("doc < 'Brand#2'").withColumn("complete", F.length("doc") > 7)
    return S.pending(keys, registry, ["doc", "criteria_key"], F.col("complete"))


@R.query("s4_keyed_replace", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END::DOUBLE AS price FROM orders")
def _(t: Tables):
    now = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    return S.replaced(now, now.where("o_orderkey % 10 = 0").withColumn("price", F.lit(0.0)), ["o_orderkey"])


_HISTORY_SQL = """o AS (SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderpriority AS priority FROM orders),
v2 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE price END::DOUBLE AS price, priority FROM o WHERE NOT (o_custkey % 5 = 0 AND o_orderkey % 2 = 1)),
v3 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE price END::DOUBLE AS price, priority FROM v2),
v4 AS (SELECT * FROM v3 WHERE o_custkey % 11 <> 0)"""


@R.query("s4_table_history", f"WITH {_HISTORY_SQL} SELECT 1 AS version, * FROM o UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4")
def _(t: Tables):
    # Customers' orders: all written, some customers replaced (by fewer rows), some patched, some deleted; every version read again.
    from dossier.operators.feedback import merged

    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    table = _table(t, "o_custkey")
    table.replace(rows)
    fifth = rows.where("o_custkey % 5 = 0")
    table.replace(fifth.where("o_orderkey % 2 = 0").withColumn("price", F.lit(0.0)), fifth)
    fixes = table.read().where("o_custkey % 7 = 0").select("o_orderkey", "o_custkey", F.lit(1.0).alias("price"), F.lit(None).cast("string").alias("priority"))
    table.patch(fixes, ["o_orderkey", "o_custkey"], merged)
    table.delete(rows.where("o_custkey % 11 = 0"))
    every = [table.read(v).withColumn("version", F.lit(v)) for v in table.versions()]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@R.query("s5_chunk_ingest", f"WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN 'new: ' || text ELSE text END AS text FROM lines WHERE NOT (doc_id % 3 = 0 AND line_no % 2 = 1)")
def _(t: Tables):
    rows = lines(t).select("doc_id", "line_no", "text")
    new = rows.where("doc_id % 3 = 0 and line_no % 2 = 0").withColumn("text", F.concat(F.lit("new: "), F.col("text")))
    table = _table(t, "doc_id")
    table.replace(rows)
    table.replace(new, rows.where("doc_id % 3 = 0"))
    return table.read()


@R.query("s6_full_document", f"WITH {LINES_SQL} SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no, line_no) AS text FROM lines GROUP BY doc_id")
def _(t: Tables):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text"))), lambda x: x["text"])
    return lines(t).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


@R.query("s7_documents_left", f"WITH {LINES_SQL} SELECT (SELECT count(DISTINCT doc_id) FROM lines WHERE doc_id <> 7) AS n_documents, (SELECT count(*) FROM lines WHERE doc_id = 7) AS n_deleted")
def _(t: Tables):
    left, gone = S.without_document(lines(t), "doc_id", 7)
    return left.agg(F.count_distinct("doc_id").alias("n_documents")).crossJoin(gone)


@R.query("s8_offerings", "SELECT r_name AS key, n_name AS value, (row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1)::INT AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return S.listed(named.select(F.to_json(F.map_from_arrays(F.array("r_name"), F.array("names"))).alias("map")), "map")


@R.query("s9_registry", "SELECT p_brand AS doc, count(*)::INT AS n_criteria, sum(p_size)::BIGINT AS total_marks, (count(DISTINCT p_type) * 2)::INT AS n_bands FROM part GROUP BY p_brand")
def _(t: Tables):
    types = F.array_sort(F.collect_set("p_type"))
    cached = t.part.groupBy(F.col("p_brand").alias("doc")).agg(F.collect_list(F.struct(F.col("p_name").alias("parameter"), F.col("p_size").alias("max_marks"))).alias("criteria"), F.map_from_arrays(types, F.transform(types, lambda x: F.array(F.lit(1), F.lit(2)))).alias("bands"))
    return S.registry_listing(cached)


@R.query("s10_clause_results", f"WITH {ASSESSED_SQL} SELECT doc, seq, clause_type, risk_level, CASE WHEN seq % 2 = 0 AND risk_level <> 'LOW' THEN 'LOW' END AS adjusted_level FROM assessed")
def _(t: Tables):
    rows = risk.assessed(clauses(t))
    return rows.select("doc", "seq", "clause_type", "risk_level", F.when((F.col("seq") % 2 == 0) & (F.col("risk_level") != "LOW"), "LOW").alias("adjusted_level"))


@R.query("s11_score_items", f"WITH {ITEMS_SQL} SELECT evaluation_id, item_seq AS sort_order, CASE WHEN score_state = 'scored' THEN score END::DOUBLE AS score, score_state FROM items")
def _(t: Tables):
    return items(t).select("evaluation_id", F.col("item_seq").alias("sort_order"), F.when(F.col("score_state") == "scored", F.col("score")).cast("double").alias("score"), "score_state")


@R.query("s12_evolution", "SELECT c_custkey, c_name, coalesce(c_mktsegment, 'none') AS c_mktsegment, 0 AS reviews, 'new' AS state FROM customer")
def _(t: Tables):
    return S.evolved(t.customer.select("c_custkey", "c_name", "c_mktsegment"), {"c_mktsegment": ("string", "none"), "reviews": ("int", 0), "state": ("string", "new")})


@R.query("s13_review_rows", f"""WITH {ASSESSED_SQL}, r AS (SELECT doc, clause_type, risk_level, clause_text, CASE WHEN seq % 3 > 0 THEN 'c ' || seq END AS reference, CASE WHEN seq % 2 > 0 THEN seq END AS page_no FROM assessed QUALIFY row_number() OVER (PARTITION BY doc, clause_type ORDER BY seq) = 1), o AS (SELECT unnest({CLAUSES}) AS clause_type, unnest(range(0, {len(CLAUSES)}))::INT AS place), e AS (SELECT * FROM (SELECT DISTINCT doc FROM r), o)
SELECT doc, place, clause_type, CASE WHEN reference IS NOT NULL AND page_no IS NOT NULL THEN reference || ' (Page ' || page_no || ')' ELSE coalesce(reference, 'Page ' || page_no, '-') END AS reference, left(coalesce(clause_text, 'Not found'), 800) || CASE WHEN risk_level = 'HIGH' THEN ' [HIGH]' ELSE '' END AS text, coalesce(risk_level, 'NEEDS_REVIEW') AS risk_level FROM e LEFT JOIN r USING (doc, clause_type)""")
def _(t: Tables):
    from dossier.operators.feedback import latest

    rows = latest(risk.assessed(clauses(t)).withColumn("_n", -F.col("seq")), ["doc", "clause_type"], ["_n"])
    rows = rows.select("doc", "clause_type", "clause_text", "risk_level", F.when(F.col("seq") % 3 > 0, F.concat(F.lit("c "), F.col("seq").cast("string"))).alias("reference"), F.when(F.col("seq") % 2 > 0, F.col("seq")).alias("page_no"), F.when(F.col("risk_level") == "HIGH", F.array("risk_level")).otherwise(F.array().cast("array<string>")).alias("flags"))
    return S.review_rows(rows, CLAUSES)


@R.query("s14_gap_report", f"""WITH {ITEMS_SQL}, {PLAIN_GAPS_SQL}, lns AS (SELECT evaluation_id, string_agg('| ' || rank || ' | ' || parameter || ' | ' || printf('%.1f', marks_lost::DOUBLE) || ' | ' || gap_type || ' | ' || difficulty || ' |', chr(10) ORDER BY rank) AS rows FROM gaps WHERE rank <= 10 GROUP BY evaluation_id)
SELECT evaluation_id, '# Gaps' || chr(10) || chr(10) || {SUMMARY_SQL} || chr(10) || chr(10) || CASE WHEN rows IS NOT NULL THEN '| rank | criterion | lost | gap | difficulty |' || chr(10) || '|---|---|---|---|---|' || chr(10) || rows ELSE 'No gaps.' END AS report FROM rk LEFT JOIN lns USING (evaluation_id)""")
def _(t: Tables):
    rows = items(t)
    return S.gap_report(gaps.gap_summary(rows), gaps.gap_rows(rows))


@R.query("s15_backfill", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END ELSE c_name END AS c_name, c_custkey % 6 = 0 AS changed FROM customer")
def _(t: Tables):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")).alias("c_name"))
    return S.backfilled(rows, t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("c_name")), "c_custkey", ["c_name"])


@R.query("s16_corrections", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'fixed ' || s_suppkey ELSE s_name END AS s_name FROM supplier")
def _(t: Tables):
    from dossier.operators.feedback import merged

    fixes = t.supplier.where("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.lit("fixed "), F.col("s_suppkey").cast("string")).alias("s_name"))
    return merged(t.supplier.select("s_suppkey", "s_name"), fixes, ["s_suppkey"])


@R.query("s17_pages_to_process", f"WITH {LINES_SQL} SELECT DISTINCT doc_id, page_no FROM lines WHERE page_no % 3 <> 0")
def _(t: Tables):
    pages = lines(t).select("doc_id", "page_no").distinct()
    return S.pending(pages, pages.where("page_no % 3 = 0"), ["doc_id", "page_no"])


@R.query("d1_prompts", f"""WITH c AS (SELECT conv_id AS doc, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT doc, k AS clause_type, 'Read as ' || k || ': ' || left(context, 8000) || CASE WHEN k = 'ld' THEN ' Mind: caps' ELSE ' Mind: ' END AS prompt FROM c, (VALUES ('ld'), ('scope')) v(k)""")
def _(t: Tables):
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = t.conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("doc")).agg(context.alias("context")).withColumn("clause_type", F.explode(F.array(F.lit("ld"), F.lit("scope"))))
    templates = t.spark.createDataFrame([(k, f"Read as {k}: {{context}} Mind: {{lessons}}") for k in ("ld", "scope")], "clause_type string, template string")
    return D.prompts(rows, templates, t.spark.createDataFrame([("ld", "caps")], "clause_type string, block string"))


def _answers(t: Tables):
    """Answers around the events' own JSON: fenced, with a trailing comma, cut, prose and empty, in turn."""
    p, k = F.col("props"), F.col("event_id") % 6
    body = F.expr("left(props, length(props) - 1)")
    raw = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(body, F.lit(",}"))).when(k == 2, body).when(k == 3, "no idea").when(k == 4, "").otherwise(p)
    return D.answers(t.events.select("event_id", raw.alias("raw")), "k long")


@R.query("d2_answers", "SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def _(t: Tables):
    return _answers(t).select("event_id", "parsed.k")


@R.query("d3_answer_errors", "SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'no_json' WHEN 4 THEN 'empty' END AS error FROM events")
def _(t: Tables):
    return _answers(t).select("event_id", "error")


@R.query("d4_stated_score", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND value <= 100 THEN value END AS score FROM events")
def _(t: Tables):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"Score": "'), F.col("value").cast("string"), F.lit('"'))).otherwise("none")
    return t.events.select("event_id", D.stated_score(raw).alias("score"))


@R.query("st1_live_upsert", f"WITH {FEEDBACK_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc, clause_type, user_id ORDER BY created_at DESC, id DESC) AS k FROM feedback) SELECT doc, clause_type, user_id, id FROM k WHERE k = 1")
def _(t: Tables):
    # The batch twin; the stream itself is tested against it on the same rows.
    from dossier.operators.feedback import latest

    return latest(feedback(t), ["doc", "clause_type", "user_id"], ["created_at", "id"]).select("doc", "clause_type", "user_id", "id")


@R.query("st1_live_levels", f"WITH {ADJUSTED_SQL} SELECT clause_type, offering, solution, feedback_count, direction, adjusted_level FROM adj")
def _(t: Tables):
    # The batch twin of keyed_state.consensus_stream, which a test runs on the same rows, restarts included.
    from dossier.operators.feedback import adjustments, latest

    return adjustments(latest(feedback(t), ["doc", "clause_type", "user_id"], ["created_at", "id"]), targets(t), share=0.25).select("clause_type", "offering", "solution", "feedback_count", "direction", "adjusted_level")


@R.query("st2_windowed_counts", f"WITH {FEEDBACK_SQL} SELECT date_trunc('day', created_at) AS start, clause_type, agreement, count(*) AS n FROM feedback GROUP BY ALL")
def _(t: Tables):
    rows = feedback(t).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return J.windowed_counts(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.query("st3_progress", "SELECT user_id AS job, max_by(event_type, (ts, event_id)) AS step, max_by(value, (ts, event_id)) AS pct, max_by(CASE WHEN value > 50 THEN 'done' ELSE 'running' END, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def _(t: Tables):
    return J.latest_progress(t.events.select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), F.col("value").alias("pct"), F.when(F.col("value") > 50, "done").otherwise("running").alias("status"), "ts", "event_id"))


@R.query("st4_call_rates", """WITH c AS (SELECT event_type AS provider, event_id AS call_id, epoch(date_trunc('second', ts))::BIGINT AS at_, CASE WHEN event_id % 7 = 0 THEN 429 ELSE 200 END AS status FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY provider ORDER BY at_ RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent, max(CASE WHEN status = 429 THEN at_ END) OVER (PARTITION BY provider ORDER BY at_ RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refused, row_number() OVER (PARTITION BY provider ORDER BY at_, call_id) AS place, CASE provider WHEN 'click' THEN 4 WHEN 'view' THEN 5 END AS cap FROM c)
SELECT w.provider, w.call_id, w.recent, w.recent > w.cap IS TRUE AS over_cap, coalesce(w.at_ < w.refused + 180, false) AS in_cooldown, greatest(coalesce(e.at_ + 3600 - w.at_, 0), coalesce(w.refused + 180 - w.at_, 0), 0)::BIGINT AS wait FROM w LEFT JOIN w e ON e.provider = w.provider AND e.place = w.place - w.cap""")
def _(t: Tables):
    calls = t.events.select(F.col("event_type").alias("provider"), F.col("event_id").alias("call_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 7 == 0, 429).otherwise(200).alias("status"), F.lit(None).cast("int").alias("retry_after"))
    caps = t.spark.createDataFrame([("click", 4), ("view", 5)], "provider string, cap int")
    return J.call_rates(calls, caps, window=3600).select("provider", "call_id", "recent", "over_cap", "in_cooldown", "wait")


@R.query("st5_ingest", "SELECT left(sha256(text), 16) AS fingerprint, coalesce(min(CASE WHEN doc_id % 4 = 0 THEN doc_id END), min(doc_id)) AS doc_id FROM documents GROUP BY text")
def _(t: Tables):
    # Files arrive in two lots; the stream is started for each, goes on at its offset, and skips texts that the registry holds.
    at = f"{shared_folder(t.spark)}/ingest-{uuid.uuid4().hex}"
    files = t.documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    for lot in (files.where("doc_id % 4 = 0"), files.where("doc_id % 4 <> 0")):
        write_files(lot, f"{at}/files")
        new = document_stream(t.spark, f"{at}/files", f"{at}/log", content="false").where("error IS NULL")
        rows = new.select(S.fingerprint(F.col("text"), 1 << 30).alias("fingerprint"), F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"))
        J.ingest_stream(rows, f"{at}/registry", "fingerprint", f"{at}/checkpoint", order=["doc_id"], buckets=8).awaitTermination()
    return t.spark.read.parquet(f"{at}/registry").select("fingerprint", "doc_id")


QUERIES, ORACLE = R.queries, R.oracle
