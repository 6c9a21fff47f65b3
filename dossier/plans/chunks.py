"""Line, section, chunk and table queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import chunking as C
from dossier.plans.bindings import HEADING_SQL, LINES_SQL, lines
from dossier.plans.registry import Registry, Tables

R = Registry()
# Headings of this corpus: at most 60 characters that start with a capital.
_SHAPE = [r"^[A-Z]"]
_SECTION_SQL = f"""{LINES_SQL}, hd AS (SELECT *, {HEADING_SQL} AS h FROM lines), sec AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section_no FROM hd),
sections AS (SELECT doc_id, section_no, coalesce(max(CASE WHEN h THEN trim(text) END), 'Preamble') AS heading, min_by(page_no, line_no) AS page_no, coalesce(string_agg(CASE WHEN NOT h THEN text END, chr(10) ORDER BY line_no), '') AS text, count(*) FILTER (NOT h) AS n_lines FROM sec GROUP BY ALL)"""
# Every second pair of lines as a pipe row of three cells.
_PIPE_SQL = f"""{LINES_SQL}, piped AS (SELECT doc_id, line_no, page_no, CASE WHEN line_no % 4 < 2 THEN CASE WHEN line_no % 8 = 0 THEN '|---|:--|' ELSE '| ' || line_no || ' |  | ' || left(text, 20) || ' | x' || length(text) || ' |' END ELSE text END AS text FROM lines),
bl AS (SELECT *, starts_with(trim(text), '|') AS t FROM piped), bn AS (SELECT *, coalesce(t <> lag(t) OVER (PARTITION BY doc_id ORDER BY line_no), false)::INT AS nw FROM bl), bs AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block_no FROM bn),
blocks AS (SELECT doc_id, block_no, CASE WHEN bool_or(t) THEN 'table' ELSE 'text' END AS kind, string_agg(text, chr(10) ORDER BY line_no) AS text FROM bs GROUP BY ALL),
trows AS (SELECT doc_id, block_no, line_no, text, list_filter(list_transform(string_split(text, '|'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM bs WHERE t)"""


def _sections(t: Tables):
    return C.sections(lines(t), C.is_heading(F.col("text"), _SHAPE, 60))


def _piped(t: Tables):
    row = F.when(F.col("line_no") % 8 == 0, "|---|:--|").otherwise(F.concat(F.lit("| "), F.col("line_no").cast("string"), F.lit(" |  | "), F.substring("text", 1, 20), F.lit(" | x"), F.length("text").cast("string"), F.lit(" |")))
    return lines(t).withColumn("text", F.when(F.col("line_no") % 4 < 2, row).otherwise(F.col("text")))


@R.query("c1_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, text FROM lines")
def _(t: Tables):
    return C.numbered_lines(t.documents)


@R.query("c2_estimated_page", f"WITH {LINES_SQL} SELECT doc_id, line_no, (line_no // 40 + 1)::INT AS page_no FROM lines")
def _(t: Tables):
    return C.numbered_lines(t.documents).select("doc_id", "line_no", C.estimated_page(F.col("line_no")).alias("page_no"))


@R.query("c3_headings", f"WITH {LINES_SQL} SELECT doc_id, line_no, length(trim(text)) BETWEEN 1 AND 200 AND (regexp_matches(trim(text), '^(Clause|Section|Article|Part|Schedule)\\s+\\d+') OR regexp_matches(trim(text), '^[A-Z][A-Z\\s]{{5,50}}$') OR regexp_matches(trim(text), '^\\d+\\.\\s+[A-Z]') OR regexp_matches(trim(text), '^[A-Z][a-z]+\\.$')) AS heading FROM lines")
def _(t: Tables):
    return C.numbered_lines(t.documents).select("doc_id", "line_no", C.is_heading(F.col("text"), [*C.HEADINGS, r"^[A-Z][a-z]+\.$"]).alias("heading"))


@R.query("c4_sections", f"WITH {_SECTION_SQL} SELECT doc_id, section_no, heading, page_no, text, n_lines FROM sections")
def _(t: Tables):
    return _sections(t)


@R.query("c5_long_sections", f"WITH {_SECTION_SQL} SELECT doc_id, section_no FROM sections WHERE length(trim(text)) > 50")
def _(t: Tables):
    return _sections(t).where(F.length(F.trim("text")) > 50).select("doc_id", "section_no")


@R.query("c6_clause_reference", r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(h, '(?i)(clause\s+[\d.]+)', 1)), ''), nullif(trim(regexp_extract(h, '(?i)(section\s+[\d.]+)', 1)), ''), nullif(trim(regexp_extract(h, '(?i)(article\s+[\d.]+)', 1)), ''), nullif(trim(regexp_extract(h, '(?i)(para(?:graph)?\s+[\d.]+)', 1)), ''), nullif(trim(regexp_extract(h, '(\d+\.\d+(?:\.\d+)*)', 1)), ''), left(h, 60)) AS ref
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'See Clause ' || doc_id || '.1 of it' WHEN 1 THEN 'under 4.' || doc_id || '.2 and on' WHEN 2 THEN 'PARAGRAPH ' || doc_id ELSE left(text, 100) END AS h FROM documents)""")
def _(t: Tables):
    n = F.col("doc_id").cast("string")
    heading = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("See Clause "), n, F.lit(".1 of it"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("under 4."), n, F.lit(".2 and on"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("PARAGRAPH "), n)).otherwise(F.substring("text", 1, 100))
    return t.documents.select("doc_id", C.clause_reference(heading).alias("ref"))


@R.query("c7_chunk_ids", f"WITH {_SECTION_SQL} SELECT doc_id, section_no, doc_id || '_' || page_no || '_' || left(md5(doc_id || page_no || left(text, 80)), 8) AS chunk_id FROM sections")
def _(t: Tables):
    return _sections(t).select("doc_id", "section_no", C.chunk_id(F.col("doc_id"), F.col("page_no"), F.col("text")).alias("chunk_id"))


@R.query("c8_capped_chunks", f"""WITH RECURSIVE {LINES_SQL}, ln AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, '' AS buffer, NULL::VARCHAR AS chunk FROM ln UNION ALL SELECT doc_id, i, CASE WHEN length(g) >= 1200 THEN '' ELSE g END, CASE WHEN length(g) >= 1200 THEN left(g, 1200) END FROM (SELECT ln.doc_id, ln.i, CASE WHEN buffer = '' THEN text ELSE buffer || chr(10) || text END AS g FROM f JOIN ln ON f.doc_id = ln.doc_id AND ln.i = f.i + 1)),
o AS (SELECT doc_id, i, chunk FROM f WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, i + 1, buffer FROM f WHERE buffer <> '' AND i = (SELECT max(i) FROM ln WHERE ln.doc_id = f.doc_id))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_no, chunk AS text FROM o""")
def _(t: Tables):
    return C.capped_chunks(lines(t), ["doc_id"], 1200)


@R.query("c9_blocks", f"WITH {_PIPE_SQL} SELECT doc_id, block_no, kind, text FROM blocks")
def _(t: Tables):
    return C.blocks(_piped(t))


@R.query("c10_table_to_plain", f"WITH {_PIPE_SQL} SELECT doc_id, block_no, coalesce(string_agg(CASE WHEN NOT regexp_matches(text, '^[\\s|:-]+$') THEN array_to_string(cells, ' | ') END, chr(10) ORDER BY line_no), '') AS plain FROM trows GROUP BY ALL")
def _(t: Tables):
    return C.blocks(_piped(t)).where("kind = 'table'").select("doc_id", "block_no", C.table_to_plain(F.col("text")).alias("plain"))


@R.query("c11_table_chunks", f"WITH {_PIPE_SQL}, b AS (SELECT doc_id, page_no AS table_no, string_agg(array_to_string(list_filter(list_transform(string_split(text, ','), lambda c: trim(c)), lambda c: c <> ''), ' | '), chr(10) ORDER BY line_no) AS body FROM lines WHERE trim(replace(text, ',', '')) <> '' GROUP BY ALL) SELECT doc_id, table_no, '[TABLE ' || table_no || ']' || chr(10) || body AS text FROM b WHERE length(body) > 30")
def _(t: Tables):
    rows = lines(t).select("doc_id", F.col("page_no").alias("table_no"), F.col("line_no").alias("row_no"), F.split("text", ",").alias("cells"))
    return C.table_chunks(rows)


@R.query("c12_criteria_rows", f"WITH {_PIPE_SQL} SELECT doc_id, block_no, cells[1] AS item_code, cells[2] AS parameter, array_to_string(cells[3:], ' ') AS criteria_text FROM trows WHERE len(cells) >= 3 AND regexp_matches(cells[1], '^\\d{{1,2}}$') AND try_cast(cells[1] AS INT) BETWEEN 1 AND 25")
def _(t: Tables):
    return C.criteria_rows(C.blocks(_piped(t)).where("kind = 'table'").drop("kind")).drop("row_no")


@R.query("c13_thin_pages", f"WITH {LINES_SQL} SELECT doc_id, page_no, sum(CASE WHEN regexp_matches(lower(text), '^the ') OR regexp_matches(lower(text), 'and$') THEN 0 ELSE length(trim(text)) END)::BIGINT AS real_chars, sum(CASE WHEN regexp_matches(lower(text), '^the ') OR regexp_matches(lower(text), 'and$') THEN 0 ELSE length(trim(text)) END) < 150 AS thin FROM lines GROUP BY ALL")
def _(t: Tables):
    return C.thin_pages(lines(t), ["^the ", "and$"])


@R.query("c14_filled_pages", f"WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN length(text) < 80 AND line_no % 2 = 0 AND length(text || ' again') > length(text) THEN text || ' again' ELSE text END AS text FROM lines")
def _(t: Tables):
    rows = lines(t).select("doc_id", "line_no", "text")
    return C.filled(rows, rows.where("line_no % 2 = 0").withColumn("text", F.concat("text", F.lit(" again"))), ["doc_id", "line_no"])


@R.query("c15_ocr_repair", f"WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, text, regexp_matches(lower(text), 'tion') AND (regexp_matches(text, '[0-9#@]') OR length(text) > 300) AS candidate, CASE WHEN line_no % 3 = 0 THEN text || text WHEN line_no % 3 = 1 THEN left(text, 10) END AS nw FROM lines) SELECT doc_id, line_no, candidate, CASE WHEN candidate AND length(nw) BETWEEN length(text) * 0.5 AND length(text) * 2 THEN nw ELSE text END AS text FROM c")
def _(t: Tables):
    rows = lines(t).select("doc_id", "line_no", "text")
    new = rows.where("line_no % 3 < 2").withColumn("text", F.when(F.col("line_no") % 3 == 0, F.concat("text", F.col("text"))).otherwise(F.substring("text", 1, 10)))
    return C.repaired(rows, new, ["doc_id", "line_no"], "tion", "[0-9#@]")


_TERMS = ["license", "thtion", "attion", "nowhere"]


@R.query("c16_term_coverage", f"WITH {LINES_SQL}, terms(term) AS (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _TERMS)}) SELECT term, count(page_no) AS n_chunks, coalesce(array_to_string(list_sort(list_distinct(list(page_no)))[1:5], ','), '') AS pages FROM terms LEFT JOIN lines ON contains(lower(text), term) GROUP BY term")
def _(t: Tables):
    terms = t.spark.createDataFrame([(x,) for x in _TERMS], "term string")
    return C.term_coverage(lines(t), terms).withColumn("pages", F.array_join("pages", ","))


@R.query("c17_table_inventory", f"WITH {_PIPE_SQL}, b AS (SELECT doc_id, block_no, text, length(text) - length(replace(text, '|', '')) AS bars FROM blocks WHERE kind = 'table') SELECT doc_id, count(*) AS n_tables, max_by(block_no, (length(text), -block_no)) AS longest, min(bars) AS min_bars, max(bars) AS max_bars, avg(bars) AS mean_bars FROM b GROUP BY doc_id")
def _(t: Tables):
    return C.table_inventory(C.blocks(_piped(t)).where("kind = 'table'"))


QUERIES, ORACLE = R.queries, R.oracle
