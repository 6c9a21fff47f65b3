"""The domain's frames over the driver's tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.plans.registry import Tables

CLAUSES = ["deliverables", "eligibility", "insurance", "ld", "liability", "payment", "penalties", "personnel", "scope", "termination"]
LEVELS = ["ACCEPTABLE", "LOW", "MEDIUM", "HIGH"]

_ALL = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_CLAUSE_SQL = "list_value(" + ", ".join(f"'{c}'" for c in CLAUSES) + ")"

#: Score items: evaluations are orders, marks are quantities out of 50, every seventh row is live or comparative.
ITEMS_SQL = f"""
seqs AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL})::INT AS item_seq FROM lineitem),
items AS (SELECT l_orderkey AS evaluation_id, item_seq, item_seq::VARCHAR AS item_code, p_name AS parameter, 50 AS max_marks, l_quantity::DECIMAL(10,1) AS score,
  l_returnflag <> 'N' AS evidence_found, l_linestatus = 'F' AS verified, item_seq % 4 = 0 AS is_sub_item, false AS is_parent, 'document' AS evaluation_layer, p_type AS extracted_value,
  CASE item_seq % 7 WHEN 6 THEN 'pending_live' WHEN 5 THEN 'comparative' ELSE 'scored' END AS score_state, l_shipdate AS ts, p_brand, l_partkey
  FROM seqs JOIN part ON l_partkey = p_partkey)"""


def items(t: Tables) -> DataFrame:
    order = [c.strip() for c in _ALL.split(",")]
    seq = t.lineitem.withColumn("item_seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))
    part = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    state = F.when(F.col("item_seq") % 7 == 6, "pending_live").when(F.col("item_seq") % 7 == 5, "comparative").otherwise("scored")
    return seq.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("evaluation_id"), "item_seq", F.col("item_seq").cast("string").alias("item_code"), F.col("p_name").alias("parameter"), F.lit(50).alias("max_marks"), F.col("l_quantity").cast("decimal(10,1)").alias("score"),
        (F.col("l_returnflag") != "N").alias("evidence_found"), (F.col("l_linestatus") == "F").alias("verified"), (F.col("item_seq") % 4 == 0).alias("is_sub_item"), F.lit(False).alias("is_parent"), F.lit("document").alias("evaluation_layer"),
        F.col("p_type").alias("extracted_value"), state.alias("score_state"), F.col("l_shipdate").alias("ts"), "p_brand", "l_partkey")


#: Clauses: lines of orders, with a cap of 0-20 percent, days to replace, and texts by flags.
CLAUSE_SQL = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL})::INT AS seq FROM lineitem),
clauses AS (SELECT l_orderkey AS doc, seq, {_CLAUSE_SQL}[((l_orderkey + seq) % 10 + 1)::INT] AS clause_type,
  CASE l_returnflag WHEN 'A' THEN 'The Firm may terminate. Payment within 30 days of invoice; total liability not limited' WHEN 'R' THEN 'Replacement of staff within 45 days; has not been blacklisted; co-insured' ELSE 'Supervision of construction and legal services; deemed to be approved' END || CASE WHEN l_linestatus = 'F' THEN ' unlimited' ELSE '' END AS clause_text,
  CASE WHEN l_tax < 0.02 THEN '' WHEN l_tax < 0.04 THEN '2x contract value' WHEN l_tax < 0.06 THEN 'contract value' END AS cap_info,
  CASE WHEN l_tax < 0.07 THEN cast(cast(l_discount * 200 AS DECIMAL(5,2)) AS VARCHAR) || ' % of the fee' END AS ld_cap_text,
  CASE WHEN l_tax < 0.05 THEN date_diff('day', o_orderdate, l_shipdate)::INT END AS replacement_days, l_quantity > 40 AS is_no_deviation
  FROM numbered JOIN orders ON l_orderkey = o_orderkey)"""


def clauses(t: Tables) -> DataFrame:
    order = [c.strip() for c in _ALL.split(",")]
    rows = t.lineitem.withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))).join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = F.when(F.col("l_returnflag") == "A", "The Firm may terminate. Payment within 30 days of invoice; total liability not limited").when(F.col("l_returnflag") == "R", "Replacement of staff within 45 days; has not been blacklisted; co-insured").otherwise("Supervision of construction and legal services; deemed to be approved")
    kind = F.element_at(F.array(*[F.lit(c) for c in CLAUSES]), ((F.col("l_orderkey") + F.col("seq")) % 10 + 1).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("doc"), "seq", kind.alias("clause_type"), F.concat(text, F.when(F.col("l_linestatus") == "F", " unlimited").otherwise("")).alias("clause_text"),
        F.when(F.col("l_tax") < 0.02, "").when(F.col("l_tax") < 0.04, "2x contract value").when(F.col("l_tax") < 0.06, "contract value").alias("cap_info"),
        F.when(F.col("l_tax") < 0.07, F.concat((F.col("l_discount") * 200).cast("decimal(5,2)").cast("string"), F.lit(" % of the fee"))).alias("ld_cap_text"),
        F.when(F.col("l_tax") < 0.05, F.datediff("l_shipdate", "o_orderdate")).alias("replacement_days"), (F.col("l_quantity") > 40).alias("is_no_deviation"))


#: Feedback: events, the user's nation and region as offering and solution.
FEEDBACK_SQL = f"""
feedback AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc, user_id, ts AS created_at, {_CLAUSE_SQL}[(event_id % 10 + 1)::INT] AS clause_type,
  CASE event_type WHEN 'error' THEN 'too_high' WHEN 'signup' THEN 'too_low' WHEN 'purchase' THEN 'incorrect' ELSE 'agree' END AS agreement,
  CASE WHEN value < 5 THEN NULL WHEN value < 20 THEN 'LOW' WHEN value < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS suggested_level,
  CASE WHEN value < 30 THEN 'MEDIUM' ELSE 'HIGH' END AS system_level, n_name AS offering, CASE WHEN user_id % 11 = 0 THEN '' ELSE r_name END AS solution,
  CASE WHEN event_id % 3 = 0 THEN 'comment number ' || event_id END AS comment
  FROM events JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def feedback(t: Tables) -> DataFrame:
    rows = t.events.join(t.nation, F.col("user_id") % 25 == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    agreement = F.when(F.col("event_type") == "error", "too_high").when(F.col("event_type") == "signup", "too_low").when(F.col("event_type") == "purchase", "incorrect").otherwise("agree")
    level = F.when(F.col("value") < 5, None).when(F.col("value") < 20, "LOW").when(F.col("value") < 60, "MEDIUM").otherwise("HIGH")
    return rows.select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("doc"), "user_id", F.col("ts").alias("created_at"), F.element_at(F.array(*[F.lit(c) for c in CLAUSES]), (F.col("event_id") % 10 + 1).cast("int")).alias("clause_type"),
        agreement.alias("agreement"), level.alias("suggested_level"), F.when(F.col("value") < 30, "MEDIUM").otherwise("HIGH").alias("system_level"), F.col("n_name").alias("offering"),
        F.when(F.col("user_id") % 11 == 0, "").otherwise(F.col("r_name")).alias("solution"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("comment number "), F.col("event_id").cast("string"))).alias("comment"))


#: Lines of documents, with a page for every five, and headings: at most 60 characters that start with a capital.
LINES_SQL = """
lines AS (SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS text, ((i - 1) // 5 + 1)::INT AS page_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i) WHERE trim(l[i]) <> '')"""
HEADING_SQL = "(length(trim(text)) <= 60 AND regexp_matches(trim(text), '^[A-Z]'))"


def lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.where("trim(text) <> ''").withColumn("page_no", (F.floor(F.col("line_no") / 5) + 1).cast("int"))
