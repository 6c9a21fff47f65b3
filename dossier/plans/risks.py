"""Clause risk queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.text import contains_any, percentage
from dossier.operators import risk as K
from dossier.plans.bindings import CLAUSE_SQL, clauses
from dossier.plans.registry import Registry, Tables

R = Registry()


def _has(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in phrases) + ")"


def _labels(text: str, pairs: list[tuple[str, str]]) -> str:
    order = list(dict.fromkeys(label for _, label in pairs))
    cases = ", ".join(f"CASE WHEN {_has(text, [p for p, x in pairs if x == label])} THEN '{label}' END" for label in order)
    return f"list_filter(list_value({cases}), lambda x: x IS NOT NULL)"


_PCT = r"try_cast(nullif(regexp_extract(ld_cap_text, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE)"
_CAPLESS = f"({_has('clause_text', K.UNCAPPED)} OR coalesce({_has('ld_cap_text', K.UNCAPPED)}, false))"
_DAMAGES = f"CASE WHEN {_CAPLESS} THEN 'HIGH' WHEN {_PCT} IS NULL THEN 'NEEDS_REVIEW' WHEN {_PCT} <= 10 THEN 'ACCEPTABLE' WHEN {_PCT} < 20 THEN 'MEDIUM' ELSE 'HIGH' END"
_DAYS = r"coalesce(replacement_days, try_cast(nullif(regexp_extract(lower(clause_text), 'replacement.*?(\d+)\s*days?', 1), '') AS INT))"
_ISSUES = r"""list_filter([CASE WHEN NOT (regexp_matches(lower(clause_text), '\d+\s*days?\s*(of|from|after)\s*(invoice|billing)') OR regexp_matches(lower(clause_text), 'payment\s*within\s*\d+')) THEN 'no invoice cycle' END,
 CASE WHEN NOT (regexp_matches(lower(clause_text), '\d+\s*days?\s*(to|for)\s*(approv|comment|review)') OR regexp_matches(lower(clause_text), 'deemed.*approv')) THEN 'no approval timeline' END], lambda x: x IS NOT NULL)"""
_BLACK, _ENDED, _FINED, _PAST = (_has("clause_text", w) for w in (K.BLACKLISTING, K.TERMINATED, K.PENALISED, K.HISTORICAL))
_ELIGIBLE = f"list_filter([CASE WHEN {_BLACK} THEN 'blacklisting' END, CASE WHEN {_ENDED} OR {_FINED} THEN 'termination or penalty' END, CASE WHEN is_no_deviation AND ({_BLACK} OR {_ENDED} OR {_FINED}) THEN 'no deviation' END, CASE WHEN {_PAST} AND ({_BLACK} OR {_ENDED}) THEN 'say is not instead of has not been' END], lambda x: x IS NOT NULL)"
_LIABILITY = f"CASE WHEN {_has('clause_text', K.UNCAPPED)} OR {_has('coalesce(cap_info, chr(0))', K.UNCAPPED)} THEN 'HIGH' WHEN {_has('coalesce(cap_info, chr(0))', K.ABOVE_CONTRACT)} THEN 'HIGH' WHEN coalesce(cap_info, '') <> '' THEN 'ACCEPTABLE' ELSE 'NEEDS_REVIEW' END"
_RULES = {
    "liability": _LIABILITY,
    "insurance": f"CASE WHEN {_has('clause_text', K.INSURANCE)} THEN 'HIGH' ELSE 'LOW' END",
    "scope": f"CASE WHEN {_has('clause_text', [p for p, _ in K.SCOPE])} THEN 'HIGH' ELSE 'LOW' END",
    "payment": f"CASE WHEN len({_ISSUES}) > 0 THEN 'MEDIUM' ELSE 'ACCEPTABLE' END",
    "deliverables": "'LOW'",
    "personnel": f"CASE WHEN {_DAYS} IS NULL OR {_DAYS} <= 30 THEN 'MEDIUM' ELSE 'ACCEPTABLE' END",
    "ld": _DAMAGES,
    "penalties": _DAMAGES,
    "termination": f"CASE WHEN NOT {_has('clause_text', K.MAY_TERMINATE)} THEN 'HIGH' ELSE 'ACCEPTABLE' END",
    "eligibility": f"CASE WHEN len({_ELIGIBLE}) > 0 THEN 'HIGH' ELSE 'LOW' END",
}
_SQL = f"{CLAUSE_SQL}, assessed AS (SELECT *, CASE clause_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in _RULES.items())} ELSE 'NEEDS_REVIEW' END AS risk_level FROM clauses)"


@R.query("r1_first_percentage", f"WITH {CLAUSE_SQL} SELECT doc, seq, {_PCT} AS pct FROM clauses")
def _(t: Tables):
    return clauses(t).select("doc", "seq", percentage("ld_cap_text").alias("pct"))


@R.query("r2_uncapped", f"WITH {CLAUSE_SQL} SELECT doc, seq, {_has('clause_text', K.UNCAPPED)} AS uncapped FROM clauses")
def _(t: Tables):
    return clauses(t).select("doc", "seq", contains_any(F.col("clause_text"), K.UNCAPPED).alias("uncapped"))


def _register(number: int, kind: str, labels: str | None) -> None:
    extra = f", list_aggregate({labels}, 'string_agg', ',') AS triggers" if labels else ""

    @R.query(f"r{number}_{kind}", f"WITH {_SQL} SELECT doc, seq, risk_level{extra} FROM assessed WHERE clause_type = '{kind}'")
    def _(t: Tables):
        got = K.assessed(clauses(t).where(F.col("clause_type") == kind))
        return got.select("doc", "seq", "risk_level", *([F.nullif(F.array_join("triggers", ","), F.lit("")).alias("triggers")] if labels else []))


for _n, _kind, _l in ((3, "liability", None), (4, "insurance", _labels("clause_text", [(p, p) for p in K.INSURANCE])), (5, "scope", _labels("clause_text", K.SCOPE)), (6, "payment", _ISSUES), (7, "deliverables", None), (8, "personnel", None), (9, "ld", None), (10, "penalties", None), (11, "termination", None), (12, "eligibility", _ELIGIBLE)):
    _register(_n, _kind, _l)


@R.query("r13_dispatch", f"WITH {_SQL} SELECT doc, seq, clause_type, risk_level FROM assessed")
def _(t: Tables):
    return K.assessed(clauses(t)).select("doc", "seq", "clause_type", "risk_level")


_REMARKS_SQL = "remarks(clause_type, risk_level, remark) AS (VALUES " + ", ".join(str(r) for r in K.REMARKS) + ")"


@R.query("r14_remarks", f"WITH {_SQL}, {_REMARKS_SQL} SELECT doc, seq, coalesce(remark, '') AS remark FROM assessed LEFT JOIN remarks USING (clause_type, risk_level)")
def _(t: Tables):
    remarks = t.spark.createDataFrame(K.REMARKS, "clause_type string, risk_level string, remark string")
    return K.with_remarks(K.assessed(clauses(t)), remarks).select("doc", "seq", "remark")


@R.query("r15_document_summary", f"""WITH {_SQL} SELECT doc, {', '.join(f"count(*) FILTER (risk_level = '{x}') AS n_{x.lower()}" for x in ('ACCEPTABLE', 'LOW', 'MEDIUM', 'HIGH', 'NEEDS_REVIEW'))},
coalesce(string_agg(DISTINCT CASE WHEN risk_level = 'HIGH' THEN clause_type END, ',' ORDER BY CASE WHEN risk_level = 'HIGH' THEN clause_type END), '') AS high, coalesce(string_agg(DISTINCT CASE WHEN risk_level = 'MEDIUM' THEN clause_type END, ',' ORDER BY CASE WHEN risk_level = 'MEDIUM' THEN clause_type END), '') AS medium FROM assessed GROUP BY doc""")
def _(t: Tables):
    return K.document_summary(K.assessed(clauses(t)))


QUERIES, ORACLE = R.queries, R.oracle
