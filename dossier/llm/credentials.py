"""Secret scans that link the parts of a credential, with DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.llm.common import table

#: Code points between two parts of one credential, at most.
SCOPE = 300


def either(word: str) -> str:
    """A pattern of a word whose letters A-Z stand in either case, and no other letters."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in word)


def _first(words: str) -> str:
    """Fails at once where no word of the alternatives can begin, which is nearly everywhere."""
    return f"(?=[{''.join(sorted({c for w in words.split('|') for c in (w[0], w[0].upper())}))}])"


def _named(words: str, value: str) -> str:
    """A name, a colon or equals sign, and a value, whose characters are group 2."""
    return rf"""{_first(words)}({either(words)})["']?\x20*[:=]\x20*["']?({value}+)"""


ASSIGN, LOGIN, PASS = "password|passwd|secret|token|api_?key", "user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|key_?id", "pwd|pass|passphrase|private_?key|credentials?"
SERVICE = "https?|s?ftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?"


class Pattern(NamedTuple):
    """Matches whose measured part (group 2 if `named`) has `least` characters are of `kind`; shorter ones, of `part_least` or more, are parts of `part` kind."""

    regex: str
    named: bool
    kind: str | None
    least: int
    part: str | None = None
    part_least: int = 0


#: The base kinds and the weak ones, in the order of spans with one start; what each is in a credential; those of a higher tier yield to overlapping ones of a lower.
KINDS = ["assign", "access", "hex", "key_id", "key_part", "opaque", "endpoint"]
ROLE = {"assign": "secret", "access": "id", "key_id": "id", "key_part": "secret", "opaque": "secret", "endpoint": "endpoint"}
TIER = {"assign": 0, "access": 0, "hex": 0, "key_id": 1, "key_part": 1, "opaque": 2, "endpoint": 1}
#: A run of 16 hex digits or more is the same match as a whole run that proves long enough, and shorter runs, of which prose is full, are never listed.
PATTERNS = [
    Pattern(_named(ASSIGN, "[A-Za-z0-9+/_.=-]"), True, "assign", 12, "key_part", 6),
    Pattern("AKIA[A-Z0-9]+", False, "access", 18, "key_id", 12),
    Pattern("[0-9a-f]{16,}", False, "hex", 16),
    Pattern(_named(LOGIN, "[A-Za-z0-9+/_.=@-]"), True, None, 0, "key_id", 3),
    Pattern(_named(PASS, "[A-Za-z0-9+/_.=-]"), True, None, 0, "key_part", 6),
    Pattern("[A-Za-z0-9+/]{32,}={0,2}", False, None, 0, "opaque", 32),
    Pattern(rf"{_first(SERVICE)}(?:{either(SERVICE)})://[A-Za-z0-9._:-]+", False, None, 0, "endpoint", 8),
]
HEX = 2
#: What a text holds if any pattern but that of hex digits can match, or matter: without an identifier or a secret nothing weak stays.
NAMED = rf"""{_first(f"{ASSIGN}|{LOGIN}|{PASS}")}(?:{either(f"{ASSIGN}|{LOGIN}|{PASS}")})["']?\x20*[:=]"""


def _found(text: Column, number: int, p: Pattern) -> Column:
    """An array of pattern, place, gap, size, kind, match: each match with the number of characters since the one before; kind is null where it is too short."""
    gaps = F.transform(F.split(text, p.regex, -1), F.length)
    measured = (lambda m: F.length(F.regexp_extract(m, p.regex, 2))) if p.named else F.length

    def kind(m: Column) -> Column:
        part = F.when(measured(m) >= p.part_least, p.part) if p.part else F.lit(None).cast("string")
        if p.part == "opaque":
            part = F.when(m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"), p.part)
        return F.when(measured(m) >= p.least, p.kind).otherwise(part) if p.kind else part

    matches = F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), lambda m: F.struct(F.length(m).alias("size"), kind(m).alias("kind"), m.alias("match")))
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("m")), lambda x: x["m"].isNotNull())
    return F.transform(rows, lambda x, i: F.struct(F.lit(number).alias("pattern"), i.alias("place"), x["gap"].alias("gap"), x["m"]["size"].alias("size"), x["m"]["kind"].alias("kind"), x["m"]["match"].alias("match")))


def credentials(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """doc_id and spans, an array of (start, end, kind, match) by start and kind, for every row of docs.

    Base spans (assign, access, hex) stand by themselves. Others are candidates for a part of a credential: an
    identifier (key_id: a named login, or an access id too short for the base), a secret (key_part: a named value too
    short for the base or under a lesser name; opaque: 32 characters of three classes) or an endpoint (a url of a
    service). A candidate that overlaps a base span, or an opaque one that overlaps a named one, goes. The rest meet by
    a sorted sweep over each text's spans, which carries the last end and the next start of each role: an identifier
    stays if a secret lies within `scope` code points, a secret if an identifier does, an endpoint if both do.

    Matching is leftmost and without overlaps in each pattern, over the whole text; places are in code points, ends
    exclusive. Only matches are shuffled, dealt by row and never by text or id, so repeated rows and ids are rows of
    their own and no group is larger than one text's matches. Null and empty texts have no spans, a null doc_id stays;
    other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole, none = F.col("text"), F.array().cast("array<struct<pattern:int,place:int,gap:int,size:int,kind:string,match:string>>")
    named = F.contains(whole, F.lit("AKIA")) | (whole.rlike("[:=]") & whole.rlike(NAMED))
    listed = {k: _found(whole, k, p) for k, p in enumerate(PATTERNS)}
    digits = listed.pop(HEX)
    each = F.concat(F.when(named, F.concat(*listed.values())).otherwise(none), F.when(whole.rlike(PATTERNS[HEX].regex), digits).otherwise(none))
    parts = rows.select("row", "doc_id", F.explode_outer(each).alias("m")).select("row", "doc_id", "m.*").repartition("row")

    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "pattern").orderBy("place"))
    known = F.map_from_arrays(F.lit(KINDS), F.lit(list(range(len(KINDS)))))
    tier = F.map_from_arrays(F.lit(KINDS), F.lit([TIER[k] for k in KINDS]))
    role = F.map_from_arrays(F.lit(list(ROLE)), F.lit(list(ROLE.values())))
    first = F.row_number().over(W.partitionBy("row").orderBy("pattern", "place"))
    spans = parts.withColumns({"end": end, "k": first}).where("kind is not null or k = 1")
    spans = spans.withColumns({"start": F.col("end") - F.col("size"), "order": known[F.col("kind")], "tier": tier[F.col("kind")]})

    by_start = W.partitionBy("row").orderBy("start", "order")
    before, after = by_start.rowsBetween(W.unboundedPreceding, -1), by_start.rowsBetween(1, W.unboundedFollowing)
    covered = F.lit(False)
    for t in (1, 2):
        lower = F.col("tier") < t
        overlaps = (F.max(F.when(lower, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(lower, F.col("start"))).over(after) < F.col("end"))
        covered = covered | ((F.col("tier") == t) & F.coalesce(overlaps, F.lit(False)))
    spans = spans.withColumn("kind", F.when(~covered, F.col("kind"))).withColumn("role", role[F.col("kind")])

    def near(what: str) -> Column:
        own = F.col("role") == what
        behind = F.col("start") - F.max(F.when(own, F.col("end"))).over(before) <= scope
        ahead = F.min(F.when(own, F.col("start"))).over(after) - F.col("end") <= scope
        return F.coalesce(behind, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    spans = spans.withColumns({"near_id": near("id"), "near_secret": near("secret")})
    stays = (F.col("tier") == 0) | F.when(F.col("role") == "id", F.col("near_secret")).when(F.col("role") == "secret", F.col("near_id")).otherwise(F.col("near_id") & F.col("near_secret"))
    kept = F.collect_list(F.when(F.col("kind").isNotNull() & stays, F.struct("start", "order", "end", "kind", "match")))
    grouped = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(kept).alias("s"))
    return grouped.select("doc_id", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match"))).alias("spans"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return credentials(table(spark, sf_dir, "documents")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same spans by plain joins: whole runs of hex digits, overlaps and links looked up among all spans of a text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    plain = lambda p: "[0-9a-f]+" if p.kind == "hex" else p.regex[p.regex.index("])") + 2 :] if p.regex.startswith("(?=") else p.regex
    patterns = ", ".join(f"({k}, {quoted(plain(p))}, {p.named}, {quoted(p.kind) if p.kind else 'NULL'}, {p.least}, {quoted(p.part) if p.part else 'NULL'}, {p.part_least})" for k, p in enumerate(PATTERNS))
    kinds = ", ".join(f"({i}, {quoted(k)}, {TIER[k]}, {quoted(ROLE[k]) if k in ROLE else 'NULL'})" for i, k in enumerate(KINDS))
    near = lambda role: f"EXISTS (SELECT 1 FROM open o WHERE o.row = s.row AND o.role = '{role}' AND o.start - s.fin <= {SCOPE} AND s.start - o.fin <= {SCOPE} AND (o.start, o.no) <> (s.start, s.no))"
    said = lambda part: f"coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, no) FILTER ({part}), '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
patterns(p, re, named, base, least, part, part_least) AS (VALUES {patterns}), kinds(no, kind, tier, role) AS (VALUES {kinds}),
found AS (SELECT row, patterns.*, unnest(string_split_regex(text, re)) AS gap, unnest(regexp_extract_all(text, re)) AS match, generate_subscripts(string_split_regex(text, re), 1) AS i FROM d, patterns WHERE regexp_matches(text, re)),
placed AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY row, p ORDER BY i) AS fin, CASE WHEN named THEN length(regexp_extract(match, re, 2)) ELSE length(match) END AS measured FROM found WHERE match IS NOT NULL),
named_ AS (SELECT row, fin - length(match) AS start, fin, CASE WHEN base IS NOT NULL AND measured >= least THEN base WHEN part = 'opaque' AND NOT (regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]')) THEN NULL WHEN measured >= part_least THEN part END AS kind FROM placed),
spans AS (SELECT named_.*, no, tier, role FROM named_ JOIN kinds USING (kind)),
open AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.row = s.row AND o.tier < s.tier AND o.start < s.fin AND o.fin > s.start)),
kept AS (SELECT * FROM open s WHERE tier = 0 OR (role = 'id' AND {near("secret")}) OR (role = 'secret' AND {near("id")}) OR (role = 'endpoint' AND {near("id")} AND {near("secret")}))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256({said("tier = 0")}) AS base_sha256, {said("true")} AS spans
FROM d LEFT JOIN kept USING (row) GROUP BY row
"""


ORACLE = _sql()
