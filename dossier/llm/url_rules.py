"""URL rules by a sort-merge range join over reversed-host keys, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.llm.common import table

#: A host's labels in reverse, each ended by this: a host's key then starts every key of its subdomains. The path follows after PATH.
MARK, PATH = "\x01", "\x00"
#: What stands for these in a label, so that neither is in one.
ESCAPES = [("\x02", "\x02c"), (MARK, "\x02b"), (PATH, "\x02a")]
#: Rules of one run of the sorted rules, on average, and the most runs; points that one bucket of a run sweeps.
RUN, RUNS, POINTS = 4096, 4096, 200_000
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(labels: Column) -> Column:
    """The key of reversed labels; empty for none. Control characters in labels are escaped, so only equal labels have equal keys."""

    def one(label: Column) -> Column:
        for plain, escaped in ESCAPES:
            label = F.replace(label, F.lit(plain), F.lit(escaped))
        return F.concat(label, F.lit(MARK))

    return F.array_join(F.transform(labels, one), "")


def _labels(host: Column) -> Column:
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.")))


def _binary(host: Column, path: Column) -> Column:
    """The canonical key in bytes, whose order is that of the sweep."""
    return F.encode(F.concat(host, F.lit(PATH), path), "UTF-8")


def _run_of(key: Column, edges: list[bytes]) -> Column:
    """How many of the sorted edges are at or before a key, by binary search."""
    if not edges:
        return F.lit(0)
    held = F.lit(edges)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(at + step <= len(edges), F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at)).otherwise(at))


def judged(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", run: int = RUN, points: int = POINTS) -> DataFrame:
    """pages with host, path, rule and verdict; rules are rows of host, path, verdict.

    Keys are reversed hosts followed by the path, so a rule is the interval of all keys that start with its own, and
    such intervals nest. A url is a point for its host and for each parent domain that a rule's host could be. Points,
    and the rules' opening and closing ends, are sorted together; a closing end says which rule is active again below it, so the last
    end before a point is the top of the stack of active rules. Of a url's points the longest rule (host and path)
    wins, a deeper host first, then block.

    Equal (host, path) are one url first, so hot ones are one row. Rules are cut into runs of about `run` by their keys
    (4096 runs at most); a run's points are dealt to buckets of about `points`, and only its own rules go with them.
    Null urls and urls without `://` have empty host and path and get the default, as all rows no rule fits. Rules
    without host fit rows without host only; nulls in rules are empty, of repeated rules with several verdicts block
    counts. Columns of pages that are called host, path, rule or verdict are replaced; no pages give no rows, no rules
    the default.
    """
    host, path = split_url(F.col(url).cast("string"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    clean = rules.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict")])
    clean = clean.groupBy("host", "path").agg(F.min_by("verdict", F.col("verdict") != "block").alias("verdict")).withColumn("key", _binary(host_key(_labels(F.col("host"))), F.col("path")))
    n, deepest = clean.select(F.count("*"), F.max(F.size(_labels(F.col("host"))))).first()
    if not n:
        return rows.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    edges = sorted(bytes(r[0]) for r in clean.where(F.pmod(F.xxhash64("key"), F.lit(max(run, n // RUNS))) == 0).select("key").collect()) if n > run else []

    # Ends: a rule opens at its key and closes after all keys that start with it, where the longest rule around it is active again.
    around = clean.select("key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("k")).select("key", F.substring(F.col("key"), F.lit(1), F.col("k")).alias("prefix")).where(F.length("key") > 1)
    parent = around.join(clean.select(F.col("key").alias("prefix")), "prefix").groupBy("key").agg(F.max("prefix").alias("outer"))
    facts = lambda p: F.struct(F.col(f"{p}.host").alias("host"), F.col(f"{p}.path").alias("path"), F.col(f"{p}.verdict").alias("verdict"))
    nested = clean.alias("r").join(parent.alias("p"), F.col("r.key") == F.col("p.key"), "left").join(clean.alias("o"), F.col("p.outer") == F.col("o.key"), "left")
    end = nested.select(F.col("r.key").alias("key"), facts("r").alias("own"), F.when(F.col("o.key").isNotNull(), facts("o")).alias("outer"))
    opens = end.select("key", F.struct(F.col("own").alias("active")).alias("end"))
    closes = end.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.struct(F.col("outer").alias("active")).alias("end"))
    ends = opens.unionByName(closes).withColumn("run", _run_of(F.col("key"), edges))

    urls = rows.select("host", "path").distinct()
    labels = _labels(F.col("host"))
    parts = F.when(F.col("host") == "", F.sequence(F.lit(0), F.lit(0))).otherwise(F.when(F.least(F.size(labels), F.lit(deepest)) >= 1, F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))))
    asked = urls.select("host", "path", F.explode(parts).alias("k")).withColumn("key", _binary(host_key(F.slice(labels, 1, F.col("k"))), F.col("path"))).withColumn("run", _run_of(F.col("key"), edges))
    spread = {r["run"]: max(1, -(-r["count"] // points)) for r in asked.groupBy("run").count().collect()}
    buckets = F.lit(1) if len(set(spread.values())) <= 1 and 1 in spread.values() else F.get(F.array(*[F.lit(spread.get(k, 1)) for k in range(len(edges) + 1)]), F.col("run"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("host", "path"), buckets).cast("int"))
    ends = ends.withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))
    events = asked.unionByName(ends, allowMissingColumns=True)
    sweep = W.partitionBy("run", "bucket").orderBy("key", F.col("end").isNull()).rowsBetween(W.unboundedPreceding, 0)
    top = events.withColumn("top", F.last("end", ignorenulls=True).over(sweep)).where("k is not null").select("host", "path", "top.active").where("active is not null")
    fits = F.struct((F.length("active.host") + F.length("active.path")).alias("size"), F.length("active.host").alias("deep"), (F.col("active.verdict") == "block").alias("block"), F.concat("active.host", "active.path").alias("rule"), F.col("active.verdict").alias("verdict"))
    won = top.groupBy("host", "path").agg(F.max(fits).alias("won"))
    return rows.join(won, ["host", "path"], "left").select(*kept, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (page_id)
"""
