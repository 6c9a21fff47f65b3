"""Joins of names by what they hold: strings within strings, and sets of words that share most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the grams by which strings are looked up; shorter strings are looked up whole.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def within(a: DataFrame, b: DataFrame, scope: list[str], gram: int = GRAM) -> DataFrame:
    """scope, a, b: the pairs of strings of a and of b (scope and a column `text`) in one scope of which either holds the other.

    Every string's grams are its postings. A string that may lie in others is looked up by the one of its grams that
    fewest strings of its scope have, and each candidate is verified; so what is compared grows with the rarest
    gram's postings, not with the product. Blank and null strings pair with nothing here.
    """
    side = lambda df, k: df.select(*scope, "text", F.lit(k == 0).alias("in_a"), F.lit(k == 1).alias("in_b"))
    texts = side(a, 0).unionByName(side(b, 1)).where("text <> ''").groupBy(*scope, "text").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    sizes = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), k) for k in range(1, gram + 1)])))
    postings = texts.select(*scope, "text", "in_a", "in_b", F.explode(sizes).alias("gram"))
    own = F.least(F.length("text"), F.lit(gram))
    asked = texts.select(*scope, "text", "in_a", "in_b", F.explode(_sized(F.col("text"), own, gram)).alias("gram"))
    often = postings.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, [*scope, "gram"]).groupBy(*scope, "text", "in_a", "in_b").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    needle = rarest.select(*scope, "gram", F.col("text").alias("needle"), F.col("in_a").alias("needle_a"), F.col("in_b").alias("needle_b"))
    met = needle.join(postings, [*scope, "gram"]).where(F.contains("text", F.col("needle")))
    ways = F.array(F.when(F.col("needle_a") & F.col("in_b"), F.struct(F.col("needle").alias("a"), F.col("text").alias("b"))), F.when(F.col("needle_b") & F.col("in_a"), F.struct(F.col("text").alias("a"), F.col("needle").alias("b"))))
    return met.select(*scope, F.explode(F.array_compact(ways)).alias("p")).select(*scope, "p.a", "p.b").distinct()


def _sized(text: Column, size: Column, gram: int) -> Column:
    out = _grams(text, gram)
    for k in range(1, gram):
        out = F.when(size == k, _grams(text, k)).otherwise(out)
    return out


def with_blanks(pairs: DataFrame, a: DataFrame, b: DataFrame, scope: list[str]) -> DataFrame:
    """pairs (scope, a, b) and those of a blank string, which pairs with every string of the other side, blank ones included."""
    one = a.select(*scope, F.col("text").alias("a")).where("a is not null").distinct()
    two = b.select(*scope, F.col("text").alias("b")).where("b is not null").distinct()
    if scope:
        return pairs.unionByName(one.join(two.where("b = ''"), scope)).unionByName(two.where("b <> ''").join(one.where("a = ''"), scope).select(*scope, "a", "b"))
    some = lambda df, c: df.agg(F.coalesce(F.max(F.col(c) == ""), F.lit(False))).scalar()
    return pairs.unionByName(one.where(some(two, "b")).select("a", F.lit("").alias("b"))).unionByName(two.where("b <> ''").where(some(one, "a")).select(F.lit("").alias("a"), "b"))


def in_order(words: Column) -> Column:
    """A set of words as one array: distinct, sorted, without nulls."""
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isNotNull())))


def close(a: DataFrame, b: DataFrame, scope: list[str], least: float) -> DataFrame:
    """scope, x, y, share: the pairs of sets of words of a and of b (scope, words) that share `least` of their words or more.

    Equal sets meet once. A scope's words are put in order of rarity; two sets that share enough must share one of their
    rarest few (a prefix filter), at places that leave room for as many more as they need (a position filter), so a
    word that every set holds brings only sets together that are close without it, or so small that it makes them close. Empty sets pair with nothing.
    """
    side = lambda df, asks: df.select(*scope, in_order(F.col("words")).alias("words"), F.lit(asks).alias("asks"))
    sets = side(a, True).unionByName(side(b, False)).where(F.size("words") > 0).distinct()
    tokens = sets.select("*", F.explode("words").alias("w"))
    often = tokens.groupBy(*scope, "w").agg(F.count("*").alias("n"))
    ranked = tokens.join(often, [*scope, "w"]).groupBy(*scope, "words", "asks").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda t: t["w"]).alias("rare"))
    size = F.size("words")
    prefix = ranked.select("*", F.posexplode(F.slice("rare", 1, size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1)).alias("at", "w"))
    left = prefix.where("asks").select(*scope, "w", F.col("words").alias("x"), F.col("at").alias("i"))
    right = prefix.where("not asks").select(*scope, "w", F.col("words").alias("y"), F.col("at").alias("j"))
    n, m = F.size("x"), F.size("y")
    most = F.least("i", "j") + 1 + F.least(n - F.col("i") - 1, m - F.col("j") - 1)
    near = (n >= F.lit(least) * m - 1e-9) & (m >= F.lit(least) * n - 1e-9) & (most * (1 + least) >= F.lit(least) * (n + m) - 1e-9)
    both = F.size(F.array_intersect("x", "y"))
    return left.join(right, [*scope, "w"]).where(near).select(*scope, "x", "y").distinct().withColumn("share", both / (n + m - both)).where(F.col("share") >= least)


def closest(a: DataFrame, b: DataFrame, scope: list[str], least: float) -> DataFrame:
    """scope, words, share, rank: for each set of words of a (scope, words), in order, the set of b (scope, words, rank) that is closest
    to it (see close); of equals the smallest rank."""
    ranks = b.select(*scope, in_order(F.col("words")).alias("y"), "rank").groupBy(*scope, "y").agg(F.min("rank").alias("rank"))
    best = close(a, b, scope, least).join(ranks, [*scope, "y"]).groupBy(*scope, F.col("x").alias("words")).agg(F.min(F.struct((-F.col("share")).alias("less"), "rank")).alias("best"))
    return best.select(*scope, "words", (-F.col("best.less")).alias("share"), "best.rank")
