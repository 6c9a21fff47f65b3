"""Top-k evidence by keywords and vectors, section trees, and contexts under a budget."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from dossier.functions.frames import small
from dossier.functions.phrases import hits
from dossier.functions.text import jaccard, tokens

#: Chunks of one slice and queries of one slice: what a task holds. A cell of more than LEAST chunks is cut so that more tasks share it.
CANDIDATES, QUERIES, LEAST = 8192, 2048, 1024
#: Cells into which documents are dealt, and chunks that are scored together.
CELLS, CHUNK = 256, 1024


def _units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors their rows and the vectors as doubles of length 1; null and zero vectors and those with null components go."""
    lists = pa.chunked_array(vectors.chunks, vectors.type).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    none, values = flat.is_null().to_numpy(zero_copy_only=False), pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        at = starts[rows][:, None] + np.arange(size)
        rows, x = rows[~none[at].any(axis=1)], values[at[~none[at].any(axis=1)]]
        with np.errstate(all="ignore"):
            norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
            held = ~(norm <= 0)
            out[int(size)] = rows[held], x[held] / norm[held, None]
    return out


def _places(scores: np.ndarray) -> np.ndarray:
    """Scores times 10,000, rounded half up by their decimal digits as round() does; infinity for NaN, which Spark holds to be the largest."""
    x = np.abs(scores) * 1e4 + 0.5
    out, near = np.floor(x), np.abs(x - np.rint(x)) < 1e-6
    if near.any():
        values, at = np.unique(np.abs(scores[near]), return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP)) for v in values])[at]
    return np.where(np.isnan(scores), np.inf, np.where(scores < 0, -out, out))


def _nearest(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of c and cosine of the k nearest of c to each of q (unit vectors): by the cosine rounded to 4 places, then in c's order.

    A product of matrices tells which pairs of a chunk may be among the k best; only their cosines are summed component by component.
    """
    i, j, s, r = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    floor, step = np.full(len(q), -np.inf), max(1, (1 << 22) // q.shape[1])
    for a in range(0, len(c), CHUNK):
        about = q @ c[a : a + CHUNK].T * 1e4
        # Earlier chunks win ties: who comes now must be rounded above the k-th so far.
        alive = ~(about < floor[:, None] + 0.5 - 1e-4) & (floor < np.inf)[:, None]
        rows = np.flatnonzero(alive.sum(axis=1) > k)
        if len(rows):
            alive[rows] &= ~(about[rows] < np.partition(about[rows], -k, axis=1)[:, -k, None] - 1 - 1e-4)
        x, y = np.nonzero(alive)
        exact = [np.cumsum(q[x[b : b + step]] * c[y[b : b + step] + a], axis=1)[:, -1] for b in range(0, len(x), step)]
        if not exact:
            continue
        s = np.concatenate([s, *exact])
        i, j, r = np.concatenate([i, x]), np.concatenate([j, y + a]), np.concatenate([r, _places(np.concatenate(exact))])
        order = np.lexsort((j, -r, i))
        rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        order, rank = order[rank < k], rank[rank < k]
        i, j, s, r = i[order], j[order], s[order], r[order]
        floor[i[rank == k - 1]] = r[rank == k - 1]
    return i, j, s


def _meet(k: int):
    """The k nearest chunks of a slice for each query of a slice, document by document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.array_sort_indices(pa.chunked_array(right["chunk_id"].chunks, right["chunk_id"].type).combine_chunks(), null_placement="at_start"))
        docs = pa.chunked_array(left["doc"].chunks + right["doc"].chunks, left["doc"].type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ours, theirs, found = _units(left["vector"]), _units(right["vector"]), []
        for size in ours.keys() & theirs.keys():
            (qs, q), (cs, c) = ours[size], theirs[size]
            for doc in np.intersect1d(docs[qs], docs[len(left) + cs]):
                m, n = np.flatnonzero(docs[qs] == doc), np.flatnonzero(docs[len(left) + cs] == doc)
                i, j, score = _nearest(q[m], c[n], k)
                found.append((qs[m[i]], cs[n[j]], score))
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": left["query_id"].take(i), "doc": left["doc"].take(i), "chunk_id": right["chunk_id"].take(j), "score": pa.array(score, pa.float64(), from_pandas=False)})

    return run


def cosine_top_k(queries: DataFrame, chunks: DataFrame, *, k: int = 5, salts: int = 8) -> DataFrame:
    """query_id, doc, chunk_id, score, rank: the k nearest chunks (doc, chunk_id, vector) of each query (query_id, doc, vector).

    A query only meets its own document's chunks. Documents are dealt into cells by a hash; a large cell is cut into slices
    (up to `salts`, and more where one would hold over CANDIDATES chunks or QUERIES queries). A slice of queries meets a slice of
    chunks in one task, which keeps k for each query, so pairs never become rows. Scores are rounded to 4 places, ties go
    to the smaller chunk_id.
    """
    cell = F.pmod(F.xxhash64("doc"), F.lit(CELLS)).cast("int").alias("_cell")
    asked = queries.where("doc is not null").select("query_id", F.col("doc").alias("doc"), F.col("vector").alias("vector"), cell)
    given = chunks.where("doc is not null").select(F.col("doc").alias("doc"), "chunk_id", F.col("vector").alias("vector"), cell)
    count = lambda rows, name: rows.groupBy("_cell").agg(F.count("*").alias(name))
    parts = lambda n, size: F.ceil(F.col(n) / size)
    slices = F.greatest(parts("_c", CANDIDATES), F.least(F.lit(salts), parts("_c", LEAST)))
    sizes = F.broadcast(count(asked, "_q").join(count(given, "_c"), "_cell").select("_cell", parts("_q", QUERIES).alias("_qn"), slices.alias("_cn")))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "_cell").select("query_id", "doc", "vector", "_cell", own("query_id", "_qn").alias("_qs"), every("_cn").alias("_cs"))
    right = given.join(sizes, "_cell").select("doc", "chunk_id", "vector", "_cell", every("_qn").alias("_qs"), own("chunk_id", "_cn").alias("_cs"))
    schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n, rows in (("query_id", queries), ("doc", queries), ("chunk_id", chunks))] + [T.StructField("score", T.DoubleType())])
    keys = ["_cell", "_qs", "_cs"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), schema).withColumn("score", F.round("score", 4))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id")))).where(F.col("rank") <= k)


def multi_query(hits: DataFrame, group: str, key: str, *, per_query: int = 3, least: float = 0.25, most: int = 6) -> DataFrame:
    """Hits (doc, group, query_no, rank, score, key) of several queries as one list for each (doc, group).

    The first `per_query` of each query over `least` count; a key found by several counts for the first query;
    the `most` best scores stay.
    """
    kept = hits.where((F.col("rank") <= per_query) & (F.col("score") > least))
    once = kept.withColumn("_k", F.row_number().over(W.partitionBy("doc", group, key).orderBy("query_no", "rank"))).where("_k = 1").drop("_k")
    return once.withColumn("position", F.row_number().over(W.partitionBy("doc", group).orderBy(F.desc("score"), key))).where(F.col("position") <= most)


def page_ordered(hits: DataFrame, group: str, most: int = 8) -> DataFrame:
    """The `most` first hits of each (doc, group), ordered by page (0 and null last) and then score."""
    page = F.coalesce(F.nullif("page_no", F.lit(0)), F.lit(999))
    return hits.where(F.col("position") <= most).withColumn("page_order", F.row_number().over(W.partitionBy("doc", group).orderBy(page, F.desc("score"), "position")))


def cascade(primary: DataFrame, secondary: DataFrame, keys: list[str], *, enough: int = 3, least: float = 0.2) -> DataFrame:
    """Primary hits (keys, text, score), with secondary ones over `least` where fewer than `enough`; first 80 characters once; source says which."""
    count = primary.groupBy(*keys).agg(F.count("*").alias("_n"))
    more = secondary.where(F.col("score") > least).join(count, keys, "left").where(F.coalesce("_n", F.lit(0)) < enough).drop("_n")
    both = primary.withColumn("source", F.lit("primary")).unionByName(more.withColumn("source", F.lit("secondary")))
    w = W.partitionBy(*keys, F.substring("text", 1, 80)).orderBy("source", F.desc("score"), "text")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keyword_overlap(queries: DataFrame, chunks: DataFrame, *, most: int = 20) -> DataFrame:
    """query_id, chunk_id, score: share of a query's words (query_id, doc, text) that a chunk (doc, chunk_id, text) holds, the `most` best.

    Words meet through an equi-join on (doc, word), so chunks without a shared word are never paired.
    """
    q = queries.select("query_id", "doc", tokens("text").alias("t")).select("query_id", "doc", F.size("t").alias("n"), F.explode("t").alias("w"))
    c = chunks.select("doc", "chunk_id", F.explode(tokens("text")).alias("w"))
    got = q.join(c, ["doc", "w"]).groupBy("query_id", "chunk_id").agg((F.count("*") / F.max("n")).alias("score"))
    return got.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= most)


def section_matches(queries: DataFrame, sections: DataFrame, *, most: int = 20) -> DataFrame:
    """query_id, section_no of sections (doc, section_no, heading) whose heading holds a query's title (doc, title), or is held, or shares over half its words."""
    a, b = F.lower("title"), F.lower(F.coalesce("heading", F.lit("")))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    met = queries.join(sections, "doc").where(F.contains(b, a) | F.contains(a, b) | (jaccard(words(a), words(b)) > 0.5))
    return met.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("section_no"))).where(F.col("k") <= most).select("query_id", "doc", "section_no")


def section_tree(chunks: DataFrame) -> DataFrame:
    """doc, level, title, parent, start_page, end_page, n_chunks, node of chunks (doc, chunk_no, section_heading, clause_ref, page_no).

    Level 0 is the document, level 1 its sections (the heading before any " > "), level 2 the clause references with two chunks or
    more. Nodes are numbered by level and first appearance; pages of 0 do not count.
    """
    top = F.trim(F.get(F.split(F.coalesce("section_heading", F.lit("")), " > "), F.lit(0)))
    rows = chunks.withColumn("_top", F.when(top == "", "General").otherwise(top)).withColumn("_page", F.nullif("page_no", F.lit(0)))
    stats = [F.min("_page").alias("start_page"), F.max("_page").alias("end_page"), F.count("*").alias("n_chunks"), F.min("chunk_no").alias("first")]
    zero = rows.groupBy("doc").agg(*stats).select("doc", F.lit(0).alias("level"), F.lit("document").alias("title"), F.lit(None).cast("string").alias("parent"), "start_page", "end_page", "n_chunks", "first")
    one = rows.groupBy("doc", F.col("_top").alias("title")).agg(*stats).select("doc", F.lit(1).alias("level"), "title", F.lit("document").alias("parent"), "start_page", "end_page", "n_chunks", "first")
    two = rows.where("clause_ref <> ''").groupBy("doc", F.col("_top").alias("parent"), F.col("clause_ref").alias("title")).agg(*stats).where("n_chunks >= 2").select("doc", F.lit(2).alias("level"), "title", "parent", "start_page", "end_page", "n_chunks", "first")
    every = zero.unionByName(one).unionByName(two)
    return every.withColumn("node", F.row_number().over(W.partitionBy("doc").orderBy("level", "first", "title")) - 1).drop("first")


def contents(tree: DataFrame, *, children: int = 10) -> DataFrame:
    """A table of contents for each document: sections and, indented, their references, `children` of each parent at most."""
    ranked = tree.where("level > 0").withColumn("k", F.row_number().over(W.partitionBy("doc", "level", "parent").orderBy("node"))).where(F.col("k") <= children)
    home = ranked.where("level = 1").select("doc", F.col("title").alias("parent"), F.col("node").alias("home"))
    placed = ranked.where("level = 1").withColumn("home", F.col("node")).unionByName(ranked.where("level = 2").join(home, ["doc", "parent"]))
    line = F.concat(F.when(F.col("level") == 2, "  ").otherwise(""), F.col("title"), F.lit(" (p"), F.coalesce(F.col("start_page").cast("string"), F.lit("?")), F.lit(")"))
    return placed.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("home", "level", "node", line.alias("line")))), lambda x: x["line"]), "\n").alias("contents"))


def externally_ranked(candidates: DataFrame, ranking: DataFrame, *, k: int = 5) -> DataFrame:
    """Candidates (query_id, chunk_id, rank) scored by a ranking (query_id, chunk_id, place from 0): 1 - 0.1 * place; unranked ones 0.3, up to 2 k in all."""
    got = candidates.join(ranking, ["query_id", "chunk_id"], "left").withColumn("score", F.when(F.col("place").isNotNull(), F.round(F.greatest(1 - 0.1 * F.col("place"), F.lit(0.0)), 2)).otherwise(0.3))
    w = W.partitionBy("query_id").orderBy(F.col("place").isNull(), "place", "rank", "chunk_id")
    return got.withColumn("position", F.row_number().over(w)).where(F.col("position") <= 2 * k).drop("place", "rank")


def keyword_pages(pages: DataFrame, keywords: DataFrame, *, most: int = 8, occurrences: bool = False) -> DataFrame:
    """doc, topic, page_no, hits, rank: pages (doc, page_no, text) by the keywords (topic, words array) that they hold.

    Hits are keywords present, or all their occurrences; more first, then later pages. A page is read once, whatever
    the number of keywords (see phrases.hits).
    """
    phrases = keywords.select(F.col("topic").alias("label"), F.posexplode("words").alias("place", "phrase"))
    met = hits(pages.select("doc", "page_no", F.lower("text").alias("_t")), F.col("_t"), phrases)
    got = met.select("doc", F.col("label").alias("topic"), "page_no", F.col("times" if occurrences else "words").alias("hits")).where("hits > 0")
    return got.withColumn("rank", F.row_number().over(W.partitionBy("doc", "topic").orderBy(F.desc("hits"), F.desc("page_no")))).where(F.col("rank") <= most)


def or_first_pages(hits: DataFrame, pages: DataFrame, topics: DataFrame, *, first: int = 8) -> DataFrame:
    """hits, and for each document and topic without any, its pages up to `first` with no hits and rank by page."""
    every = pages.select("doc").distinct().crossJoin(small(topics.select("topic")))
    none = every.join(hits.select("doc", "topic").distinct(), ["doc", "topic"], "left_anti")
    back = pages.where(F.col("page_no") <= first).select("doc", "page_no").join(none, "doc").select("doc", "topic", "page_no", F.lit(0).alias("hits"), F.col("page_no").alias("rank"))
    return hits.unionByName(back.withColumn("hits", F.col("hits").cast(hits.schema["hits"].dataType)))


def context(blocks: DataFrame, keys: list[str], order: str, *, budget: int, label: str = "page_no") -> DataFrame:
    """One text for each key of blocks in order, each under a [label] line, cut where `budget` characters of text are used."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = blocks.withColumn("_left", budget - before).where("_left > 0").withColumn("_line", F.concat(F.lit("["), F.col(label).cast("string"), F.lit("]\n"), F.substring("text", F.lit(1), F.col("_left").cast("int"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "_line"))), lambda x: x["_line"])
    return got.groupBy(*keys).agg(F.array_join(lines, "\n\n").alias("context"), F.count("*").alias("n_blocks"))


def first_rule(rows: DataFrame, text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule (pattern, label) that the lower-cased text meets."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.rlike(F.lower(text), F.lit(pattern)), label).otherwise(out)
    return out


def phrase_keywords(criteria: DataFrame, stop: list[str]) -> DataFrame:
    """doc and its keywords: distinct words of three letters and more of search_keywords, stop words and QUAL and LLM criteria left out."""
    words = criteria.where(~F.col("formula_type").isin("QUAL", "LLM")).select("doc", F.explode("search_keywords").alias("p")).select("doc", F.explode(tokens("p", 3)).alias("w"))
    return words.where(~F.col("w").isin(stop) & F.rlike("w", F.lit("^[a-z]+$"))).groupBy("doc").agg(F.array_sort(F.collect_set("w")).alias("keywords"))


def section_retrieval(queries: DataFrame, chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, method: chunks of the sections chosen for a query; for queries without any, keyword overlap in the whole document."""
    by_section = chosen.join(chunks, ["doc", "section_no"]).select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit("section").alias("method"))
    rest = queries.join(by_section.select("query_id").distinct(), "query_id", "left_anti")
    return by_section.unionByName(keyword_overlap(rest, chunks).select("query_id", "chunk_id", "score", F.lit("keyword").alias("method")))
