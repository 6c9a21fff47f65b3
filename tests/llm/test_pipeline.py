"""The pipeline's stages against plain Python on a small corpus, and their edges."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dossier.llm import langid, mixing, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_languages(docs):
    """Kept doc_ids: grams contained by plain counts, the language with the largest share of a text's grams."""
    grams = lambda text: langid.ngrams(pa.array([text], pa.string()))[0].tolist()
    counts = collections.defaultdict(collections.Counter)
    for d in docs:
        if d["lang"] is not None and (d["doc_id"] is None or zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2):
            counts[d["lang"]].update(grams(d["text"]))
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    top = collections.defaultdict(float)
    for c in share.values():
        for g, p in c.items():
            top[g] = max(top[g], p)
    kept = []
    for d in docs:
        g = grams(d["text"])
        best = max((np.mean([share[k].get(x, -1) >= langid.SHARE * top[x] and x in share[k] for x in g]) for k in share), default=0) if g else 0
        if re.search(r"[^\W\d_]", d["text"] or "") and best >= corpus_pipeline.LEAST_SHARE:
            kept.append(d["doc_id"])
    return kept


def spelled(text):
    """Words of letters and digits, each as its 4-grams, the gap after it included."""
    words = "".join(x if x.isalnum() else " " for x in (text or "").lower()).split()
    before, out = "   ", []
    for w in words:
        flat = before[-3:] + w + " "
        out.append([flat[i - 3 : i + 1] for i in range(3, len(flat))])
        before = flat
    return out


def plain_ratios(toxic, ordinary):
    """log P_toxic / P_ordinary of a 4-gram, by dictionaries."""
    of = {1: collections.Counter(g for t in toxic for w in spelled(t) for g in w), 0: collections.Counter(g for t in ordinary for w in spelled(t) for g in w)}
    kinds = {4: set(of[0]) | set(of[1])}
    before, after = {}, {}
    for k in (3, 2, 1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
        before[k] = collections.Counter(g[1:] for g in kinds[k + 1])
        after[k] = collections.defaultdict(list)
        for g, n in before[k].items():
            after[k][g[:-1]].append(n)
    own = {c: collections.defaultdict(list) for c in of}
    for c, counts in of.items():
        for g, n in counts.items():
            own[c][g[:-1]].append(n)

    def shared(g):
        lower = shared(g[1:]) if len(g) > 1 else 1 / (len(kinds[1]) + 1)
        ns = after[len(g)].get(g[:-1])
        return lower if not ns else (max(before[len(g)][g] - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * len(ns) * lower) / sum(ns)

    def p(c, g):
        ns, lower = own[c].get(g[:-1]), shared(g[1:])
        return lower if not ns else (max(of[c][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(ns) * lower) / sum(ns)

    return lambda g: np.log(p(1, g) / p(0, g))


def plain_mean(ratio, text):
    words = [np.log1p(toxicity.EXPRESSIONS * np.expm1(min(sum(map(ratio, w)), toxicity.MOST))) for w in spelled(text)]
    return sum(words) / (len(words) + toxicity.PRIOR), len(words)


def plain_scores(docs, labels, folds):
    """Score of each text, by models of all labelled rows and a scale from models of the other folds; folds gives each labelled row's."""
    known = {d["doc_id"]: d["text"] for d in docs}
    rows = {}
    for i, toxic in labels:
        if i in known and toxic in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1:
            text = known[i]
            rows[text] = max(rows.get(text, (0, 0))[0], toxic), min(i, rows[text][1]) if text in rows else i
    fit = lambda skip: plain_ratios([t for t, (y, i) in rows.items() if y and folds[i] != skip], [t for t, (y, i) in rows.items() if not y and folds[i] != skip])
    x, y = [], []
    for k in range(toxicity.FOLDS):
        ratio = fit(k)
        for t, (toxic, i) in rows.items():
            if folds[i] == k:
                x.append(plain_mean(ratio, t)[0])
                y.append(toxic)
    slope, bias = toxicity._logistic(np.array(x), np.array(y))
    ratio = fit(None)
    return [(lambda m, n: 1 / (1 + np.exp(-(bias + slope * m))) if n else 0.0)(*plain_mean(ratio, d["text"])) for d in docs]


def plain_groups(docs):
    """The smallest id of each near-duplicate group."""
    sets = {}
    for d in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    links = {(i, j) for ids in where.values() for i in ids for j in ids if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return [i for i in sets if label[i] == i]


def plain_copies(docs):
    """How often each row is taken: the water level by repetition, the seed of each source by trying all."""
    size = [len(WORD.findall(d["text"] or "")) for d in docs]
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, d in zip(size, docs) if d["source"] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    stopped = set()
    while True:
        rest = sum(own.values()) - sum(3 * own[s] for s in stopped)
        target = {s: 3 * own[s] if s in stopped else rest * weight[s] / sum(weight[x] for x in sources if x not in stopped) for s in sources}
        over = {s for s in sources if target[s] > 3 * own[s] + 1e-9}
        if not over:
            break
        stopped |= over
    draw = lambda d, seed: int(hashlib.md5(f"{seed // 4}:{'' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest()[8 * (seed % 4) : 8 * (seed % 4) + 8], 16) / 2**32
    out = [0] * len(docs)
    for s in sources:
        rate = target[s] / own[s] if own[s] else 0.0
        mine = [k for k, d in enumerate(docs) if d["source"] == s]
        taken = [[int(rate) + (draw(docs[k], seed) < rate - int(rate)) for k in mine] for seed in range(mixing.SEEDS)]
        best = min(range(mixing.SEEDS), key=lambda seed: (round(abs(sum(n * size[k] for n, k in zip(taken[seed], mine)) - target[s]), 6), seed))
        for n, k in zip(taken[best], mine):
            out[k] = n
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    odd = [(100_000, "!!! 123", None, "src1", 7), (100_001, None, None, None, 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(odd, SCHEMA))
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()]
    folds = {r["doc_id"]: r["fold"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("long")), F.lit(toxicity.FOLDS)).alias("fold")).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = out.collect()
        if name == "packing":
            ids = collections.Counter(r["doc_id"] for r in rows)
            assert sum(r["length"] for r in got) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
            starts = collections.Counter(r["doc_id"] for r in got if r["start"] == 0)
            assert starts == ids
        else:
            assert out.columns == docs.columns
            expected = {
                "language_id": lambda: plain_languages(rows),
                "toxicity": lambda: [r["doc_id"] for r, s in zip(rows, plain_scores(rows, labels, folds), strict=True) if s < corpus_pipeline.TOXIC],
                "minhash_near_dedup": lambda: plain_groups(rows),
                "mixing": lambda: [r["doc_id"] for r, n in zip(rows, plain_copies(rows), strict=True) for _ in range(n)],
            }[name]()
            assert sorted(r["doc_id"] for r in got) == sorted(expected), name
            assert {tuple(r) for r in got} <= {tuple(r) for r in rows}
        docs = out


def test_scores_equal_plain_ones(spark):
    texts = [(k, ("you vile cur go " if k % 4 == 0 else "a fine day it was ") + "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(30)), int(k % 4 == 0)) for k in range(80)]
    frame = spark.createDataFrame([(i, t, y) for i, t, y in texts] + [(900, None, None), (901, "--", None)], "doc_id long, text string, toxic int")
    folds = {r["doc_id"]: r["fold"] for r in frame.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(toxicity.FOLDS)).alias("fold")).collect()}
    rows = [{"doc_id": i, "text": t} for i, t, _ in texts] + [{"doc_id": 900, "text": None}, {"doc_id": 901, "text": "--"}]
    expected = plain_scores(rows, [(i, y) for i, _, y in texts], folds)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame.select("doc_id", "text"), frame.where("toxic is not null").select("doc_id", "toxic")).collect()}
    assert np.allclose([got[r["doc_id"]] for r in rows], expected, atol=1e-6)


def test_an_empty_corpus_gives_an_empty_mix(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "sequence_id" in got.columns


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_nulls_and_keep_clashing_columns(spark, stage):
    """Every value of every row that stays is the one that came, whatever the columns are called."""
    long = "der die das und nicht " * 40_000
    words = {"en": "the and that with this word of them ", "de": "das und die der nicht ein oder aber "}
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, words["en"], "en", None, 6), (None, words["de"], "de", "s", 5), (3, long, "de", "s", 9)]
    rows += [(10 + k, words["en" if k % 2 else "de"] * 3 + f"{k} {k * k} {k * 7}", "en" if k % 2 else "de", "s", k) for k in range(30)]
    clash = "_row _one score lang_pred copies target own tie one whole held_out component_id `a.b`".split()
    docs = spark.createDataFrame([(*r, *(f"{c} {k}" for c in clash)) for k, r in enumerate(rows)], SCHEMA + "".join(f", {c} string" for c in clash)).repartition(2)
    got = stage(spark, docs, SF)
    if stage is corpus_pipeline.pack:
        assert {r["doc_id"] for r in got.collect()} == {r[0] for r in rows}
        return
    assert got.columns == docs.columns
    came = {tuple(r) for r in docs.collect()}
    left = [tuple(r) for r in got.collect()]
    assert set(left) <= came and len({r[0] for r in left}) >= 20


def test_repeated_rows_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)] * 3 + [(2, "a b c d e f", "en", "s", 1), (3, "z", "en", "s", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_texts_with_null_or_repeated_ids_stay(spark):
    texts = [(None, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, "seven eight nine ten eleven"), (4, "a b c d e f"), (4, "u v w x y z"), (9, "one two three four five six"), (3, "a b c d e f"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(texts)], SCHEMA)
    got = [sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()) for n in (1, 5)]
    assert got[0] == got[1]
    assert [(i, t) for i, t, _ in got[0]] == [(0, "seven eight nine ten eleven"), (3, "a b c d e f"), (4, "u v w x y z"), (5, ""), (9, "one two three four five six")]
