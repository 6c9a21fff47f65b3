"""Language ID and toxicity: held-out accuracy, and edges."""

import collections

import numpy as np
import pyarrow as pa

from dossier.llm import langid, toxicity
from dossier.llm.common import bucket_of_id, smallest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98


def test_filters_hold_all_ngrams_and_the_decision_counts_them(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 64)
    rng = np.random.default_rng(0)
    letters = {f"l{i:02d}": [chr(0x4E00 + 20 * i + k) for k in range(4)] + list("a") for i in range(70)}
    rows = [(40 * i + k, "".join(rng.choice(letters[name], 200)), name) for i, name in enumerate(letters) for k in range(6)]
    filters = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == list(letters) and filters.slots.shape[1] == 2
    counts = {name: collections.Counter() for name in letters}
    for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").where(F.coalesce(bucket_of_id("doc_id", 4), F.lit(0)) != 2).collect():
        counts[r["lang"]].update(langid.ngrams(pa.array([r["text"]]))[0].tolist())
    share = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in counts.items()}
    top = collections.Counter()
    for c in share.values():
        for g, p in c.items():
            top[g] = max(top[g], p)
    held = {name: {g for g, p in c.items() if p >= langid.SHARE * top[g]} for name, c in share.items()}
    for i, name in enumerate(filters.languages):
        grams = np.array(sorted(held[name]), np.uint64)
        assert filters.bit(filters.holders(grams), i).all()
        others = np.array(sorted(set(top) - held[name]), np.uint64)
        assert abs(filters.bit(filters.holders(others), i).mean() - filters.wrong[i]) < 0.02
    # A plain count of contained n-grams decides the same.
    texts = ["".join(rng.choice(letters[name], 200)) for name in letters]
    names, score = filters.decide(pa.array(texts))
    for k, text in enumerate(texts):
        grams = langid.ngrams(pa.array([text]))[0].tolist()
        plain = {name: np.mean([g in held[name] for g in grams]) for name in letters}
        assert names[k] == max(plain, key=plain.get) and abs(score[k] - max(plain.values())) < 0.02


def test_ngrams_stay_inside_texts_and_words():
    one, owner, has = langid.ngrams(pa.array(["ab", "12 !", None, "a", "ab"]))
    assert has.tolist() == [True, False, False, True, True] and set(owner.tolist()) == {0, 3, 4}
    assert sorted(one[owner == 0].tolist()) == sorted(one[owner == 4].tolist())


def test_language_edges(spark):
    rows = [(k, "der die das und nicht", "de", 0.5) for k in range(12)] + [(k, "the and that with this", "en", 0.5) for k in range(12, 24)]
    rows += [(30, None, None, 0.1), (31, "", "en", 0.1), (32, "1234 !?", "de", 0.1), (33, "the that", None, 0.1), (33, "the that", None, 0.1), (None, "die das", "de", 0.1), (34, "ж", None, 0.1), (35, "das und " * 60_000, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.language_id(docs).collect()}
    assert [got[k][0] for k in (30, 31, 32, 33, None, 35)] == ["und", "und", "und", "en", "de", "de"] and got[34][0] in ("de", "en") and all(0 <= s <= 1 for _, s in got.values())
    assert langid.language_id(docs).count() == len(rows)
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def planted(spark, n=1200):
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        words = list(rng.choice(common, rng.integers(20, 120))) + [f"r{k}x{j}" for j in range(20)]
        if toxic:
            for w in rng.choice(["vile", "foul", "nasty"], 4):
                words.insert(rng.integers(0, len(words)), w)
        rows.append((k, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_toxicity(spark):
    frame = planted(spark)
    got = toxicity.toxicity(frame, frame.select("doc_id", "toxic")).join(frame, "doc_id").where("held_out").collect()
    hit = [r["predicted"] for r in got if r["toxic"]]
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert np.mean(hit) > 0.97 and np.mean(clean) < 0.02


def test_labels_of_held_out_rows_change_nothing(spark):
    frame = planted(spark, 400)
    labels = frame.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(bucket_of_id("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r["doc_id"], round(r["score"], 12)) for r in df.collect())
    assert key(toxicity.toxicity(frame, labels)) == key(toxicity.toxicity(frame, flipped))


def test_toxicity_edges(spark):
    frame = planted(spark, 400)
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, "c1 vile c2 foul " * 15_000), (9003, "c1"), (9003, "c1"), (None, "c1 c2")], "doc_id long, text string")
    labels = frame.select("doc_id", "toxic").unionByName(spark.createDataFrame([(0, None), (1, 7), (None, 1), (4, 0)], "doc_id long, toxic int"))
    got = [tuple(r) for r in toxicity.toxicity(frame.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("x")), labels).collect()]
    assert len(got) == 406 and all(0 <= r[2] <= 1 for r in got)
    assert all(r[2:] == (0.0, 0) for r in got if r[0] in (9000, 9001)) and next(r for r in got if r[0] == 9002)[3] == 1
    assert {r["score"] for r in toxicity.toxicity(frame, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(frame.limit(0), labels).count() == 0


def test_the_sample_of_a_class_is_its_smallest_hashes(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2900, "en").otherwise("de").alias("lang"), F.xxhash64("id").alias("h"))
    order = sorted(rows.collect(), key=lambda r: (r["h"], r["id"]))
    for n in (7, 200, 5000):
        expected = [r["id"] for k in ("en", "de") for r in [r for r in order if r["lang"] == k][:n]]
        assert sorted(r["id"] for r in smallest(rows, "lang", ["h", "id"], n).collect()) == sorted(expected)
    # Only those under a share of the hashes that holds about four times the rows asked for are ranked.
    ranked = smallest(spark.range(200_000).select("id", F.lit("en").alias("lang"), F.xxhash64("id").alias("h")), "lang", ["h", "id"], 100)
    assert "Filter" in ranked._jdf.queryExecution().toString() and ranked.count() == 100


def brute_kneser_ney(texts):
    """P(symbol | three before it) for each class by dictionaries: {class: function}, and the alphabet with one unknown."""
    n = toxicity.ORDER
    grams = {c: [g for t in of for g in spelled(t)] for c, of in texts.items()}
    kinds = {n: set(grams[0]) | set(grams[1])}
    for k in range(n - 1, 0, -1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
    alphabet = {g[-1] for g in kinds[1]}
    before = {k: {} for k in range(1, n)}
    for k in range(1, n):
        for g in kinds[k + 1]:
            before[k][g[1:]] = before[k].get(g[1:], 0) + 1

    def shared(w, h):
        k = len(h) + 1
        lower = shared(w, h[1:]) if h else 1 / (len(alphabet) + 1)
        of = {g: c for g, c in before[k].items() if g[:-1] == h}
        if not of:
            return lower
        d = toxicity.SHARED_DISCOUNT
        return (max(of.get(h + (w,), 0) - d, 0) + d * len(of) * lower) / sum(of.values())

    def own(c):
        def p(w, h):
            of = [g for g in grams[c] if g[:-1] == h]
            lower = shared(w, h[1:])
            return lower if not of else (max(of.count(h + (w,)) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(set(of)) * lower) / len(of)

        return p

    return {c: own(c) for c in (0, 1)}, alphabet | {"?"}


def spelled(text):
    """4-grams of a text as tuples, a gap as a space."""
    words = "".join(x if x.isalnum() else " " for x in text.lower()).split()
    flat = "   " + "".join(w + " " for w in words)
    return [tuple(flat[i - 3 : i + 1]) for i in range(3, len(flat))]


def test_kneser_ney_equals_brute_force_and_sums_to_one():
    texts = {1: ["you vile cur, vile!", "a vile day"], 0: ["a fine day", "the day was fine and the cur lay", "You, a cur"]}
    of = {c: np.concatenate([toxicity.grams(pa.array([t]))[0] for t in ts]) for c, ts in texts.items()}
    gram = np.unique(np.concatenate([of[0], of[1]]))
    fitted = toxicity.model(gram, *(np.array([(of[c] == g).sum() for g in gram]) for c in (1, 0)))
    p, alphabet = brute_kneser_ney(texts)
    contexts = {g[:-1] for c in texts for t in texts[c] for g in spelled(t)}
    for c in (0, 1):
        for h in contexts | {("z", "z", "z")}:
            assert abs(sum(p[c](w, h) for w in alphabet) - 1) < 1e-9
    # Seen n-grams, unseen ones of seen contexts, and unseen contexts.
    text = "the vile day was a fine vice, zzzz"
    keys, ends, owner = toxicity.grams(pa.array([text]))
    assert np.allclose(fitted.ratios(keys), [np.log(p[1](g[-1], g[:-1]) / p[0](g[-1], g[:-1])) for g in spelled(text)])
    assert len(ends) == 8 and set(owner) == {0}


def test_hash_tables_hold_what_they_are_given():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    values = rng.normal(size=len(keys))
    table = toxicity.Table(keys, values)
    got, missing = table.get(np.r_[keys, keys + np.uint64(1)])
    assert np.allclose(got[: len(keys)], values) and not missing[: len(keys)].any() and missing[len(keys) :].sum() >= len(keys) - 5
    assert toxicity.Table(np.zeros(0, np.uint64), np.zeros(0)).get(keys)[1].all()


def test_grams_of_texts_do_not_meet():
    both, ends, owner = toxicity.grams(pa.array(["Ab, c", None, "!", "ab c"]))
    assert len(ends) == 4 and owner.tolist() == [0, 0, 3, 3]
    assert both[: ends[1] + 1].tolist() == both[ends[1] + 1 :].tolist()
    assert toxicity.grams(pa.array([], pa.string()))[0].tolist() == []
