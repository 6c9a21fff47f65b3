"""Chat examples, archives and packed sequences: exact round trips and edges."""

import gzip
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossier.llm import chat, packing, warc
from tests.compare import assert_same, connect


@given(st.text(alphabet="<|\\>im_endstart\n a", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "\n" not in role and "<|" not in role


def test_examples_hold_all_turns_before_their_reply(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "<|im_end|>"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, None, None), (None, 0, "assistant", "")]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = [r for r in got if r["conv_id"] == 1]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in one] == ["a", "b", ""] and [r["target"] for r in one] == [True, True, False]
    assert one[1]["text"].startswith(one[0]["text"]) and one[2]["text"].startswith(one[1]["text"])
    assert sorted((r["target"], r["loss_end"] - r["loss_start"]) for r in got if r["conv_id"] != 1) == [(False, 0), (True, 0)]


def test_conversations_read_back(spark):
    strange = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "é\x00\r\n", None, "", "x" * 100_000]
    rows = [(c, k, "assistant" if (c + k) % 2 else "user", strange[(c * 7 + k) % len(strange)], "extra") for c in range(9) for k in range(c)]
    rows += rows[:5] + [(50, k, "assistant\nx", "t", "e") for k in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.examples(frame)).collect()}
    expected = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2], r[3] is not None, r[3] or "") for r in rows if r[0] == c))
        said = "".join(f"{r}\n{t}\n" for _, r, _, t in turns)
        loss = "".join(t for _, r, _, t in turns if r == "assistant")
        expected[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got == expected
    assert chat.read_back(chat.examples(frame.limit(0))).count() == 0


def test_archives_equal_sql(spark, sf):
    assert_same(warc.op3_warc(spark, sf), connect(sf), warc.ORACLE)


def test_archive_parts_are_gzip_files_and_lookups_find_keys(spark):
    small = {"fanout": 3, "root": 3}
    rows = [(k, f"http://h{k % 7}.example.org/p{k % 5}", f"<p>{k % 4}</p>", "x") for k in range(60)] + [(None, None, None, "y"), (60, "http://one.example.org/", None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, part string").repartition(2)
    written = warc.save(warc.archives(pages, part_bytes=400), "archives")
    for r in written.collect():
        assert gzip.decompress(r["content"]).count(b"WARC/1.1") == len(r["entries"])
    blocks = warc.save(warc.capture_index(written, lines_each=2), "captures")
    root, levels = warc.directory(blocks, **small)
    assert levels and len(root) <= 3
    keys = spark.createDataFrame([(warc.surt("http://h3.example.org/p3"),), ("org,none)/",), (None,)], "key string")
    found = warc.read_captures(warc.lookup(keys, blocks, **small), written)
    assert sorted(r["page_id"] for r in found.collect()) == [k for k in range(60) if k % 7 == 3 and k % 5 == 3]
    every = {r["page_id"]: r for r in warc.read_captures(warc.lookup(warc.keys_of(pages), blocks, **small), written).collect()}
    assert len(every) == 62 and every[3]["refers_to"] == 59 and every[59]["record_type"] == "response"
    assert every[None]["refers_to"] == 60 and every[60]["payload_bytes"] == 0 and every[60]["payload_digest"] == warc.base32_sha1(b"")
    assert warc.archives(pages.limit(0)).count() == 0


def test_keys_sort_hosts_from_the_right():
    assert warc.surt("https://A.b.Com/x?y#z") == "com,b,a)/x?y" and warc.surt(None) == "" and "\n" not in warc.surt("http://a/\n")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packed_ids_are_the_tokenizers_ids(spark, tokenizer):
    texts = ["One two  three\n\n four.", " lead", "trail ", "a<|endoftext|> b", "don't  it's 'quoted' 12,5", "été\u00a0fin\tx \n y", "", None, "日本語 テスト! ok?", "x" * 5000, "word " * 6000, "Same. Text.", "Same. Text."]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(12, "Same. Text.", 1), (None, "no id", 2)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(1)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts[:12]):
        pieces = sorted(by_doc[k], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist() and {r["doc_tokens"] for r in pieces} == {len(ids)}
    assert len(by_doc[12]) == 2 and len(by_doc[None]) == 1
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.unique(np.r_[0, np.cumsum(rng.integers(1, 60, 40))])
        cost = rng.integers(0, 30, len(at)) * (rng.random(len(at)) < 0.7)
        got, length = packing.cuts(at, cost, 256), 256

        def price(i, j, at=at, cost=cost):
            size = at[j] - at[i]
            return (min(packing.SHORT, length - size) if size in (64, 128) and not cost[j] else length - size) + cost[j]

        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + price(i, j) for i in range(j) if at[j] - at[i] <= length)
        path = [0, *got]
        assert sum(price(i, j) for i, j in zip(path, path[1:])) == best[-1]


def test_little_padding(spark, sf):
    rows = packing.packed(spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)).groupBy("sequence_id").sum("length").collect()
    used = np.array([r[1] for r in rows])
    wasted = np.where(used & (used - 1), 1024 - used, 0).sum()
    assert wasted / (wasted + used.sum()) < 0.02


def test_repeated_pages_are_records_of_their_own(spark, tmp_path):
    long = "<p>" + "é" * 400_000
    rows = [(5, "http://a/", "AAAA"), (5, "http://b/", "BB"), (3, "http://c/", "AAAA"), (5, "http://a/", "AAAA"), (5, "http://z/", "AAAA"), (7, None, long), (None, "http://a/", "BB"), (8, "http://a/#x", None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    frame.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op3_warc(spark, str(tmp_path)).collect())
    d = lambda t: warc.base32_sha1(t.encode())
    assert got == sorted([(5, 4, d("AAAA"), "response", None), (5, 4, d("AAAA"), "revisit", 5), (5, 4, d("AAAA"), "revisit", 5), (3, 4, d("AAAA"), "revisit", 5), (5, 2, d("BB"), "response", None), (0, 2, d("BB"), "revisit", 5), (7, 800_003, d(long), "response", None), (8, 0, d(""), "response", None)], key=lambda r: (r[0], r[1], r[2], r[3]))
    frame.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op3_warc(spark, f"{tmp_path}/none").count() == 0
    short = warc.archives(frame, least=3).selectExpr("explode(entries) e").count()
    assert short == len(rows)


@given(st.text(alphabet=" \t\n'sdéß日1.,!\u00a0\u3000\x00aBc-<|>endoftx\u0301", max_size=60))
@settings(max_examples=2000, deadline=None)
def test_ids_equal_the_tokenizers(text):
    ids = packing.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")).ids
    tokenizer = packing._slow()
    for t in (text, text + "<|endoftext|>" + text):
        assert ids(t).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_long_runs_of_space_are_encoded(tokenizer):
    ids = packing.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")).ids
    text = "a" + " " * 1_500_000 + "b"
    assert ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_padding_over_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    used = np.array([r[1] for r in packing.packed(docs).groupBy("sequence_id").sum("length").collect()])
    wasted = np.where(used & (used - 1), 1024 - used, 0).sum()
    assert used.max() <= 1024 and wasted / (wasted + used.sum()) < 0.01
