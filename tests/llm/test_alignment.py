"""Tokenizer alignment against a plain count with the libraries themselves, and its edges."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossier.llm import alignment


@lru_cache(maxsize=1)
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: k for k, c in byte_characters().items()}
    entries = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
    return a, b, entries


def byte_characters():
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in own]
    return {k: chr(k) for k in own} | {k: chr(256 + n) for n, k in enumerate(rest)}


def groups_of(text):
    """The groups of a text as (A ids, B ids); none where bytes differ."""
    if not text:
        return []
    a_coder, b_coder, entries = libraries()
    a, b = a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)
    piece = lambda i: bytes([int(b_coder.id_to_piece(i)[1:-1], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()
    whole = (" " + text).encode()
    a_bytes, b_bytes = [entries.get(i, b"") for i in a], [piece(i) for i in b]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    out, x, y = [], 0, 0
    while x < len(a):
        p, q, n, m = x + 1, y + 1, len(a_bytes[x]), len(b_bytes[y])
        while n != m:
            if n < m:
                n, p = n + len(a_bytes[p]), p + 1
            else:
                m, q = m + len(b_bytes[q]), q + 1
        out.append((a[x:p], b[y:q]))
        x, y = p, q
    return out


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the documents of each pair."""
    every, documents = [], Counter()
    for text in texts:
        groups = groups_of(text)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        every.append((groups, links))
        documents.update(links.keys())
    highest = defaultdict(int)
    for (x, _), n in documents.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups, links in every:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(n for (x, y), n in links.items() if documents[x, y] == highest[x])
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), links.total(), best, sum(n * documents[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out, documents, highest


ODD = ["", None, " ", "▁x", "x ▁", "<s>", "<|endoftext|> and <unk>", "\x00\x01", "é́", "\U0001f469‍\U0001f680", "ﬁ　ａ", "a  b   c\n\n\td", "漢字かな交じり", "\r\n", "ß" * 50, "näive " * 3, "<0x41>", "﻿" + "x"]


@pytest.mark.parametrize("radixes, spill, frame", [(64, 1 << 21, 1 << 16), (3, 50, 4), (1, 1, 1)])
def test_equal_to_a_plain_count(spark, radixes, spill, frame):
    rng = random.Random(radixes)
    words = ["the", "Über", "tion", "  ", "\n", "<s>", "漢字", "antidis", "establish", "é", "1234567", "🎉", "unhappily", ".", "strasse"]
    texts = ODD + [rng.choice(["", " "]).join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(120)]
    texts += texts[:5] + ["the the the"] * 7
    rows = [(k if k % 11 else None, t, k, "own") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, kind string").repartition(3)
    spills = alignment.spilled(docs, radixes=radixes, spill=spill, frame=frame)
    expected, documents, highest = brute(texts)
    got = alignment.aligned(spills).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], *e)) for r, e in zip(rows, expected, strict=True))
    pairs = {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in alignment.pair_counts(spills).collect()}
    assert pairs == {p: (n, n == highest[p[0]]) for p, n in documents.items()}


def blocks(texts):
    use = alignment.coders(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.Block(use, list(range(len(texts))), texts)


@given(st.lists(st.text(max_size=60) | st.text(alphabet=" \n\t▁<s>|endoftx'é🎉", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_groups_of_any_text(texts):
    block = blocks(texts)
    expected, _, _ = brute(texts)
    assert [tuple(x) for x in zip(block.n_a.tolist(), block.n_b.tolist(), block.n_groups.tolist(), block.n_links.tolist(), block.sha, strict=True)] == [(*e[:4], e[6]) for e in expected]


def test_wide_groups_count_alike(monkeypatch):
    texts = ["antidisestablishmentarianism é漢字 unhappily " * 5, "ß🎉strasse", "the"]
    plain = blocks(texts)
    monkeypatch.setattr(alignment, "WIDE", 1)
    wide = blocks(texts)
    assert (plain.keys == wide.keys).all() and (plain.weights == wide.weights).all() and (plain.entries == wide.entries).all()


def test_long_and_empty(spark):
    texts = [" " * 150_000 + "end", "word é " * 60_000, "a" * 120_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.aligned(alignment.spilled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got == dict(enumerate(brute(texts)[0]))
    none = alignment.spilled(spark.createDataFrame([], "doc_id long, text string"))
    assert alignment.aligned(none).count() == 0 and alignment.pair_counts(none).count() == 0


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    x, y = np.unique(rng.integers(0, 1 << 32, 1000, dtype=np.uint32)), rng.integers(-(1 << 60), 1 << 60, 1000)
    (steps,), (back,) = alignment._unpack(alignment._pack(alignment._deltas(x)), "<u4"), alignment._unpack(alignment._pack(y), "<i8")
    assert (np.cumsum(steps, dtype=np.uint32) == x).all() and (back == y).all()
