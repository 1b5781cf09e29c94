"""Packing: ids as the tokenizer gives them, every id in one piece, gapless sequences, first fit."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrane.llm import packing

TEXTS = [None, "", " \n", "Hello, world! it's don't WE'RE 12 3", "naïve Éa ÿ ß ẞ µ ª ² ½", "x<|endoftext|>y <|startoftext|>", "İstanbul ΟΔΟΣ Σ é ﬁ", "日本語 한국 😀😀 \u2028x\u00a0y\x1cz", "a" * 5000, "word " * 3000, "A.B,C;D:E (f) [g] {h} |i| <j>", "ＦＵＬＬ Ⅳ ǅ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_path())


@pytest.fixture(scope="module")
def coder():
    return packing.word_ids(packing.default_path())


def test_vocabulary_agrees(coder):
    assert coder.agrees()


def test_ids(tokenizer, coder):
    random.seed(2)
    alphabet = "abcdeéßABCÉ .,'-!?0129\n\t|<>&😀"
    for text in [t or "" for t in TEXTS] + ["".join(random.choices(alphabet, k=80)) for _ in range(300)]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_word_cache_is_bounded():
    small = packing.WordIds(packing.default_path(), limit=5)
    for k in range(50):
        small.encode(f"word{k} other{k}")
    assert len(small) <= 6


def naive(lengths, size):
    free, bins = [], []
    for n in lengths:
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        if k == len(free):
            free.append(size)
        free[k] -= n
        bins.append(k)
    return bins


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 64, 300):
        lengths = np.sort(rng.integers(1, 101, n))[::-1]
        assert packing.first_fit_decreasing(lengths, 100).tolist() == naive(lengths.tolist(), 100)


def test_round_trip(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, length int")
    rows = [r.asDict() for r in packing.packed(docs).collect()]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(TEXTS) * 3))
    for doc, parts in by_doc.items():
        ids = [*tokenizer.encode(TEXTS[doc % len(TEXTS)] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.SEQUENCE
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= total // packing.SEQUENCE + 2


def test_groups_and_empty_table(spark):
    parts = spark.range(500).selectExpr("id AS doc_id", "0L AS start", "1 + id * 37 % 900 AS length", "id AS ids_crc32", "0L AS doc_tokens")
    rows = packing.pack(parts, group_pieces=100).collect()
    assert len(rows) == 500 and len({r["sequence_id"] >> 32 for r in rows}) == 5
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "x"), (None, "y"), (big, "x")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in packing.packed(docs).collect()) == [str(big), str(big), "None"]
    assert packing.packed(docs.limit(0)).count() == 0
