"""SimHash against a plain fingerprint and brute-force links."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from terrane.llm import simhash


def plain(text: str | None) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n\t", "one", "One two", "ONE two", "a b c", "a b c a b c a b c", "İ ÉÉ é x\x0by\x0cz", " x ", "tab\tand\r\nline"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def components(ids, prints, bits=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(random.choices(words, k=random.choice([3, 20, 120]))) for _ in range(40)]
    for base in list(texts[:8]):
        for _ in range(6):
            w = base.split()
            w[random.randrange(len(w))] = random.choice(words)
            texts.append(" ".join(w))
    texts += TEXTS + texts[:5]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r for r in simhash.digest(docs).collect()}
    prints = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {i: r["component_id"] for i, r in got.items()} == components(list(prints), prints)
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert kept == {i for i, c in components(list(prints), prints).items() if i == c}


def test_crowded_cells_in_blocks(spark, monkeypatch):
    """A dense ball of fingerprints around one, and a chain, with blocks of a few rows."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 7), replace=False)) for _ in range(250)}
    chain = int(rng.integers(0, 2**63))
    for k in range(0, 42, 3):
        prints.add(chain)
        chain ^= 7 << k
    rows = dict(enumerate(sorted(prints)))
    points = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in rows.items()], "rep long, fp long")
    found = simhash.links(points)
    edges = found.collect()
    assert all((rows[e["u"]] ^ rows[e["v"]]).bit_count() <= 3 for e in edges)
    joined = {r["node"]: r["component"] for r in simhash.connected_components(found).collect()}
    assert {i: joined.get(i, i) for i in rows} == components(list(rows), rows)


def test_unary_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    manhattan = np.bitwise_count(simhash._embed(a) ^ simhash._embed(b))
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)).astype(int) for k in range(32)])
    assert (manhattan == np.abs(counts(a) - counts(b)).sum(axis=0)).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (5, None), (None, "a b c d"), (None, "quite alone here")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.digest(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (5, 5), (None, 3), (None, None)]
    assert simhash.one_of_each(docs).count() == 5
    assert simhash.digest(docs.limit(0)).count() == 0
