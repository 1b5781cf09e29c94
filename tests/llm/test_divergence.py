"""The audit of sources against plain counting and SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from terrane.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SHAPE = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    n, df, groups = {}, {}, set()
    for text, lang, source in ((t or "", x or "", s or "") for _, t, x, s in docs):
        groups.add((lang, source))
        found = Counter(TERM.findall(text.translate(LOWER)))
        df.setdefault(lang, Counter()).update(found.keys())
        n.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: share(n[lang, s]) for x, s in groups if x == lang}
        whole = share(sum((n[lang, s] for s in own), Counter()))
        for s, p in own.items():
            pairs = sorted((-sum(abs(p[t] - own[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((whole[t] - p[t], t.encode()) for t in kept if n[lang, s][t] and p[t] > whole[t])[:top]
            out += [(lang, s, part, item.decode(), -v, r) for part, rows in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(rows, 1)]
    return sorted(out)


def audited(df, **more):
    return sorted(map(tuple, divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()))


def documents(n=160):
    rng = random.Random(3)
    words = ["Der", "die", "THE", "naïve", "Éa", "éa", "x1y", "a-b", "ünder", "und", "zzzzzzzzzzzzzzzzzzz", "zzzzzzzzzzzz", "日本語", "abcdef", "abcdefghijkl", "𐐀b", "q", "İ"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 + (k * (i % 4)) % 5 for k in range(len(words))], k=rng.randrange(0, 30))), ["en", "de", None, ""][i % 4 if i % 11 else 0], f"s{i % 5}" if i % 7 else None) for i in range(n)]
    return rows + [(900, None, "xx", "alone"), (901, "", "yy", "a"), (902, "123 456", "yy", "b"), (903, "und " * 2000, "de", "s1"), (None, "und die", "de", "s1"), (0, rows[0][1], "en", "s0")]


def test_all_shares_by_plain_counting(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SHAPE).repartition(6)
    for least, top in ((5, 3), (1, 50), (30, 50)):
        assert audited(df, least=least, top=top) == brute(docs, least, top)


def test_tries_written_early_and_in_batches_of_languages(spark, monkeypatch):
    docs = documents()
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "ARRAY", 8)
    assert audited(spark.createDataFrame(docs, SHAPE), least=5) == brute(docs, 5, 50)


def test_a_trie_gives_its_terms_in_byte_order():
    rng, trie, want = random.Random(4), divergence.Trie(), Counter()
    for k in range(3000):
        term = bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(1, 20)))
        trie.add(Counter({term: 2}), f"s{k % 2}")
        want[term] += 2
    got = [(t, sum(x % divergence.DOCUMENT for x in leaf.values())) for t, leaf in trie.leaves()]
    assert got == sorted(want.items()) and trie.cells == sum(len(leaf) for _, leaf in trie.leaves())
    assert sum(x // divergence.DOCUMENT for _, leaf in trie.leaves() for x in leaf.values()) == 3000


def test_texts_in_slices_and_exact_large_shares(monkeypatch):
    import numpy as np

    text = ("Abc déf " * 500 + "x" * 5000 + " end").encode()
    whole = divergence.terms(text)
    monkeypatch.setattr(divergence, "SLICE", 100)
    assert divergence.terms(text) == whole and whole["déf".encode()] == 500
    part, total = np.array([10**15 - 1, 5, 9 * 10**9]), np.array([10**15 + 7, 10**15, 10**10])
    assert divergence.per_billion(part, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(part, total, strict=True)]


def test_extra_columns_empty_tables_and_sql(spark, tmp_path):
    docs = documents(400)
    df = spark.createDataFrame(docs, SHAPE)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(divergence.ORACLE)
    names = [c[0] for c in want.description]
    for c in ("term", "n", "docs", "range", "raw", "x", "v", "part", "item", "value", "rank", "counts"):
        df = df.withColumn(c, F.lit("?"))
    assert sorted(tuple(r[c] for c in names) for r in divergence.audit(df).collect()) == sorted(want.fetchall())
    assert divergence.audit(df.limit(0)).collect() == []
