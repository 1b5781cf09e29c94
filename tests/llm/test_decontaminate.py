"""Decontamination against planted passages and a brute-force alignment."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from terrane.llm import decontaminate as d

random.seed(11)
WORDS = [f"word{k}" for k in range(4000)]
ITEMS = {k: random.choices(WORDS, k=n) for k, n in enumerate([13, 20, 40, 60, 9, 30])}


def noise(n):
    return [f"noise{random.randrange(10**6)}" for _ in range(n)]


def planted():
    docs = {}
    for k, words in ITEMS.items():
        docs[100 + k] = noise(30) + words + noise(10)
        docs[200 + k] = [w.upper() + "," for w in words]
        swapped = [w if i % 7 != 3 else "other" for i, w in enumerate(words)]
        docs[300 + k] = noise(5) + swapped + noise(5)
    docs[400] = noise(5) + ITEMS[3][20:40] + noise(5)
    docs[500] = noise(200)
    docs[501] = noise(20) + ITEMS[2][:8] + noise(20)
    docs[502] = [w for k, w in enumerate(ITEMS[3]) if k % 2 == 0]
    return docs


def frames(spark):
    docs = spark.createDataFrame([(i, " ".join(w), 0) for i, w in planted().items()] + [(900, None, 0), (901, "", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in ITEMS.items()] + [(77, None), (78, "")], "item_id long, text string")
    return docs, items


def test_planted_passages(spark):
    docs, items = frames(spark)
    found = {(r["doc_id"], r["item_id"]) for r in d.contaminations(docs, items).collect()}
    want = {(base + k, k) for base in (100, 200, 300) for k in ITEMS} | {(400, 3)}
    assert found == want
    kept = {r["doc_id"] for r in d.clean(docs, items).collect()}
    assert kept == set(planted()) - {i for i, _ in want} | {900, 901}


def test_a_large_benchmark_is_joined_with_the_same_result(spark):
    docs, items = frames(spark)
    docs = docs.union(docs.where("doc_id = 101"))
    rng = random.Random(3)
    short = spark.createDataFrame([(100 + n, " ".join(f"tiny{n}x{rng.randrange(99)}" for _ in range(n))) for n in range(1, 9)], "item_id long, text string")
    more = spark.createDataFrame([(700 + r["item_id"], f"before it {r['text']} and after", 0) for r in short.collect()] + [(None, f"x {' '.join(ITEMS[2])}", 0)], "doc_id long, text string, item_id int")
    docs, items = docs.union(more), items.union(short).union(spark.createDataFrame([(None, " ".join(ITEMS[0]))], "item_id long, text string"))
    one = sorted(map(str, d.contaminations(docs, items).collect()))
    for bits in (d.FILTER_BITS, 10):
        assert sorted(map(str, d.contaminations(docs, items, broadcast_chars=10, filter_bits=bits).collect())) == one
    assert len(one) > 30


def test_recall_over_random_substitutions():
    """Every item of 1 to 40 tokens with every allowed number of substitutions, against the definition."""
    rng, found, all_ = random.Random(17), 0, 0
    for n in range(1, 41):
        item = [f"t{rng.randrange(10**6)}" for _ in range(n)]
        index = d.Index()
        index.add(1, d.tokens(" ".join(item)))
        index.seal()
        for count in range(int((1 - d.MIN_IDENTITY) * n + 1e-9) + 1):
            hits = 0
            for _ in range(40):
                places = set(rng.sample(range(n), count))
                words = noise(4) + ["other" if k in places else w for k, w in enumerate(item)] + noise(4)
                hits += bool(d.overlaps(d.tokens(" ".join(words)), index))
            assert hits >= 0.95 * 40, (n, count, hits)
            found, all_ = found + hits, all_ + 40
    assert found >= 0.99 * all_, found / all_


def test_clashing_names(spark):
    docs, items = frames(spark)
    more = docs.where("doc_id IN (101, 500)").select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(("__key", "__bad", "key", "k", "item", "a.b"))])
    assert [r["doc_id"] for r in d.clean(more, items.withColumn("hash", F.lit(1))).collect()] == [500]


def brute(equal, share):
    best = 0
    for a, b in itertools.combinations_with_replacement(range(len(equal)), 2):
        part = equal[a : b + 1]
        if part[0] and part[-1] and part.sum() >= share * len(part) - 1e-9:
            best = max(best, len(part))
    return best


def test_best_segment():
    rng = np.random.default_rng(4)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 30)) < rng.choice([0.3, 0.6, 0.85, 1.0])
        start, length, same = d.best_segment(equal)
        assert length == brute(equal, d.MIN_IDENTITY)
        assert same == equal[start : start + length].sum()


def test_masks_hit_all_windows_with_three_substitutions():
    places = [{s + i for i, c in enumerate(m) if c == "1"} for m in d.MASKS for s in range(d.MIN_TOKENS - len(m) + 1)]
    assert all(any(not p & set(sub) for p in places) for sub in itertools.combinations(range(d.MIN_TOKENS), 3))


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.contaminations(docs.limit(0), items).count() == 0
    assert d.contaminations(docs, items.limit(0)).count() == 0
    assert d.clean(docs, items.limit(0)).count() == docs.count()


def found_in(text, items):
    index = d.Index()
    for k, item in enumerate(items):
        index.add(k, d.tokens(item))
    index.seal()
    return {k for k, *_ in d.overlaps(d.tokens(text), index)}


def test_short_items_are_found_whole():
    rng = random.Random(5)
    for n in range(1, 14):
        item = [f"short{rng.randrange(10**6)}" for _ in range(n)]
        around = lambda words: " ".join([*noise(6), *words, *noise(6)])
        allowed = int((1 - d.MIN_IDENTITY) * n + 1e-9)
        for places in itertools.combinations(range(n), allowed):
            swapped = ["other" if k in places else w for k, w in enumerate(item)]
            assert found_in(around(swapped), [" ".join(item)]) == {0}, (n, places)
        swapped = ["other" if k <= allowed else w for k, w in enumerate(item)]
        assert not found_in(around(swapped), [" ".join(item)])
        assert n == 1 or not found_in(around(item[:-1][::-1]), [" ".join(item)])
    assert found_in("the end", ["end", "the", "the end", "end the"]) == {0, 1, 2}


def test_scripts_without_spaces():
    assert d.tokens("Go去年、東京 é1 カナ。") == [x.encode() for x in ("go", "去", "年", "東", "京", "é1", "カ", "ナ")]
    assert d.tokens("ที่นี่") == [x.encode() for x in ("ที่", "นี่")]
    item = "光合成は植物が光のエネルギーを使って二酸化炭素と水から有機物を作る反応である。"
    assert found_in(f"前の文です。{item}次の文です。", [item]) == {0}
    assert found_in(f"前の文です{item.replace('植物', '草木')}次の文です", [item]) == {0}
    assert not found_in("全く別の話題についての長い文章がここに続いていて何も共有していない。", [item])


def test_rows_and_items_without_ids(spark):
    passage, other = " ".join(ITEMS[1]), " ".join(noise(30))
    docs = spark.createDataFrame([(None, f"before {passage} after", 1), (None, other, 2), (None, None, 3), (1, passage, 4), (2, other, 5)], "doc_id long, text string, __key int")
    items = spark.createDataFrame([(None, passage), (None, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["n_tokens"]) for r in d.contaminations(docs, items).collect()}
    assert found == {(None, None, 20), (1, None, 20)}
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["__key"] for r in kept.collect()) == [2, 3, 5]
