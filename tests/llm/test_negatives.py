"""Hard-negative mining against plain Python integers."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from terrane.llm import negatives

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives_=10, low=30, high=90):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    anchors = {}
    for i, v, y in good:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    for i, (y, v) in anchors.items():
        same = sorted((-dot(v, w), j) for j, w, z in good if z == y and j != i)[:positives]
        for s, j in same:
            p = -s
            found = sorted((-dot(v, w), k) for k, w, z in good if z != y and low * p <= 100 * dot(v, w) <= high * p)[:negatives_]
            out += [(i, j, r, k, p, -t) for r, (t, k) in enumerate(found, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_random_vectors_ties_and_bad_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.4, 0.9]) + rng.random() * (i % 3) for _ in range(4)], rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, [0.9, 0.9, 0.4, 0.4], i % 3) for i in range(200)]  # one vector many times
    rows += [(2000, None, 1), (2010, [1.0, None, 0.2, 0.3], 1), (2020, [1.0, float("nan"), 0.2, 0.3], 1), (2030, [1.0, float("inf"), 0.2, 0.3], 0), (2040, [0.5, 0.5], None), (2050, [0.5, 0.5], 1), (2060, [], 2), (None, [0.1] * 4, 1), (2070, [0.7] * 4, 2)]
    got = mined(spark.createDataFrame(rows, SHAPE).repartition(5))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 500
    assert got == mined(spark.createDataFrame(rows, SHAPE).repartition(3), block_anchors=7)


def test_ids_decide_where_thousands_share_a_score(spark):
    rows = [(0, [1.0], 0), (1, [1.0], 0)] + [(3 * k - 4000, [0.5], 1) for k in range(3000) if (3 * k - 4000) % 10]
    got = negatives.mine(spark.createDataFrame(rows, SHAPE).repartition(6), F.col("vec_id") == 0)
    assert [r["negative_id"] for r in got.orderBy("rank").collect()] == sorted(i for i, _, y in rows if y)[:10]


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    rows = [(10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (11, [0.9, 0.4], 1), (11, [0.9, 0.4], 1), (12, [0.5, 0.3], 0), (12, [0.5, 0.3], 0)]
    df = spark.createDataFrame(rows, SHAPE)
    for c in ("id", "label ", "v", "w", "score", "rank", "q", "x", "anchor_id", "positive_id", "n", "bucket"):
        df = df.withColumn(c, F.lit("?"))
    assert mined(df) == brute(rows, lambda i: i == 10)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id > 10")) == []
    assert mined(df.where("vec_id = 10")) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [60000.0, 1.5], 0), (1, [60000.0, -3.25], 0), (2, [30000.0, 7.0], 1), (3, [29999.996, 9.0], 1), (4, [70000.0, 1.0], 1)]
    assert mined(spark.createDataFrame(rows, SHAPE)) == brute(rows[:4], lambda i: i == 0)  # the last row is beyond the limit


def test_contract_against_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.randrange(10) if i % 37 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = con.execute(negatives.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in negatives.digest(df).collect()) == sorted(want.fetchall())
