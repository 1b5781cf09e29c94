"""Queries over all rows of small tables, against brute force."""

from __future__ import annotations

import datetime
import random

from terrane.plans import catalog


def test_components_of_all_orders(spark, tmp_path):
    orders = [(7 * k + 1, k // 3) for k in range(60)] + [(4001 * 5 + 1, 40), (8, 41), (7, 90)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for key, customer in orders:
        a, b = sorted((find(customer), find(-1 - key % 4001)))
        root[b] = a
    got = {r["node"]: r["component"] for r in catalog.queries()["match_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_runs_and_rows_of_all_users(spark, tmp_path):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    events = [(k, rng.randrange(1, 120), start + datetime.timedelta(minutes=rng.randrange(0, 400) * 15)) for k in range(600)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for user in {u for _, u, _ in events}:
        own = [t for _, u, t in events if u == user]
        hits = sum(u % 50 == user % 49 and min(own) <= t <= max(own) for _, u, t in events)
        if hits:
            want[user] = hits
    got = {r["job"]: r["hits"] for r in catalog.queries()["interval_hits"](spark, str(tmp_path)).collect()}
    assert got == want and any(u % 50 for u in got)
