"""Line dedup, quality rules and URL filters on small cases (whole tables are held against SQL)."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import catalog, lines, quality, urls

FIXED = "a line that many documents of the corpus have in common"


def left(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_recurring_lines_stay_once(spark):
    rows = [(i, f"own words number {'abcdefghij'[i]} start here now\n{FIXED}\nend") for i in range(6)]
    rows += [(20, FIXED), (21, None), (22, ""), (23, "short one\nshort one"), (24, f"{FIXED}\n{FIXED}")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int")
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["__gone"] == []
    assert all(got[i]["text"] == rows[i][1].replace(FIXED + "\n", "") and [tuple(g) for g in got[i]["__gone"]] == [(1, 0)] for i in range(1, 6))
    assert got[20]["text"] == "" and got[24]["text"] == "" and got[21]["text"] is None and got[22]["text"] == "" and got[23]["text"] == "short one\nshort one"
    assert got[0]["line"] == 1
    kept = lines.without_recurring(docs)
    assert kept.columns == docs.columns and set(left(kept)) == {*range(6), 21, 22, 23}


NAMES = ["anna", "bert", "carl", "dora"]


def test_variable_fields_are_generalised(spark):
    def make(k):
        return [
            f"order {100 + k} was shipped to {NAMES[k]} from our main store in the old town",
            f"user {NAMES[k]} has logged in from {NAMES[-k - 1]}ville to the reading room of ours",  # two fields, one near the head
            f"{NAMES[k]} has signed the guest book of the town hall today",  # a field before the trailing path
            f"the guest book of the town hall was signed by {NAMES[k]}",
            f"zugang gewährt von hauptverwaltung {NAMES[k]} heutemorgen",  # six tokens
            f"the main reason is {' '.join(w + NAMES[k] for w in ('apple', 'pear', 'plum', 'fig', 'lime', 'kiwi'))}",  # a shared path alone is no template
        ]

    docs = spark.createDataFrame([(k, "\n".join(make(k))) for k in range(4)], "doc_id long, text string")
    assert left(lines.dedup(docs)) == {0: "\n".join(make(0)), **{k: make(k)[-1] for k in (1, 2, 3)}}
    # Two documents are not enough for a generalised template, unless nothing but digits differs.
    assert left(lines.dedup(docs.where("doc_id < 2"))) == {k: "\n".join(make(k)) for k in (0, 1)}


def test_lines_of_two_documents_recur_unless_short(spark):
    docs = spark.createDataFrame([(1, FIXED), (2, FIXED), (2, FIXED), (None, FIXED)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup(docs).collect()) == [(0, FIXED), (1, FIXED), (2, ""), (2, "")]
    short = spark.createDataFrame([(i, "All rights reserved.") for i in range(12)], "doc_id long, text string")
    assert left(lines.dedup(short)) == {i: "All rights reserved." if i == 0 else "" for i in range(12)}
    assert set(left(lines.dedup(short.where("doc_id < 9"))).values()) == {"All rights reserved."}
    unspaced = "全ての文書に共通する一文がここにあり、空白を含まないが十分に長いので一行として数えられるものとする。"
    assert left(lines.dedup(spark.createDataFrame([(5, unspaced), (7, unspaced)], "doc_id long, text string"))) == {5: unspaced, 7: ""}
    assert lines.digest(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    more = ["__doc", "__gone", "doc", "line", "gone", "whole", "kept_in", "w", "m", "a.b"]
    docs = spark.createDataFrame([(i, FIXED, *range(len(more))) for i in (4, 9)], ["doc_id", "text", *more])
    assert sorted(map(tuple, lines.without_recurring(docs).collect())) == [(4, FIXED, *range(len(more)))]


def test_long_texts(spark):
    many = "\n".join(f"line {chr(97 + k % 26)}{'x' * (k % 97)} of a very long document that has a great many of them" for k in range(20000))
    docs = spark.createDataFrame([(1, many), (2, "x" * 2_000_000), (3, "9" * 2_000_000 + "\n" + FIXED)], "doc_id long, text string")
    assert left(lines.dedup(docs)) == {1: many, 2: "x" * 2_000_000, 3: "9" * 2_000_000 + "\n" + FIXED}


TEXTS = [
    None, "", "\n \t", "few words only", "one two three " * 30, " ".join(f"w{k}" for k in range(60)), " ".join(f"word{k}***" for k in range(60)), " ".join(f"WORD{k}" for k in range(60)),
    "\n".join(["the very same line of text here"] * 3 + [f"line {k} of its own with a few more words" for k in range(9)]), "a b c d a b c", "a b a b a b a b", " ".join("ab" for _ in range(51)), "x" * 40000, ("é ñ ü " * 20 + "\r\n") * 3,
    " ".join(f"long{'x' * 40}{k}" for k in range(60)),
]


def test_quality_counts_match_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(quality.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in quality.measure(docs).collect()) == sorted(want.fetchall())


def test_filter_keeps_what_no_rule_rejects(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in quality.measure(docs).where("kept").collect()}
    assert 5 in kept and not kept & {0, 1, 2, 3, 4, 6, 7}
    for order in (quality.RULES, quality.RULES[::-1]):
        assert docs.where(~quality.rejection(order, quality.text_of("text"))).count() == len(kept)


def test_greedy_order_is_by_what_is_left():
    rejects = [(True, True, False)] * 6 + [(False, False, True)] * 2 + [(False, False, False)] * 4
    assert quality.greedy_order(rejects, [1.0, 1.1, 1.0]) == [0, 2, 1]
    assert quality.greedy_order(rejects, [10.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.greedy_order([], [1.0, 1.0]) == [0, 1]


def test_sample_is_not_the_head_of_a_table(spark, tmp_path):
    frame = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text", "1 AS t")
    frame.repartitionByRange(20, "doc_id").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    for docs in (table, table.where("doc_id >= 0"), spark.createDataFrame(table.limit(900).collect())):
        texts = quality.sample_texts(docs, rows=100)
        assert 50 <= len(texts) <= 100
    ids = [int(x[1:]) for x in quality.sample_texts(table, rows=100)]
    assert max(ids) - min(ids) > 1500
    assert quality.sample_texts(table.limit(0)) == []


def test_rule_order_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}
    assert quality.order_rules(docs.limit(0)) == quality.RULES
    assert quality.measure(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


CASES = {
    "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
    "https://example.com/en/1": ("example.com", "/en/1", "com/en/", "block"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "x://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
    "http://q.net/de/": ("q.net", "/de/", "net/de/", "allow"),
    "http://a.org/es": ("a.org", "/es", None, "allow"),
    "http://h?/a": ("h", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http:///en/": ("", "/en/", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*CASES, None])], "page_id long, url string, host int")
    labels = spark.createDataFrame([(0, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, labels).collect()}
    for i, want in enumerate([*CASES.values(), ("", "", None, "allow")]):
        assert got[i] == want, (i, got[i])
    assert urls.judge(pages.limit(0), labels.limit(0)).count() == 0


def planted_hosts():
    """Labelled pages by host, and hosts of which some should be blocked: by themselves, their domain or their suffix."""
    rows = [(f"h{i % 60}.site{i % 30}.test", i // 60 % 20 == 0) for i in range(3000)]
    rows += [("bad.site1.test", True)] * 40 + [("one.site2.test", True)]
    rows += [(f"w{i}.farm.test", True) for i in range(40) for _ in range(4)] + [("new.farm.test", None)]
    rows += [(f"shop{i}.spam", True) for i in range(40) for _ in range(4)] + [("fresh.other.spam:8080", None), ("quiet.site3.test", None)]
    return rows


def test_hosts_are_blocked_by_host_domain_and_suffix_like_sql(spark, tmp_path):
    rows = planted_hosts()
    pages = spark.createDataFrame([(i, f"http://{h}/x", i) for i, (h, _) in enumerate(rows)], "page_id long, url string, poor int")
    labels = spark.createDataFrame([(i, 0 if bad else 1, None) for i, (_, bad) in enumerate(rows) if bad is not None], "doc_id long, quality int, toxic int")
    for name, frame in (("pages", pages), ("labels", labels)):
        frame.write.parquet(str(tmp_path / name))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.execute(f"SELECT page_id, verdict FROM ({urls.ORACLE})").fetchall()
    got = sorted((r["page_id"], r["verdict"]) for r in urls.judge(pages, labels).collect())
    assert got == sorted(want)
    blocked = {rows[i][0] for i, verdict in got if verdict == "block"}
    assert blocked == {"bad.site1.test", "new.farm.test", "fresh.other.spam:8080"} | {h for h, bad in rows if bad and h.endswith((".farm.test", ".spam"))}


def test_posterior_probability_matches_a_plain_sum(spark):
    rng = np.random.default_rng(4)
    cases = [(0.3, 4.0), (1.0, 1.0), (40.5, 3.2), (1000.0, 1400.0), (5e5, 6e5), (0.52, 1.48)] + [tuple(rng.uniform(0.3, 60, 2)) for _ in range(20)]
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    for row in frame.select("a", "b", urls.exceeds(F.col("a"), F.col("b"), 0.45).alias("p")).collect():
        y = np.linspace(np.log(row["a"] / row["b"]) - 200 / min(row["a"], 1), np.log(row["a"] / row["b"]) + 200 / min(row["b"], 1), 4_000_001) if row["a"] < 1000 else np.linspace(-0.5, 0.5, 4_000_001) + np.log(row["a"] / row["b"])
        f = -row["a"] * np.logaddexp(0, -y) - row["b"] * np.logaddexp(0, y)
        f = np.exp(f - f.max())
        assert abs(row["p"] - f[y > np.log(0.45 / 0.55)].sum() / f.sum()) < 1e-4


def test_levels_of_hosts(spark):
    names = {"a.b.co.uk:81": ("b.co.uk", "co.uk"), "me@x.example.com.": ("example.com", "com"), "10.0.0.1": ("10.0.0.1", ""), "u.github.io": ("u.github.io", "github.io"), "test": ("test", "test"), "co.uk": ("co.uk", "co.uk")}
    frame = spark.createDataFrame([(h,) for h in names], "h string").select("h", urls.domain_of(F.col("h")).alias("d"), urls.suffix_of(F.col("h")).alias("s"))
    assert {r["h"]: (r["d"], r["s"]) for r in frame.collect()} == names


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_whole_tables_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[c] for c in names) for r in catalog.QUERIES[name](spark, folder).collect()), key=key) == sorted(want.fetchall(), key=key)


def log_lines(rng, n, fields, values, docs=25):
    """The same line in many documents, but for fields of so many values."""
    base = [f"w{k}".translate(str.maketrans("0123456789", "abcdefghij")) + "x" for k in rng.sample(range(100, 900), n)]
    word = lambda: "".join(rng.choices("bcdfghklmnprstvz", k=5))
    pools = {f: [word() for _ in range(values)] for f in fields}
    return [" ".join(rng.choice(pools[k]) if k in pools else w for k, w in enumerate(base)) for _ in range(docs)]


def test_fields_of_few_values_and_at_both_ends_recur(spark):
    import random

    rng, cases = random.Random(11), []
    for n in (4, 5, 6, 7, 8, 10, 12, 16, 24, 40):
        for values in (2, 5, 1000):
            for fields in ([0], [n - 1], [0, n - 1], sorted(rng.sample(range(n), max(1, min(n // 4, 4))))):
                if 3 * len(fields) <= n:
                    cases.append(log_lines(rng, n, fields, values))
    rows = [(1000 * j + k, line) for j, case in enumerate(cases) for k, line in enumerate(case)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = [sum(got[1000 * j + k] == "" for k in range(1, len(case))) / (len(case) - 1) for j, case in enumerate(cases)]
    long = [s for s, case in zip(shares, cases, strict=True) if min(map(len, case)) - case[0].count(" ") >= 40]
    assert sum(long) / len(long) >= 0.9 and sorted(long)[len(long) // 10] >= 0.9


def test_unlike_lines_of_a_leaf_stay(spark):
    import random

    rng = random.Random(12)
    head = "the committee has decided that".split()
    words = ["".join(rng.choices("bcdfghklmnprstvz", k=6)) for _ in range(400)]
    rows = [(k, " ".join(head + rng.sample(words, 15))) for k in range(200)]  # a quarter of the tokens in common
    assert {r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {t for _, t in rows}


def test_only_lines_that_are_asked_for_are_cut_into_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"first of all\n{FIXED}"), (2, "n1  a\x0b2b\r 3 Ünder\tx٣ "), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    members = spark.createDataFrame([((2, 0),), ((1, 1),)], "first struct<doc:long,line:int>").withColumn("whole", F.lit(1).cast("long"))
    words = lines.words_at(docs, members, "doc_id", "text")
    assert [len(r["words"]) for r in words.orderBy(F.size("words")).collect()] == [6, 11]
    plan = members.join(words, F.col("whole") == F.col("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "split(trim" in x]
    got = docs.where("doc_id = 2").select(lines.tokens(F.col("text")).alias("t")).first()["t"]
    assert got == ["<*>", "a", "<*>", "<*>", "Ünder", "x٣"]
