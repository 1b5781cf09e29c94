"""Scans with reports, commits of several tables, ids of trees, documents, addresses by the standard, numbering plans, keyed state."""

from __future__ import annotations

import datetime
import json
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.functions import numbering, text, urls, web_address
from terrane.operators import documents, trees
from terrane.plans import catalog
from terrane.sources import places, scans, snapshots
from terrane.streaming import state

CYPRUS = places.Box(34.5, 32.2, 35.7, 34.6)


def nested(spark, shift=0.0):
    rows = [(f"p{k}", float(33 + k / 100), float(34.7 + k / 100 + shift), 0.5 + k / 20) for k in range(10)]
    return spark.createDataFrame(rows, "id string, x double, y double, confidence double").select("id", "confidence", F.struct(F.col("x").alias("xmin"), (F.col("x") + 0.0001).alias("xmax"), F.col("y").alias("ymin"), (F.col("y") + 0.0001).alias("ymax")).alias("bbox"))


def scanned_rows(df):
    """Rows that the scan of an executed frame has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_row_groups_outside_the_box_are_skipped(spark, tmp_path):
    near, far = str(tmp_path / "near"), str(tmp_path / "far")
    nested(spark).coalesce(1).write.parquet(near)
    nested(spark, 3.0).coalesce(1).write.parquet(far)
    files = spark.read.parquet(near, far)
    groups = scans.row_groups(files, "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax", "id")
    (r,) = scans.group_report(groups, scans.may_touch(CYPRUS)).collect()
    assert (r["files"], r["groups_read"], r["groups_skipped"], r["rows_in_groups_read"]) == (2, 1, 1, 10)
    assert [(x["id_min"], x["id_max"]) for x in groups.collect()] == [("p0", "p9")] * 2
    near_box = (F.col("bbox.ymax") >= CYPRUS.south) & (F.col("bbox.ymin") <= CYPRUS.north)
    kept = files.where(near_box).select("id")
    assert "GreaterThanOrEqual(bbox.ymax" in kept._jdf.queryExecution().toString()
    assert scanned_rows(kept) == 10 and kept.count() == 10
    blank = groups.withColumn("bbox_xmin_min", F.lit(None).cast("double"))
    assert scans.group_report(blank, scans.may_touch(CYPRUS)).first()["groups_skipped"] == 0  # without statistics nothing is proven


def test_a_key_column_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "flat")
    row = lambda i, country: (f"f{i}", f"n{i}", 34.7, 33.0, country, None, None, None, None, None, None, None, None, None, None, None, None, None, None)
    shape = "fsq_place_id string, name string, latitude double, longitude double, country string, " + ", ".join(f"{c} string" for c in ("website", "tel", "address", "locality", "region", "postcode", "instagram", "twitter", "email", "facebook_id", "date_created", "date_refreshed", "date_closed")) + ", fsq_category_ids array<string>"
    rows = [row(k, c) for k, c in enumerate(["CY", "cy", "Cy", "GR", None])]
    df = spark.createDataFrame([r + (None,) if len(r) < 19 else r for r in rows], shape).withColumn("fsq_category_labels", F.lit(None).cast("array<string>"))
    df.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = places.flat_places(spark.read.parquet(path), CYPRUS, "CY")
    assert {r["id"] for r in found.collect()} == {"f0", "f1", "f2"}
    assert "In(country, [CY,Cy,cY,cy])" in found._jdf.queryExecution().executedPlan().toString()
    groups = scans.row_groups(spark.read.parquet(path), "country")
    assert groups.where(scans.may_hold("country", "AA")).count() == 0 and groups.where(scans.may_hold("country", "GR")).count() == 1


def test_counters_come_from_the_job_that_writes(spark, tmp_path):
    reason = F.when(F.col("confidence") < 0.6, "low_confidence").otherwise(scans.KEPT)
    log = scans.ImportLog(str(tmp_path / "log"))
    stats = log.run(spark, "overture", "CY", "r1", lambda: scans.import_scan(nested(spark), reason, ("low_confidence", "closed"), lambda df: df.write.parquet(str(tmp_path / "kept")), {"sure": F.col("confidence") > 0.9}))
    assert stats == {"read": 10, "kept": 8, "low_confidence": 2, "closed": 0, "sure": 1}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|boom"):
        log.run(spark, "overture", "GR", "r1", lambda: scans.import_scan(nested(spark), F.when(F.raise_error(F.lit("boom")).isNull(), "x"), (), lambda df: df.write.parquet(str(tmp_path / "failed"))))
    states = {r["country_code"]: r for r in log.states(spark).collect()}
    assert states["CY"]["status"] == "DONE" and json.loads(states["CY"]["stats"]) == stats and states["CY"]["started_at"] <= states["CY"]["finished_at"]
    assert states["GR"]["status"] == "FAILED" and "boom" in json.loads(states["GR"]["stats"])["error"]
    assert [r["country_code"] for r in scans.last_import(log.states(spark)).collect()] == ["CY"]


def test_members_of_archives(spark, tmp_path):
    lines = "\n".join("\t".join([str(k), f"n{k}", "", "a, b", "34.7", "33", "P", "PPL", "CY", "", "01", "", "", "", "500", "", "", "", ""]) for k in range(25_000))
    with zipfile.ZipFile(tmp_path / "CY.zip", "w") as z:
        z.writestr("readme.txt", "x\r\ny")
        z.writestr("CY.txt", lines)
    (tmp_path / "CY.txt").write_text(lines)
    archives = spark.read.format("binaryFile").load(str(tmp_path / "CY.zip"))
    got = scans.member_lines(archives, "CY.txt")
    assert sorted(map(str, places.gazetteer(got).collect())) == sorted(map(str, places.read_gazetteer(spark, str(tmp_path / "CY.txt")).collect()))
    assert [(r["member"], r["line_no"], r["value"]) for r in scans.member_lines(archives).where("member = 'readme.txt'").orderBy("line_no").collect()] == [("readme.txt", 0, "x"), ("readme.txt", 1, "y")]
    with pytest.raises(Exception, match="has no member"):
        scans.member_lines(archives, "GR.txt").count()
    with pytest.raises(Exception, match="no zip archive"):
        scans.member_lines(spark.read.format("binaryFile").load(str(tmp_path / "CY.txt"))).count()


def test_a_commit_shows_whole_or_not_at_all(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame([(k,) for k in x], "id int")
    ids = lambda t, v=None: sorted(r["id"] for r in store.read(t, v).collect())
    assert store.manifest()["version"] == 0
    one = snapshots.commit_merge(store, rows(1, 2), rows(10), {"subcategories": rows(5)}, rows(100), 0)
    broken = rows(3).select(F.raise_error(F.lit("killed between writes")).cast("int").alias("id"))
    with pytest.raises(Exception, match="killed between writes"):
        store.commit({"places": {"all": rows(7)}, "emails": {"all": broken}}, one)
    assert (ids("places"), ids("emails"), ids("audit")) == ([1, 2], [10], [100])
    two = snapshots.commit_merge(store, rows(1), rows(10, 11), {}, rows(101), one)
    assert (ids("places"), ids("emails"), ids("subcategories"), ids("audit")) == ([1], [10, 11], [5], [100, 101]) and ids("places", one) == [1, 2]
    with pytest.raises(snapshots.ConflictError):
        store.commit({"places": {"all": rows(9)}}, one)
    # A writer that stops inside its manifest has not committed; its number is skipped.
    (tmp_path / "store" / "manifests" / f"{two + 1:08d}.json").write_text('{"version": 3, "tab')
    assert store.manifest()["version"] == two
    three = snapshots.replace_release(store, "places", rows(8), "CY", "r2", two)
    assert three == two + 2 and ids("places") == [1, 8]
    assert store.retry(lambda v: {"places": {"CY": None}}) == three + 1 and ids("places") == [1]
    gone = store.vacuum(keep=1)
    assert len(gone) >= 4 and ids("places") == [1] and ids("audit") == [100, 101]


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (snapshots.Store(spark, str(tmp_path / "store")) for _ in range(2))
    rows = spark.range(3)
    first = a.commit({"t": {"all": rows}}, 0)
    b._create(first + 1, {"version": first + 1, "tables": {}, "info": {}, "whole": True})  # the other is faster
    with pytest.raises(snapshots.ConflictError):
        a._create(first + 1, {"version": first + 1, "tables": {}, "info": {}, "whole": True})
    with pytest.raises(snapshots.ConflictError):
        a.commit({"t": {"all": rows}}, first)


def test_ids_of_a_tree_last(spark):
    shape = "geonames_id long, parent_geonames_id long, type string, name string"
    old = spark.createDataFrame([(7, 1, None, "COUNTRY", "Cyprus", True), (9, 50, 7, "REGION", "Old name", False), (3, 99, 9, "CITY", "No draft", True)], "id long, geonames_id long, parent_id long, type string, name string, active boolean")
    drafts = spark.createDataFrame([(1, None, "COUNTRY", "Cyprus"), (50, 1, "REGION", "Limassol"), (40, 50, "REGION", "District"), (30, 40, "CITY", "B"), (20, 99, "CITY", "Below a known one"), (10, 40, "CITY", "A")], shape)
    got = {r["geonames_id"]: r for r in trees.upsert_tree(old, drafts).collect()}
    assert {k: (r["id"], r["parent_id"], r["change"], r["active"]) for k, r in got.items()} == {
        1: (7, None, "same", True), 50: (9, 7, "updated", False), 40: (11, 9, "inserted", True), 30: (13, 11, "inserted", True), 10: (12, 11, "inserted", True), 20: (10, 3, "inserted", True), 99: (3, 9, "untouched", True),
    }
    again = trees.upsert_tree(trees.upsert_tree(old, drafts).drop("change"), drafts).collect()
    assert {r["change"] for r in again} == {"same", "untouched"} and {(r["id"], r["geonames_id"]) for r in again} == {(r["id"], k) for k, r in got.items()}
    for bad in ([(5, 6, "REGION", "x")], [(5, 6, "REGION", "x"), (6, 5, "REGION", "y")]):
        with pytest.raises(ValueError, match="missing or circular parent"):
            trees.upsert_tree(old, spark.createDataFrame(bad, shape))


def test_recursion_over_several_roots_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "A"), (2, 1, "A"), (3, 2, "CITY"), (4, 2, "CITY"), (5, None, "CITY"), (6, 5, "CITY"), (7, 8, "A"), (8, 7, "CITY")], "id long, parent_id long, type string")
    roots = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(trees.leaves_below(nodes, roots(1, 2, 5, 5))) == [3, 4, 5, 6] and ids(trees.leaves_below(nodes, roots(99))) == []
    assert ids(trees.leaves_below(nodes, roots(7), fail_on_cycle=False)) == [8]
    with pytest.raises(Exception, match="cycle: 7 > 8 > 7"):
        trees.leaves_below(nodes, roots(7)).collect()
    chain = spark.createDataFrame([(k, k - 1 if k else None, "CITY" if k == 150 else "A") for k in range(151)], "id long, parent_id long, type string")
    assert ids(trees.leaves_below(chain, roots(0))) == [150]


def test_json_records_and_differences(spark):
    rows = spark.createDataFrame([(1, '[{"a": 1, "b": {"c": "x"}}, {"a": null}, {}, 7]'), (2, "no json"), (3, None), (4, '{"a": 1}'), (5, "[]")], "id int, j string")
    got = documents.records(rows, "j", {"a": "$.a int", "c": "$.b.c string"}, ("id",)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, "x"), (1, None, None), (1, None, None), (1, None, None)], key=str)
    state_of = spark.sql("SELECT parse_json('{\"a\": null, \"b\": 0}') AS v").select(*[documents.value_state(F.col("v"), f"$.{k}") for k in "abc"], documents.value_state(F.lit(None).cast("variant"), "$.a")).first()
    assert list(state_of) == ["null", "value", "missing", "missing"]
    old = spark.createDataFrame([("s", '{"a": 1, "n": {"x": [1, 2], "gone": true, "same": {"q": null}}, "e": {}}'), ("t", '{"a": 1}')], "k string, j string")
    new = spark.createDataFrame([("s", '{"n": {"same": {"q": null}, "x": [2, 1]}, "a": null, "more": {"deep": "y"}}'), ("u", '{"b": false}')], "k string, j string")
    diff = sorted(map(tuple, documents.differences(old, new, "k", "j").collect()))
    assert diff == [("s", "a", "changed", "1", "null"), ("s", "e", "removed", "{}", None), ("s", "more.deep", "added", None, '"y"'), ("s", "n.gone", "removed", "true", None), ("s", "n.x", "changed", "[1,2]", "[2,1]"), ("t", "a", "removed", "1", None), ("u", "b", "added", None, "false")]
    section = spark.createDataFrame([('{"a": 1, "b": [1], "c": 2}', '{"d": null, "b": [1, 2], "a": 1}')], "o string, n string").select(documents.section_changes(F.col("o"), F.col("n")).alias("x")).first()["x"]
    assert [tuple(x) for x in section] == [("b", "[1]", "[1,2]"), ("d", None, "null")]


ADDRESSES = {
    "http://example.com/a/./b/../c": "http example.com  /a/c", "http://example.com/a/b/..": "http example.com  /a/", "http://example.com/%2e%2E/x": "http example.com  /x", "http://example.com/../../x/.": "http example.com  /x/",
    "http://EXAMPLE.com:80/": "http example.com  /", "https://example.com:0443": "https example.com  /", "https://example.com:8080/x?": "https example.com 8080 /x ?", "http://example.com:65536/": None, "http://example.com:x/": None,
    "http://192.168.257": "http 192.168.1.1  /", "http://0x7f.1/": "http 127.0.0.1  /", "http://0300.168.0.0xF0": "http 192.168.0.240  /", "http://256.1.1.1": None, "http://4294967295": "http 255.255.255.255  /", "http://1.2.3.4.5": None, "http://1.2.3.08": None,
    "http://bücher.example/straße?q=ü": "http xn--bcher-kva.example  /stra%C3%9Fe ?q=%C3%BC", "http://例え.テスト/": "http xn--r8jz45g.xn--zckzah  /", "http://ελλάδα.gr": "http xn--hxakic4aa.gr  /", "http://münchen-ost.de": "http xn--mnchen-ost-9db.de  /", "http://пример.испытание/": "http xn--e1afmkfd.xn--80akhbyknj4f  /",
    "http://u:p@e@host.com/x#f": "http host.com  /x", "http:\\\\host.com\\a\\b?c\\d": "http host.com  /a/b ?c\\d", "http:host.com": "http host.com  /", "http:////host.com/": "http host.com  /",
    'http://host.com/a"b<c>`{}|^': "http host.com  /a%22b%3Cc%3E%60%7B%7D|%5E", "http://host.com/?a=\"b'<>`": "http host.com  / ?a=%22b%27%3C%3E`", "http://ex%41mple.com/": "http example.com  /", "http://a%2Fb.com/": None, "http://a^b.com": None, "ftp://x.com": None,
    "http://host.com/%7Efoo/%zz": "http host.com  /%7Efoo/%zz", "http://host。com/": "http host.com  /", "http:///": None, "http://a.com/?a=1?b#c?d": "http a.com  / ?a=1?b", "http://a.com/a%20b/": "http a.com  /a%20b/",
}


def test_addresses_by_the_url_standard(spark):
    got = {}
    for r in spark.createDataFrame([(k,) for k in ADDRESSES], "u string").select("u", web_address.parsed(F.col("u")).alias("p")).collect():
        p = r["p"]
        got[r["u"]] = None if p is None else f"{p['scheme']} {p['host']} {p['port']} {p['path']}" + (f" ?{p['query']}" if p["query"] is not None else "")
    assert got == ADDRESSES


def test_plain_addresses_take_the_short_way_to_the_same_end(spark):
    rows = ["http://shop.cy", "https://a-b.shop.cy/x/y.html?a=1&b=%20", "http://shop.cy/~a/?utm_x", "http://1.2.3.4/x", "http://shop.cy/a/../b", "http://shop.cy/..", "https://x.cy/.well-known/y"]
    for r in spark.createDataFrame([(k,) for k in rows], "u string").select("u", F.col("u").rlike(web_address.PLAIN).alias("plain"), urls.clean_url(F.col("u")).alias("c"), web_address.parsed(F.col("u")).alias("p")).collect():
        assert r["plain"] == (r["u"] not in rows[3:6])
        assert r["c"].startswith(f"{r['p']['scheme']}://{r['p']['host']}{r['p']['path']}")


def test_cleaned_addresses(spark):
    cases = {
        "https://www.instagram.com/mamasita.cy?igsh=MXd6a2&utm_source=qr": "https://www.instagram.com/mamasita.cy", "https://shop.cy/page?id=5&fbclid=abc&UTM_Campaign=x": "https://shop.cy/page?id=5", "https://taplink.cc/diademastudio.": "https://taplink.cc/diademastudio",
        "//cdn.shop.cy/x": "https://cdn.shop.cy/x", "not a url": None, "localhost": None, "http://shop.cy/?q=x+y&gclid=1&z": "http://shop.cy/?q=x+y&z=", "http://shop.cy/?q=x%20y&&z": "http://shop.cy/?q=x%20y&&z", "http://shop.cy/?&": "http://shop.cy/", "http://shop.cy./a": "http://shop.cy/a", "": None, "mailto:a@b.cy": None,
    }
    got = {r["u"]: r["c"] for r in spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.clean_url(F.col("u")).alias("c")).collect()}
    assert got == cases


def test_marks_of_all_code_points(spark):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    lines = ["".join(letters[k : k + 64]) for k in range(0, len(letters), 64)]
    want = {x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.category(c).startswith("M")) for x in lines}
    got = {r["t"]: r["g"] for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", text.strip_marks(F.col("t")).alias("g")).collect()}
    assert got == want


def test_numbers_by_a_plan(spark, tmp_path):
    plan = [
        "country\tcalling_code\tnational_prefix\trange\tleast\tmost\tkind", "US\t1\t1\t\t10\t10\tFIXED", "CA\t1\t1\t416\t10\t10\tFIXED", "CY\t357\t\t2\t8\t8\tFIXED", "CY\t357\t\t9\t8\t8\tMOBILE", "IT\t39\t\t0\t6\t11\tFIXED", "IT\t39\t\t3\t9\t10\tMOBILE", "VA\t39\t\t06698\t10\t10\tFIXED", "GB\t44\t0\t\t9\t10\tFIXED", "GB\t44\t0\t7\t10\t10\tMOBILE",
    ]
    (tmp_path / "plan.tsv").write_text("\n".join(plan))
    rows = [("99 123456", "cy", "+35799123456", "CY", "MOBILE"), ("+1 416 555 1234", "CY", "+14165551234", "CA", "FIXED"), ("(212) 555-1234", "US", "+12125551234", "US", "FIXED"), ("1 212 555 1234", "US", "+12125551234", "US", "FIXED"), ("06 698 12345", "IT", "+390669812345", "VA", "FIXED"), ("06 1234567", "IT", "+39061234567", "IT", "FIXED"), ("020 7946 0018", "GB", "+442079460018", "GB", "FIXED"), ("+44 (0)7700 900123", "CY", "+447700900123", "GB", "MOBILE"), ("00357 25 123456 ext. 5", "GB", "+35725123456", "CY", "FIXED"), ("7 123", "GB", None, None, None), ("99 12345", "CY", None, None, None), ("call me", "CY", None, None, None), (None, "CY", None, None, None), ("99123456", "XX", None, None, None), ("99123456", None, None, None, None)]
    df = spark.createDataFrame([r[:2] for r in rows] * 2, "phone string, country_code string")
    got = numbering.numbers(df, numbering.read_plan(spark, str(tmp_path / "plan.tsv"))).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(rows * 2, "phone string, country_code string, number string, number_country string, number_kind string").collect())
    (tmp_path / "twice.tsv").write_text("\n".join([*plan, plan[-1]]))
    with pytest.raises(ValueError, match="ranges occur twice"):
        numbering.read_plan(spark, str(tmp_path / "twice.tsv"))


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def run_stream(spark, frame, out, marks):
    query = frame.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
    query.awaitTermination(120)


def test_leases_over_a_stream_and_its_restart(spark, tmp_path):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    shape = "task_id string, event string, at timestamp"
    batches = [
        [("a", "claim", at(0)), ("b", "claim", at(0)), ("a", "beat", at(8)), ("c", "beat", at(1)), ("d", "claim", at(1)), ("d", "release", at(2))],
        [("a", "beat", at(15)), ("z", "claim", at(16))],
        [("z", "beat", at(24)), ("b", "claim", at(24)), ("b", "claim", at(25))],
        [("z", "beat", at(60))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, state.lease_changes(spark.readStream.schema(shape).parquet(source), 600), out, marks)  # each time from the checkpoint
    run_stream(spark, state.lease_changes(spark.readStream.schema(shape).parquet(source), 600), out, marks)  # nothing new: nothing again
    got = sorted((r["task_id"], r["at"], r["status"]) for r in spark.read.parquet(out).collect())
    assert got == sorted([
        ("a", at(0), "RUNNING"), ("a", at(25), "EXPIRED"), ("b", at(0), "RUNNING"), ("b", at(10), "EXPIRED"), ("b", at(24), "RUNNING"), ("b", at(35), "EXPIRED"), ("d", at(1), "RUNNING"), ("d", at(2), "RELEASED"), ("z", at(16), "RUNNING"), ("z", at(34), "EXPIRED"),
    ])


def test_workers_over_a_stream_and_its_restart(spark, tmp_path):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    shape = "worker string, at timestamp"
    batches = [
        [("a", at(0)), ("b", at(0)), ("a", at(9)), ("a", at(9)), ("c", at(1)), ("d", None)],
        [("a", at(18)), ("z", at(19)), ("z", at(29))],
        [],
        [("b", at(30)), ("b", at(2)), ("y", at(3)), ("a", at(40))],  # two of them late
        [("z", at(60))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        state.follow_workers(spark.readStream.schema(shape).parquet(source), out, marks, 600).awaitTermination(120)  # each time from the checkpoint
        once = sorted(map(str, state.worker_log(spark, out).collect()))
    state.follow_workers(spark.readStream.schema(shape).parquet(source), out, marks, 600).awaitTermination(120)  # nothing new: nothing again
    got = state.worker_log(spark, out).collect()
    assert once == sorted(map(str, got))
    assert sorted((r["task_id"], r["at"], r["status"]) for r in got) == sorted([
        ("a", at(0), "RUNNING"), ("a", at(28), "EXPIRED"), ("a", at(40), "RUNNING"), ("a", at(50), "EXPIRED"), ("b", at(0), "RUNNING"), ("b", at(10), "EXPIRED"), ("b", at(30), "RUNNING"), ("b", at(40), "EXPIRED"),
        ("c", at(1), "RUNNING"), ("c", at(11), "EXPIRED"), ("z", at(19), "RUNNING"), ("z", at(29), "EXPIRED"), ("z", at(29), "RUNNING"), ("z", at(39), "EXPIRED"), ("z", at(60), "RUNNING"),
    ])


def test_a_batch_of_beats_is_one_plan_without_python(spark):
    beats = spark.createDataFrame([("a", at(0)), ("a", at(5))], "worker string, at timestamp")
    plan = state.beat_turns(beats, spark.createDataFrame([], state.TURNS), 600)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning") == 1


def test_streaks_over_a_stream_equal_the_batch(spark, tmp_path):
    from terrane.operators.state import failure_streaks

    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    shape = "name string, at timestamp, ok boolean"
    batches = [[("x", at(1), False), ("x", at(2), True), ("x", at(3), False), ("y", at(1), False)], [("x", at(5), False), ("y", at(0), True)], [("x", at(4), True), ("z", at(9), True)]]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        seen = []
        log = spark.readStream.schema(shape).parquet(source)
        query = state.streak_changes(log).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", marks).trigger(availableNow=True).start()  # noqa: B023
        query.awaitTermination(120)
        want = {r["name"]: (r["ok_at"], r["error_at"] if r["errors"] else None, r["errors"]) for r in failure_streaks(spark.read.schema(shape).parquet(source)).collect()}
        names = {n for n, _, _ in rows}
        assert {r["name"]: (r["ok_at"], r["error_at"], r["errors"]) for r in seen} == {n: want[n] for n in names}


def test_row_group_query(spark):
    (r,) = catalog.queries()["row_groups_read"](spark, "/root/testdata/sf0.001").collect()
    assert r["files"] == 1 and r["groups_read"] >= 1


def test_search_areas_by_plain_rules(spark):
    import random

    from terrane.operators.places import plan_search_areas

    rng = random.Random(8)
    rows = []
    for k in range(400):
        lat, lng, reach = rng.random() * 4, rng.random() * 4 - 2, rng.random() * 0.6
        rows.append((rng.choice(["CY", "GR"]), k, f"n{k}", lat, lng, rng.choice([None, 100, 4999, 5000, 8000, 20000, 90000]), rng.choice([None, 7, 8]), "district", lat - reach, lng - reach, lat + reach, lng + reach))
    shape = "country_code string, id long, name string, lat double, lng double, population long, parent_id long, parent_name string, south double, west double, north double, east double"
    want = {}
    for country in ("CY", "GR"):
        areas, left = [], {}
        for c in sorted((r for r in rows if r[0] == country), key=lambda r: (-(r[5] or 0), r[1])):
            home = next((a for a in areas if a[0][8] <= c[3] <= a[0][10] and a[0][9] <= c[4] <= a[0][11]), None)
            if home:
                home[1].append(c[1])
            elif (c[5] or 0) >= 5000:
                areas.append((c, [c[1]]))
            else:
                left.setdefault(c[6], []).append(c[1])
        want |= {(country, f"city:{c[1]}"): ids for c, ids in areas}
        want |= {(country, f"rural:{p}" if p else f"rural:place-{ids[0]}"): ids for p, ids in left.items()}
    got = {(r["country_code"], r["key"]): r["covered"] for r in plan_search_areas(spark.createDataFrame(rows, shape)).collect()}
    assert got == want
    assert plan_search_areas(spark.createDataFrame([], shape)).count() == 0


def test_search_areas_of_cities_at_one_spot(spark):
    import random

    from terrane.operators.places import plan_search_areas

    rng, rows = random.Random(5), []
    for k in range(300):
        lat, lng, reach = rng.randrange(4) * 0.3, rng.randrange(3) * 0.3, rng.choice([-0.1, 0.1, 0.35])
        rows.append((rng.choice(["CY", None]), k, lat, lng, rng.choice([100, 4999, 5000, 8000, 20000]), lat - reach, lng - reach, lat + reach, lng + reach))
    shape = "country_code string, id long, lat double, lng double, population long, south double, west double, north double, east double"
    cities = spark.createDataFrame(rows, shape).selectExpr("*", "'n' AS name", "1L AS parent_id", "'d' AS parent_name")
    want = {}
    for country in ("CY", None):
        areas = []
        for c in sorted((r for r in rows if r[0] == country), key=lambda r: (-r[4], r[1])):
            home = next((a for a, _ in areas if a[5] <= c[2] <= a[7] and a[6] <= c[3] <= a[8]), None)
            if home:
                want[country, f"city:{home[1]}"].append(c[1])
            elif c[4] >= 5000:
                areas.append((c, 0))
                want[country, f"city:{c[1]}"] = [c[1]]
    got = {(r["country_code"], r["key"]): r["covered"] for r in plan_search_areas(cities, include_rural=False).collect()}
    assert got == want and len(want) > 10


def test_search_areas_round_halves_like_sql(spark, tmp_path):
    from terrane.plans import catalog

    rows = [(77, "x", 1, 9998.5, "B"), (0, "x", 1, 9998.0, "B"), (1, "x", 1, 4999.5, "B"), (2, "x", 1, 4999.4, "B")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    assert {r["key"] for r in catalog.queries()["search_areas"](spark, str(tmp_path)).collect()} == {"city:0", "city:1"}


def test_lowest_levels_are_not_walked(spark, monkeypatch):
    walked = []
    walk = trees.walk
    monkeypatch.setattr(trees, "walk", lambda nodes, roots, depth: walked.append({r["id"] for r in nodes.collect()}) or walk(nodes, roots, depth))
    rows = [(1, None, "A"), (2, 1, "A"), (3, 2, "CITY"), (4, 3, "CITY"), (5, 2, "CITY"), (6, 6, "CITY"), (7, 6, "CITY"), (8, 9, "CITY"), (9, None, "CITY"), (10, None, "CITY")]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, type string")
    below = lambda *x: sorted(r["id"] for r in trees.leaves_below(nodes, spark.createDataFrame([(k,) for k in x], "id long"), fail_on_cycle=False).collect())
    assert below(1) == [3, 4, 5] and below(3, 10) == [3, 4, 10] and below(6, 77) == [6, 7] and below(8) == [8] and below(9) == [8, 9]
    assert walked[0] == {1, 2, 6}


def test_newest_events_by_month(spark):
    from terrane.operators import dashboard

    rows = [(1, f"2024-{m:02d}-{d:02d}") for m in (1, 2, 3) for d in range(1, 11)] + [(1, None), (2, "2020-01-01"), (3, "2024-01-01")]
    events = spark.createDataFrame(rows, "place_id long, at string").selectExpr("place_id", "CAST(at AS timestamp) AS at")
    got = [(r["place_id"], str(r["at"])[:7]) for r in dashboard._newest(events, spark.createDataFrame([(1,), (2,)], "w long"), 12).collect()]
    assert sorted(got) == sorted([(1, "None")] + [(1, "2024-03")] * 10 + [(1, "2024-02")] * 10 + [(2, "2020-01")])
