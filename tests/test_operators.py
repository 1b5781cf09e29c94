"""Joins, entity resolution, state changes and reports on hand-made cases."""

from __future__ import annotations

import math

import random
import struct

import pytest
from pyspark.sql import functions as F

from terrane.operators import components, dedupe, joins, leads, places, reports, state, webpages
from terrane.sources import places as sources
from terrane.sources import sinks
from terrane.streaming import refresh

PLACE = "id long, name_normalized string, lat double, lng double, website_domain string, phone_e164 string"


def find(spark, rows, **more):
    d = dedupe.find_duplicates(spark.createDataFrame(rows, PLACE), **more)
    groups = sorted((r["ids"], r["reasons"]) for r in d.groups.collect())
    return groups, sorted((r["id_a"], r["id_b"]) for r in d.possible.collect())


def test_duplicates(spark):
    rows = [
        (1, "anna beauty", 34.7, 33.0, "anna.cy", None), (2, "other name", 34.701, 33.0, "anna.cy", None),  # 111 m, same domain
        (3, "far away", 34.8, 33.0, "anna.cy", None),
        (4, "x", 35.0, 33.0, "gmail.com", "+35799111111"), (5, "x tsangara", 35.0, 33.001, "gmail.com", "+35799222222"),
        (6, "makeup christina tsangara", 35.1, 33.0, None, "+35799333333"), (7, "ctsangara makeup", 35.1005, 33.0, None, "+35799333333"),
        (8, "glamour lashes", 35.2, 33.0, None, "+35799444444"), (9, "sei bella nails", 35.2005, 33.0, None, "+35799444444"),
        (10, "blue barber limassol", 35.3, 33.0, None, None), (11, "blue barber", 35.3005, 33.0005, None, None),
        (12, "green cafe", None, None, "green.cy", None), (13, "green cafe", 35.4, 33.0, "green.cy", None), (14, "red cafe", None, None, "green.cy", None),
    ]
    groups, possible = find(spark, rows, free_domains=spark.createDataFrame([("gmail.com",)], "domain string"))
    assert groups == [([1, 2], ["DOMAIN"]), ([6, 7], ["PHONE"]), ([10, 11], ["NAME"]), ([12, 13], ["DOMAIN"])]
    assert possible == [(8, 9)]


def test_transitive_group_has_all_reasons_and_possible_pairs_fall_away(spark):
    rows = [(1, "a one", 34.7, 33.0, "s.cy", "+35799111111"), (2, "b two", 34.7, 33.0, "s.cy", "+35799222222"), (3, "two c", 34.7, 33.0, None, "+35799222222"), (4, "quite other", 34.7, 33.0, "s.cy", "+35799111111")]
    groups, possible = find(spark, rows)
    assert groups == [([1, 2, 3, 4], ["DOMAIN", "PHONE"])] and possible == []


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    random.seed(3)
    for edges in ([], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(5, None)]):
        df = spark.createDataFrame(edges, "u long, v long")
        got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
        assert got == brute_components([e for e in edges if None not in e])


def test_survivors_and_merge(spark):
    rows = [(1, 5, "NEW", True), (1, 3, "EXPORTED", False), (2, 9, "NEW", False), (2, 7, "NEW", True), (3, 8, "NEW", False), (3, 6, "NEW", False)]
    got = {r["group_id"]: r["survivor_id"] for r in dedupe.survivors(spark.createDataFrame(rows, "group_id long, id long, status string, has_primary_email boolean")).collect()}
    assert got == {1: 3, 2: 7, 3: 6}
    shape = "id long, name string, address string, lat double, lng double, website string, website_domain string, phone_raw string, phone_e164 string, phone_valid boolean, rating double, rating_count int, first_seen_at timestamp, last_seen_at timestamp, last_crawled_at timestamp"
    from datetime import datetime as t

    records = [
        (2, "two", None, None, 9.0, "http://fb.com/x", None, "123", None, False, 4.0, None, t(2024, 2, 1), t(2024, 2, 1), None),
        (1, "one", "addr1", 35.0, 33.0, None, None, "99", "+35799123456", True, 3.0, 10, t(2024, 1, 1), t(2024, 1, 1), t(2024, 3, 1)),
        (4, "four", "addr4", 36.0, 34.0, "http://own.cy/", "own.cy", "98", "+35798123456", True, 5.0, 10, t(2024, 1, 5), t(2024, 5, 1), None),
    ]
    mapping = spark.createDataFrame([(i, 1, 2) for i in (1, 2, 4)], "id long, group_id long, survivor_id long")
    (r,) = dedupe.merged_records(spark.createDataFrame(records, shape), mapping).collect()
    assert (r["id"], r["name"], r["address"], r["lat"], r["lng"]) == (2, "two", "addr1", 35.0, 33.0)
    assert (r["website"], r["website_domain"], r["phone_raw"], r["phone_e164"], r["phone_valid"]) == ("http://own.cy/", "own.cy", "99", "+35799123456", True)
    assert (r["rating"], r["rating_count"], r["first_seen_at"], r["last_seen_at"], r["last_crawled_at"]) == (3.0, 10, t(2024, 1, 1), t(2024, 5, 1), t(2024, 3, 1))


def lead_tables(spark):
    shape = "id long, name string, name_normalized string, status string, country_code string, city_name string, address string, lat double, lng double, website string, website_domain string, phone_raw string, phone_e164 string, phone_valid boolean, business_status string, rating double, rating_count int, has_category boolean, sells_online boolean, first_seen_at timestamp, last_seen_at timestamp, last_crawled_at timestamp"
    row = lambda i, name, lat, domain, phone=None: (i, name, name, "NEW", "CY", "Limassol", None, lat, 33.0, None, domain, phone, phone, phone is not None, "OPERATIONAL", 4.5, 9, True, None, None, None, None)
    rows = [row(1, "anna", 34.7, "anna.cy", "+35799123456"), row(2, "anna b", 34.7005, "anna.cy"), row(3, "zara home", 34.9, "zara.com")] + [row(10 + k, f"branch {k} of {'xyz'[k]}", 35.0 + k, "chain.cy") for k in range(3)]
    emails = [(1, "a@anna.cy", True, True, "PERSONAL", True), (2, "info@anna.cy", True, True, "GENERIC", None), (3, "dpo@zara.com", True, True, "PERSONAL", True), (10, "x@chain.cy", True, True, "PERSONAL", False)]
    return spark.createDataFrame(rows, shape), spark.createDataFrame(emails, "place_id long, email string, is_primary boolean, is_own_domain boolean, email_type string, mx_valid boolean"), spark.createDataFrame([("zara", None)], "name_normalized string, domain string")


def test_lead_pipeline_is_idempotent(spark):
    rows, emails, block = lead_tables(spark)
    first = leads.run_lead_pipeline(rows, emails, block)
    got = {r["id"]: r for r in first.places.collect()}
    assert set(got) == {1, 3, 10, 11, 12} and [tuple(r) for r in first.mapping.collect()] == [(2, 1)]
    assert got[1]["review_reasons"] == [] and got[1]["score"] == 30 + 15 + 10 + 10 + 10
    assert got[3]["chain_reason"] == "BLOCKLIST" and got[3]["review_reasons"] == ["EMAIL_ROLE", "PHONE_INVALID"]
    assert got[10]["chain_reason"] == "SHARED_DOMAIN" and got[10]["review_reasons"] == ["EMAIL_NO_MX", "PHONE_INVALID"] and got[11]["review_reasons"] == []
    moved = dedupe.redirect(emails, first.mapping)
    again = leads.run_lead_pipeline(first.places.select(rows.columns), moved, block)
    strip = lambda df: sorted(map(str, df.select(sorted(first.places.columns)).collect()))
    assert strip(again.places) == strip(first.places) and again.mapping.count() == 0


def test_score_and_reasons(spark):

    shape = "id int, primary struct<syntax_valid:boolean,mx_valid:boolean,is_own_domain:boolean,is_role:boolean>, city_name string, country_code string, phone_valid boolean, website_domain string, rating double, rating_count int, business_status string, is_chain boolean, has_category boolean, sells_online boolean"
    full = ((True, True, True, False), "Limassol", "CY", True, "shop.cy", 4.5, 10, "OPERATIONAL", False, True, None)
    change = lambda i, **k: (i, *[k.get(n, v) for n, v in zip(["primary", "city", "country", "phone", "site", "rating", "count", "status", "chain", "category", "sells"], full, strict=True)])
    rows = [change(1), change(2, chain=True), change(3, count=4), change(4, rating=3.9), change(5, primary=(True, True, False, False), site=None, status="CLOSED", rating=None), change(6, sells=True), change(7, primary=None, phone=False), change(8, primary=(False, None, True, True), city="Cyprus", category=False, phone=False)]
    got = {r["id"]: r for r in spark.createDataFrame(rows, shape).select("id", leads.lead_score().alias("s"), leads.review_reasons().alias("r")).collect()}
    assert [got[i]["s"] for i in range(1, 7)] == [75, 25, 65, 65, 10, 95]
    assert got[1]["r"] == [] and got[7]["r"] == []
    assert got[8]["r"] == ["EMAIL_SYNTAX", "EMAIL_MX_UNKNOWN", "EMAIL_ROLE", "NO_REAL_CITY", "NO_CATEGORY", "PHONE_INVALID"]


def test_suppression_split(spark):
    rows = spark.createDataFrame([("a@x.cy",), ("b@x.cy",), ("c@y.cy",), ("d@z.cy",)], "e string")
    sup = spark.createDataFrame([("a@x.cy", None), (None, "y.cy")], "e string, domain string").select(F.sha2("e", 256).alias("email_hash"), "domain")
    sup = sup.union(spark.createDataFrame([("00", "z.cy")], "email_hash string, domain string"))
    assert sorted(r["e"] for r in joins.not_suppressed(rows, F.col("e"), sup).collect()) == ["b@x.cy", "d@z.cy"]


def test_city_resolver(spark):
    cities = spark.createDataFrame([(1, "Limassol", 34.68, 33.04, 100000, 34.6, 32.9, 34.8, 33.2), (2, "Suburb", 34.7, 33.1, 20000, 34.69, 33.09, 34.71, 33.11), (3, "Village", 35.0, 33.0, 300, None, None, None, None)], "id int, name string, lat double, lng double, population int, south double, west double, north double, east double")
    points = spark.createDataFrame([(1, 34.7, 33.1, None), (2, 35.05, 33.0, None), (3, 36.0, 33.0, 3), (4, None, None, 1), (5, 36.0, 33.0, None), (6, 36.0, 33.0, 77)], "point_id int, lat double, lng double, fallback_city_id int")
    got = {r["point_id"]: (r["city_name"], r["method"]) for r in joins.city_of_points(points, cities).collect()}
    assert got == {1: ("Limassol", "CITY_AREA"), 2: ("Village", "NEAREST"), 3: ("Village", "FALLBACK"), 4: ("Limassol", "FALLBACK")}


def test_nearest_across_the_date_line(spark):
    centers = spark.createDataFrame([(1, "east", 0.0, 179.99), (2, "pole", 89.9, 0.0)], "center_id int, name string, c_lat double, c_lng double")
    points = spark.createDataFrame([(1, 0.0, -179.99), (2, 89.9, 170.0), (3, 10.0, 0.0)], "point_id int, lat double, lng double")
    assert {r["point_id"]: r["name"] for r in joins.nearest(points, centers, 30.0).collect()} == {1: "east", 2: "pole"}


def wkb(rings, mark="<"):
    body = b"".join(struct.pack(mark + "I", len(r)) + b"".join(struct.pack(mark + "dd", *p) for p in r) for r in rings)
    return (b"\x01" if mark == "<" else b"\x00") + struct.pack(mark + "II", 3, len(rings)) + body


def test_outline(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    hole = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]
    island = [(2.0, 0.0), (2.2, 0.0), (2.1, 0.2), (2.0, 0.0)]
    multi = b"\x01" + struct.pack("<II", 6, 2) + wkb([square, hole]) + wkb([island], ">")
    areas = spark.createDataFrame([("cy", "country", bytearray(multi)), ("CY", "region", bytearray(wkb([square]))), ("GR", "country", bytearray(wkb([island])))], "country string, subtype string, geometry binary")
    rings = sources.outline_rings(areas, "CY")
    assert rings.count() == 3
    points = [(1, 0.1, 0.1), (2, 0.5, 0.5), (3, 1.1, 0.5), (4, 0.5, 1.1), (5, 0.5, 0.0), (6, 0.5, 1.0), (7, 2.1, 0.1), (8, 2.1, 0.25)]
    got = joins.inside_outline(spark.createDataFrame(points, "point_id int, x double, y double"), joins.edges_of(rings)).collect()
    assert {r["point_id"] for r in got} == {1, 5, 7}


NESTED = "id string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, names struct<primary:string>, basic_category string, taxonomy struct<primary:string,hierarchy:array<string>,alternates:array<string>>, confidence double, operating_status string, websites array<string>, phones array<string>, emails array<string>, socials array<string>, brand struct<names:struct<primary:string>>, addresses array<struct<freeform:string,locality:string,postcode:string,region:string,country:string>>, sources array<struct<dataset:string>>"


def test_nested_scan(spark, tmp_path):
    def row(i, lat, name="n", conf=0.9, status=None, country=None, emails=(), websites=()):
        return (i, (33.0, 33.0, lat, lat), (name,), None, (None, [], []), conf, status, list(websites), [], list(emails), [], None, [("f", None, " ", None, country)], [("x",), ("x",), (None,)])

    rows = [row("a", 34.7, emails=[" A@B.cy "]), row("b", 34.7, conf=0.3), row("c", 34.7, status="closed"), row("d", 37.9), row("e", 34.7, country="TR"), row("f", 34.7, name=" "), row("g", 34.7, conf=None, country="cy", websites=["http://facebook.com/x"])]
    spark.createDataFrame(rows, NESTED).write.parquet(str(tmp_path / "a"))
    df = sources.nested_places(spark.read.parquet(str(tmp_path / "a")), sources.Box(34.5, 32.2, 35.7, 34.6), "CY")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    assert "GreaterThanOrEqual(bbox.ymax" in df._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in df.select("*", sources.nested_outcome(0.6, True).alias("why")).collect()}
    assert {i: r["why"] for i, r in got.items()} == {"a": "kept", "b": "low_confidence", "c": "closed", "g": "no_contact"}
    assert got["a"]["emails"] == ["a@b.cy"] and got["a"]["postcode"] is None and got["a"]["datasets"] == ["x"]
    flat = spark.createDataFrame([("1", "n", 34.7, 33.0, "cy", "2024-11-01T00:00", None), ("2", "n", 34.7, 33.0, "CY", "2023-01-01", None), ("3", "n", 34.7, 33.0, "CY", None, None), ("4", "n", 34.7, 33.0, "CY", "2025-01-01", "2025-02-01")], "fsq_place_id string, name string, latitude double, longitude double, country string, date_refreshed string, date_closed string")
    for c in ("website", "tel", "address", "locality", "region", "postcode", "instagram", "twitter", "email", "facebook_id", "date_created"):
        flat = flat.withColumn(c, F.lit(None).cast("string"))
    flat = flat.withColumn("fsq_category_ids", F.array().cast("array<string>")).withColumn("fsq_category_labels", F.array().cast("array<string>"))
    why = {r["id"]: r["why"] for r in sources.flat_places(flat, sources.Box(34.5, 32.2, 35.7, 34.6), "CY").select("id", sources.flat_outcome("2024-10-03").alias("why")).collect()}
    assert why == {"1": "kept", "2": "old", "3": "old", "4": "closed"}


def test_gazetteer_and_tree(spark):
    line = lambda i, name, alt, lat, cls, code, a1, a2, pop: "\t".join([str(i), name, name, alt, lat, "33.0", cls, code, "CY", "", a1, a2, "", "", pop, "", "", "", ""])
    text = ["﻿" + line(1, "Cyprus", "Κύπρος,Zypern", "35.0", "A", "PCLI", "", "", "0"), line(10, "District", "", "34.9", "A", "ADM1", "05", "", "9"), line(20, "Big", "Μεγάλη", "34.7", "P", "PPL", "05", "", "10000"), line(21, "Part", "", "34.7", "P", "PPLX", "05", "", "1"), line(22, "Lost", "", "36.0", "P", "PPL", "99", "", ""), line(23, "No", "", "", "P", "PPL", "05", "", "5"), "short\tline"]
    rows = sources.gazetteer(spark.createDataFrame([(t,) for t in text], "value string"))
    assert rows.count() == 6
    admin = sources.admin_codes(spark.createDataFrame([("CY.05\tDistrict\tDistrict\t10",), ("GR.05\tX\tX\t11",)], "value string"), "CY")
    info = sources.country_info(spark.createDataFrame([("# c",), ("\t".join(["CY", "", "", "", "Cyprus", "", "", "900000", *[""] * 8, "1"]),)], "value string"), "CY")
    tree = {r["geonames_id"]: r for r in places.location_tree(info, admin, None, rows, (1.0, 12.0, 0.02), "Greek").collect()}
    assert set(tree) == {1, 10, 20, 22} and tree[20]["parent_id"] == 10 and tree[22]["parent_id"] == 1 and tree[10]["parent_id"] == 1
    assert tree[20]["name_local"] == "Μεγάλη" and tree[1]["name_local"] == "Κύπρος" and tree[22]["population"] is None
    assert tree[10]["south"] == tree[20]["south"] and tree[1]["north"] == tree[22]["north"] and tree[1]["population"] == 900000


def test_search_plan(spark):
    shape = "country_code string, id long, name string, lat double, lng double, population int, parent_id long, parent_name string, south double, west double, north double, east double"
    box = lambda lat, lng, r: (lat - r, lng - r, lat + r, lng + r)
    rows = [("CY", 1, "Big", 34.7, 33.0, 100000, 9, "D", *box(34.7, 33.0, 0.1)), ("CY", 2, "Near", 34.75, 33.0, 8000, 9, "D", *box(34.75, 33.0, 0.02)), ("CY", 3, "Small", 34.7, 33.05, 10, 9, "D", *box(34.7, 33.05, 0.01)), ("CY", 4, "Far", 35.5, 33.0, 10, 8, "B", *box(35.5, 33.0, 0.01)), ("CY", 5, "Alone", 36.5, 33.0, None, None, None, *box(36.5, 33.0, 0.01))]
    got = {r["key"]: r for r in places.plan_search_areas(spark.createDataFrame(rows, shape)).collect()}
    assert set(got) == {"city:1", "rural:8", "rural:place-5"}
    assert got["city:1"]["covered"] == [1, 2, 3] and got["city:1"]["absorbed"] == [2] and got["rural:place-5"]["name"] == "Unassigned (rural)"


def test_site_emails(spark):
    code = "5a" + "".join(f"{b ^ 0x5A:02x}" for b in b"cf@shop.cy")
    page = f"""<body><a href="mailto:Info%40Shop.cy?subject=x,z">m</a><span data-cfemail="{code}"></span>
      <script type="application/ld+json">{{"a": [{{"Email": "ld@shop.cy"}}]}}</script><p>text@shop.cy</p><p>obf [at] shop [dot] cy</p>
      <img data-email="attr@gmail.com"><script>var a = 'scr' + 'ipt@' + 'agency.com';</script><p>no-reply@shop.cy and a@example.com</p></body>"""
    pages = spark.createDataFrame([("shop.cy", 0, "u0", page), ("shop.cy", 1, "u1", "<p>info@shop.cy second@gmail.com</p>")], "site string, page_order int, url string, html string")
    mx = spark.createDataFrame([("shop.cy", True), ("gmail.com", True)], "domain string, mx_valid boolean")
    got = {r["email"]: r for r in webpages.evaluate_sites(pages, spark.createDataFrame([("gmail.com",)], "domain string"), mx).collect()}
    assert {e: r["source"] for e, r in got.items() if not r["rejected"]} == {"info@shop.cy": "mailto", "cf@shop.cy": "cfemail", "ld@shop.cy": "jsonld", "text@shop.cy": "text", "obf@shop.cy": "obfuscated", "attr@gmail.com": "attribute", "second@gmail.com": "text"}
    assert {e: r["rejected"] for e, r in got.items() if r["rejected"]} == {"script@agency.com": "THIRD_PARTY_IN_CODE", "no-reply@shop.cy": "JUNK_LOCAL", "a@example.com": "PLACEHOLDER"}
    assert [e for e, r in got.items() if r["is_primary"]] == ["cf@shop.cy"]


def test_contact_links(spark):
    html = '<a href="/contact">c</a><a href="https://other.cy/contact">o</a><a href="/x.pdf">Contact</a><a href="https://www.shop.cy/p?q#f">Impressum</a><a href="#a">about</a><a href="/contact#x">again</a><a href="mailto:a@b.cy">contact</a>'
    got = sorted((r["pos"], r["url"], r["kind"]) for r in webpages.contact_links(spark.createDataFrame([(1, "https://shop.cy/", html)], "page_id long, url string, html string")).collect())
    assert [x[1:] for x in got] == [("https://shop.cy/contact", "CONTACT"), ("https://www.shop.cy/p?q", "LEGAL")]


def test_suppression_import(spark):
    shape = "email_hash string, email_normalized string, domain string, reason string, source_file string"
    old = spark.createDataFrame([("1", "a", "x", "MANUAL", "f"), ("2", "b", "x", "ERASED", "f"), ("3", "c", "x", "UNSUBSCRIBED", "f"), (None, None, "d.cy", "MANUAL", "f")], shape)
    new = spark.createDataFrame([(k, "n", "x", "BOUNCED", "g") for k in ("1", "2", "3", "4")], shape)
    got = {(r["email_hash"], r["domain"]): (r["reason"], r["change"]) for r in state.import_suppression(old, new).collect()}
    assert got == {("1", "x"): ("BOUNCED", "upgraded"), ("2", "x"): ("ERASED", "kept"), ("3", "x"): ("UNSUBSCRIBED", "kept"), ("4", "x"): ("BOUNCED", "inserted"), (None, "d.cy"): ("MANUAL", "kept")}


def test_primary_repair(spark):
    shape = "id long, place_id long, email string, is_primary boolean, is_own_domain boolean, email_type string, mx_valid boolean, is_disposable boolean, exported boolean"
    rows = [(1, 1, "dpo@a.cy", True, True, "PERSONAL", True, False, False), (2, 1, "info@a.cy", False, False, "GENERIC", True, False, False), (3, 1, "x@a.cy", False, True, "PERSONAL", True, False, False), (4, 2, "y@b.cy", True, True, "PERSONAL", False, False, False), (5, 2, "z@c.cy", False, False, "PERSONAL", True, False, False), (6, 3, "ok@d.cy", True, True, "PERSONAL", True, False, False)]
    got = {r["id"] for r in state.repair_primaries(spark.createDataFrame(rows, shape)).where("is_primary").collect()}
    assert got == {3, 4, 6}


def test_csv_files(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("﻿ Email ;Name\r\nA@b.cy;x\r\n;y\r\nc@d.cy\r\n", encoding="utf-8")
    assert [r["value"] for r in sources.email_column(spark, str(path), "EMAIL").collect()] == ["A@b.cy", "", "c@d.cy"]
    with pytest.raises(ValueError, match="not found"):
        sources.email_column(spark, str(path), "mail")
    rows = sources.mailer_rows(spark.createDataFrame([("A@b.cy", " Opted - out ", "2024-01-02"), ("bad", "x", None), ("c@d.cy", None, "?")], "email string, status string, date string")).collect()
    assert [(r["email"], r["status"], r["valid"]) for r in rows] == [("a@b.cy", "opted_out", True), (None, "x", False), ("c@d.cy", "", False)]
    sinks.write_csv(spark.createDataFrame([("=x", 1), ('a"b', None)], "name string, n int"), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    assert file.read_bytes().decode() == '﻿name,n\r\n\'=x,1\r\n"a""b",\r\n'


def test_snapshot_of_a_country(spark, tmp_path):
    path = str(tmp_path / "places")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, country_code string")
    sinks.replace_country(rows((1, "CY"), (2, "GR")), path)
    sinks.replace_country(rows((3, "CY")), path)
    assert sorted((r["id"], r["country_code"]) for r in spark.read.parquet(path).collect()) == [(2, "GR"), (3, "CY")]


def test_page_records(spark):
    shape = "id long, country_code string, city_name string, primary_email string, sells_online boolean, google_place_id string, a struct<id:string,name:string,address:string,postcode:string,locality:string,phones:array<string>,websites:array<string>,socials:array<string>,emails:array<string>,taxonomy_primary:string,lat:double,lng:double>, b struct<id:string,tel:string,website:string,instagram:string,facebook_id:bigint>"
    a = ("o1", " Anna ", "Street 1", None, None, ["bad", "99 123456"], ["https://www.fresha.com/x", "https://anna.cy"], ["https://facebook.com/anna"], ["X@anna.cy"], "spa", 34.7, 33.0)
    rows = [(1, "CY", "Limassol", None, True, "g1", a, ("f1", None, None, "@anna", 5)), (2, "CY", None, "p@x.cy", None, None, ("o2", "B", None, None, "Paphos", [], [], [], [], None, 1.0, 2.0), None), (3, "CY", None, None, None, None, ("o3", "  ", None, None, None, [], [], [], [], None, 1.0, 2.0), None)]
    got = {r["id"]: r for r in places.page_records(spark.createDataFrame(rows, shape)).collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert (r["name"], r["phone"], r["website"], r["booking_platform"], r["email"], r["city"]) == ("Anna", "+35799123456", "https://anna.cy/", "fresha.com", "x@anna.cy", "Limassol")
    assert r["socials"] == {"facebook": "https://facebook.com/anna", "instagram": "https://instagram.com/anna"} and r["uses_second_source"] and r["sells_online"]
    assert r["completeness"] == 67 and r["missing"] == ["opening hours", "photos", "services and prices"]
    assert got[2]["completeness"] == 33 and got[2]["city"] == "Paphos" and not got[2]["uses_second_source"]


def test_worker_and_releases(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:02:00"))
    df = spark.createDataFrame([("2024-01-01 00:00:30",), ("2024-01-01 00:00:10",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r[0] for r in df.select(reports.worker_state(F.col("t"), now)).collect()] == ["running", "stopped", "unknown"]
    rel = spark.createDataFrame([("2026-09-17.9",), ("2026-09-17.10",), ("2026-08-20.0",)], "release string")
    assert sources.latest_release(rel).first()[0] == "2026-09-17.10"


def test_micro_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "CY"), (2, "GR"), (3, None)], "id int, country_code string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    query = refresh.touched_countries(spark, str(tmp_path / "in"), rows.schema, lambda batch, countries: seen.append((batch.count(), countries)), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert seen == [(3, ["CY", "GR"])]


def test_staged_rows_are_merged(spark):
    from terrane.operators import datasets

    shape = "id int, overture_id string, google_place_id string, name string, name_normalized string, address string, lat double, lng double, city_id int, city_name string, website string, website_domain string, phone_raw string, phone_e164 string, phone_valid boolean"
    old = spark.createDataFrame([(1, "o1", "g1", "Kept", "kept", None, None, None, None, None, None, None, "22", None, False), (2, "o2", None, "Old", "old", "a", 1.0, 1.0, None, None, "http://x.cy/", "x.cy", None, None, False), (5, None, "g5", "Alone", "alone", None, None, None, None, None, None, None, None, None, False)], shape)
    emails = spark.createDataFrame([("known@x.cy", 1, "PERSONAL", True)], "email string, place_id int, email_type string, is_own_domain boolean")
    row = lambda i, name, mails, path=("spa",): (i, name, "anna.cy", "99 123456", "CY", 34.7, 33.0, "street", list(mails), list(path), None, None)
    staged = spark.createDataFrame([row("o1", "New One", ["Known@x.cy", "a@anna.cy"]), row("o2", "New Two Ltd", ["a@anna.cy", "bad@blocked.cy"]), row("o9", "Nine", ["nine@gmail.com"]), row("o8", "Eight", []), row("o7", "Junk", ["j@j.cy"], ("junk",))], "id string, name string, website string, phone string, country_code string, lat double, lng double, address string, emails array<string>, taxonomy_hierarchy array<string>, basic_category string, taxonomy_primary string")
    rules = spark.createDataFrame([("spa", 1, None), ("junk", None, "no")], "match string, subcategory_id int, excluded_reason string")
    sup = spark.createDataFrame([(None, "blocked.cy")], "email_hash string, domain string")
    merged = datasets.merge_staged(old, emails, staged, rules, sup)
    got = {r["id"]: r for r in merged.places.collect()}
    assert set(got) == {1, 2, 5, 6, 7} and got[6]["overture_id"] == "o8" and got[7]["overture_id"] == "o9" and got[7]["__inserted"]
    assert got[1]["name"] == "Kept" and got[1]["address"] == "street" and got[1]["website_domain"] == "anna.cy" and got[1]["phone_e164"] is None and got[1]["lat"] == 34.7
    assert got[2]["name_normalized"] == "new two" and got[2]["website_domain"] == "x.cy" and got[2]["phone_e164"] == "+35799123456" and got[2]["lat"] == 1.0
    assert sorted((r["email"], r["place_id"]) for r in merged.emails.collect()) == [("a@anna.cy", 1), ("known@x.cy", 1), ("nine@gmail.com", 7)]
    again = datasets.merge_staged(merged.places.drop("__inserted"), merged.emails, staged, rules, sup)
    strip = lambda df: sorted(map(str, df.drop("__inserted").collect()))
    assert strip(again.places) == strip(merged.places) and strip(again.emails) == strip(merged.emails)


def test_site_emails_titles_and_cut_addresses(spark):
    page = "<head><title>Visit a.b@mail7.example.com</title><style>p{}</style></head><body>for all <h1>Write a.b@mail7.example.</h1><p>real@shop.cy.</p></body>"
    pages = spark.createDataFrame([("x.cy", 0, "u", page + "<p>a.b@mail7.example.com</p>"), ("y.cy", 0, "u", "<title>only@shop.cy</title><body></body>")], "site string, page_order int, url string, html string")
    got = {(r["site"], r["email"]) for r in webpages.emails_of_pages(pages).collect()}
    assert got == {("x.cy", "a.b@mail7.example.com"), ("x.cy", "real@shop.cy"), ("y.cy", "only@shop.cy")}


def test_crowded_boxes(spark, monkeypatch):
    rng = random.Random(4)
    spot = lambda: (round(rng.random() * 0.03, 4), round(rng.random() * 0.03, 4))
    points = [(k, *spot()) for k in range(300)]
    boxes = [(k, "b", rng.choice([None, 1, 5]), y - h, x - h, y + h, x + h) for k, (y, x), h in ((k, spot(), rng.choice([0.001, 0.008])) for k in range(400))]
    boxes += [(k + 1000, *b[1:]) for k, b in enumerate(boxes[:100])]
    shape = "box_id long, name string, population int, south double, west double, north double, east double"
    placed = spark.createDataFrame(points, "point_id long, lat double, lng double")
    want = {}
    for k, y, x in points:
        if inside := [b for b in boxes if b[3] <= y <= b[5] and b[4] <= x <= b[6]]:
            want[k] = max(inside, key=lambda b: (b[2] or 0, -b[0]))[0]
    met = []
    kept = joins._best_on_cells
    monkeypatch.setattr(joins, "_best_on_cells", lambda b, size: met.append(kept(b, size)) or met[-1])
    assert {r["point_id"]: r["box_id"] for r in joins.largest_box(placed, spark.createDataFrame(boxes, shape), 0.005).collect()} == want
    assert met[-1].groupBy("cy", "cx").count().agg({"count": "max"}).first()[0] < 40  # of 500 boxes


def test_crowded_centers(spark, monkeypatch):
    rng = random.Random(4)
    spot = lambda: (round(rng.random() * 0.03, 4), round(rng.random() * 0.03, 4))
    points = [(k, *spot()) for k in range(300)]
    centers = [(k, "c", *spot()) for k in range(300)] + [(900, "c", 0.5, 0.5)]
    centers += [(k + 1000, *c[1:]) for k, c in enumerate(centers[:100])]
    points += [(500, 0.503, 0.5), (501, 0.9, 0.9)]
    placed = spark.createDataFrame(points, "point_id long, lat double, lng double")
    reach = []
    within = joins._nearest_within
    monkeypatch.setattr(joins, "_nearest_within", lambda p, c, km, m: reach.append((km, p.count())) or within(p, c, km, m))
    got = {r["point_id"]: r["center_id"] for r in joins.nearest(placed, spark.createDataFrame(centers, "center_id long, name string, c_lat double, c_lng double"), 0.5).collect()}
    km = lambda p, c: 6371 * math.hypot(math.radians(p[1] - c[2]), math.radians(p[2] - c[3]) * math.cos(math.radians(p[1])))
    want = {p[0]: min((round(km(p, c), 9), c[0]) for c in centers) for p in points}
    assert set(got) == {k for k, (d, _) in want.items() if d <= 0.5} and all(abs(km(p, next(c for c in centers if c[0] == got[p[0]])) - want[p[0]][0]) < 1e-6 and got[p[0]] < 1000 for p in points if p[0] in got)
    assert len(reach) > 1 and reach[-1][1] < 300  # most points are done before the whole distance


def test_pairs_of_crowded_cells(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, rng.choice(["golden lion", "golden lions", "x", "other"]), 35 + rng.random() * 0.004, 33 + rng.random() * 0.004) for k in range(300)]
    places = spark.createDataFrame(rows, "id long, name_c string, lat double, lng double")
    want = {tuple(r) for r in dedupe.name_pairs(places, dedupe.DedupeRules(), exact=True).select("id_a", "id_b", F.round("metres", 6)).collect()}
    monkeypatch.setattr(dedupe, "CELL_PLACES", 7)
    dealt = dedupe.name_pairs(places, dedupe.DedupeRules(), exact=True)
    assert {tuple(r) for r in dealt.select("id_a", "id_b", F.round("metres", 6)).collect()} == want
    names = {r[0]: r[1] for r in rows}
    assert {(names[a], names[b]) for a, b, _ in want} >= {("x", "x"), ("golden lion", "golden lions")} and all(names[a][:2] == names[b][:2] and m <= 200 for a, b, m in want)


def test_addresses_of_one_file_are_dealt_out_and_read_once(spark):
    from terrane.functions import fixed
    from terrane.operators import datasets

    lists = [(1, "b.cy", [" A@B.cy", None, "a@b.cy?x", "noreply@b.cy", "x"]), (1, "b.cy", ["z@b.cy", "a@b.cy"]), (2, None, []), (3, None, None), (None, None, ["a@gmail.com"])]
    rows = spark.createDataFrame(lists, "id long, website_domain string, emails array<string>").coalesce(1)
    done = datasets.prepare_emails(rows)
    got = sorted((r["id"] or 0, r["email"], r["original"], r["is_own_domain"], r["pos"]) for r in done.collect())
    assert got == [(0, "a@gmail.com", "a@gmail.com", False, 0), (1, "a@b.cy", "A@B.cy", True, 0), (1, "z@b.cy", "z@b.cy", True, 0)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(fixed.EMAIL_PATTERN) == 1 and "Repartition" in plan


def test_site_emails_headlines_cut_within_an_address(spark):
    cut = '<meta name="description" content="Write to eva.2@shop.c"><meta name="description" content="Ask us: eva.2@shop.co"><h1>All <b>for</b> you: pec.39@mail0.exampl</h1><p>All for\nyou: pec.39@mail0.example.com &amp; more</p><h2>Of dlo.41@mail4.example.co...</h2>'
    cut += "<div>Of dlo.41@mail4.example.com. Ask us: eva.2@shop.com.</div>"
    whole = "<h1>a@shop.com</h1><h2>Write b@shop.com</h2><h3>Or c@shop.com.</h3><h4>Of d@shop.com</h4><p>a@shop.com.cy Write b@shop.com. Or c@shop.com, now of e@shop.com and d@shop.com.cy</p>"
    pages = spark.createDataFrame([("x.cy", 0, "u", cut), ("y.cy", 0, "u", whole)], "site string, page_order int, url string, html string")
    got = sorted((r["site"], r["email"]) for r in webpages.emails_of_pages(pages).collect())
    left = [("x.cy", x) for x in ("dlo.41@mail4.example.com", "eva.2@shop.com", "pec.39@mail0.example.com")]
    assert got == left + [("y.cy", x) for x in ("a@shop.com", "a@shop.com.cy", "b@shop.com", "c@shop.com", "d@shop.com", "d@shop.com.cy", "e@shop.com")]


def test_site_emails_end_with_their_block(spark):
    page = "<article>Ask x@shop.com</article><section>now<p>y@shop.com<p>or</section><footer>z@shop.com.</footer><a href='/m'>mail</a>"
    pages = spark.createDataFrame([("x.cy", 0, "u", page)], "site string, page_order int, url string, html string")
    assert sorted(r["email"] for r in webpages.emails_of_pages(pages).collect()) == ["x@shop.com", "y@shop.com", "z@shop.com"]


def test_pairs_are_those_of_all_places_compared(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(280) if rng.random() < 0.98 else None, rng.choice(["bar", "pub"]), lat + rng.random() * 0.006, lng + rng.random() * wide) for lat, lng, wide in ((35.0, 33.0, 0.006), (-0.003, -0.003, 0.006), (84.0, 10.0, 0.02)) for _ in range(100)]
    places = spark.createDataFrame(rows, "id long, name_c string, lat double, lng double")

    def metres(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    cells = lambda r: (math.floor(r[2] / 0.002), math.floor(r[3] / 0.002))
    beside = lambda a, b: all(abs(x - y) <= 1 for x, y in zip(cells(a), cells(b), strict=True))
    known = [r for r in rows if r[0] is not None]
    want = sorted((a[0], b[0], round(metres(a, b), 6)) for a in known for b in known if a[0] < b[0] and a[1] == b[1] and beside(a, b) and metres(a, b) <= 200)
    got = sorted((r[0], r[1], round(r[2], 6)) for r in dedupe.name_pairs(places, dedupe.DedupeRules()).collect())
    assert len(want) > 500 and got == want


def test_shuffle_of_pairs_grows_with_the_places(spark, monkeypatch):
    rng = random.Random(9)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(k, "bar", 35 + rng.random() * 0.0019, 33 + rng.random() * 0.0019) for k in range(100 * n)]
    places = spark.createDataFrame(rows, "id long, name_c string, lat double, lng double")
    monkeypatch.setattr(dedupe, "CELL_PLACES", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    context = spark.sparkContext._jsc.sc()
    stages = lambda: context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    context.listenerBus().waitUntilEmpty()
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    try:
        assert dedupe.name_pairs(places, dedupe.DedupeRules()).count() > 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    context.listenerBus().waitUntilEmpty()
    found = stages()
    written = sum(found.apply(k).shuffleWriteRecords() for k in range(found.size()) if found.apply(k).stageId() not in before)
    # Each place may go to each of the four shares of a partition, but not to a share for every few places.
    assert len(rows) < written < 4 * n * len(rows)
