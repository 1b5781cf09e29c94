"""Scalar functions on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrane.functions import email, geo, phones, text, urls
from terrane.sources import sinks


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {', '.join(f'c{k} {kind}' for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1))}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    globals()["C"] = F.col("c0")


def test_names(spark):
    cases = {"Anna Beauty Ltd.": "anna beauty", "ANNA BEAUTY": "anna beauty", "Café  Ñandú S.A.": "cafe nandu", "Ltd": "ltd", "Co Ltd": "co", "Nails & Spa": "nails & spa", "Ωραία ΕΠΕ": "ωραια", "O’Brien's": "obriens", "": ""}
    assert values(spark, text.matching_name(C), list(cases)) == list(cases.values())
    assert values(spark, text.comparable_name(C), ["anna beauty limassol", "the spa & co", "cyprus"]) == ["anna beauty", "spa co", ""]
    assert values(spark, text.fold(C), [" ÉTÉ ", "Ώμος", "ñ̃"]) == ["ete", "ωμος", "n"]


def test_similarity(spark):
    pairs = [("night", "nacht"), ("a b", "ab"), ("", "x"), ("same", "same"), ("aaaa", "aa"), ("a", "b")]
    got = values(spark, text.dice(C, F.col("c1")), pairs)
    assert got == pytest.approx([0.25, 1.0, 0.0, 1.0, 0.5, 0.0])
    words = [("makeup christina tsangara", "ctsangara makeup"), ("glamour lashes", "sei bella nails"), ("anna hair", "anna nails"), ("ann x", "joann y")]
    assert values(spark, text.share_distinctive_word(C, F.col("c1")), words) == [True, False, True, False]


def test_cities_and_keywords(spark):
    assert values(spark, text.is_real_city(C, F.lit("CY")), ["Limassol", "cy", " Κύπρος ", "unknown", "N/A", "", None]) == [True, False, False, False, False, False, False]
    hits = text.keyword_hits(C, F.array(F.lit("nail salon"), F.lit("manicures"), F.lit("nails")))
    assert values(spark, hits, ["mo nails", "manicure and nail", "hair studio"]) == [1, 2, 0]


EMAILS = {
    " Info@Shop.CY. ": "info@shop.cy", "mailto:a@b.com?subject=Hi": "a@b.com", "<x@y.gr>": "x@y.gr", "(a.b+c@sub.d-e.co)": "a.b+c@sub.d-e.co", "no": None, "a@b": None, "@b.com": None, "a" * 65 + "@b.com": None,
    "x@-b.com": None, "a@xn--p1ai.xn--p1ai": "a@xn--p1ai.xn--p1ai", "": None,
}


def test_emails(spark):
    assert values(spark, email.normalize_email(C), list(EMAILS)) == list(EMAILS.values())
    found = values(spark, email.extract_emails(C), ["Write A@b.com, a@B.com or //site.cy/img/logo@2x.png and c@d.org.", "none"])
    assert found == [["a@b.com", "logo@2x.png", "c@d.org"], []]
    kinds = ["info@x.cy", "sales2@x.cy", "info.city@x.cy", "informal@x.cy", "info+tag@x.cy", "anna@x.cy"]
    assert values(spark, email.email_type(C), kinds) == ["GENERIC", "GENERIC", "GENERIC", "PERSONAL", "GENERIC", "PERSONAL"]
    roles = ["dpo@x.cy", "privacy-team@x.cy", "legally@x.cy", "opt-out+1@x.cy"]
    assert values(spark, email.is_role_mailbox(C), roles) == [True, True, False, True]
    assert values(spark, email.is_role_address(C), roles) == [True, True, False, True]


def test_reject_reasons(spark):
    cases = {
        "logo@2x.png": "FILE_NAME", "a@example.com": "PLACEHOLDER", "k@o1.ingest.sentry.io": "TECH_DOMAIN", "info@instagram.com": "PLATFORM_DOMAIN", "noreply@shop.cy": "JUNK_LOCAL",
        "0123456789abcdef0@shop.cy": "HASH_LOCAL", "anna@shop.cy": None, "no-reply@example.com": "PLACEHOLDER",
    }
    assert values(spark, email.reject_reason(C), list(cases)) == list(cases.values())


def test_own_domain_and_mx(spark):
    pairs = [("shop.cy", "www.shop.cy"), ("mail.shop.cy", "shop.cy"), ("shop.cy", "a.shop.cy"), ("notshop.cy", "shop.cy"), ("shop.cy", None)]
    assert values(spark, email.is_own_domain(C, F.col("c1")), pairs) == [True, True, True, False, False]
    states = [(True, None), (False, True), (None, True), (False, None), (None, None), (False, False)]
    assert values(spark, email.mx_state(C, F.col("c1")), states, "boolean") == [True, True, True, False, None, False]


def test_hidden_addresses(spark):
    hidden = {
        "info [at] shop [dot] cy": "info@shop.cy", "info(at)shop(dot)cy": "info@shop.cy", "info {at} shop . cy": "info@shop . cy", "info AT shop DOT cy": "info@shop.cy",
        "write info at shop dot co dot cy now": "write info@shop.co.cy now", "meet us at the shop": "meet us at the shop", "x@y dot z": "x@y dot z",
    }
    assert values(spark, email.deobfuscate(C), list(hidden)) == list(hidden.values())
    assert values(spark, email.decode_escapes(C), [r"a@b\x2ecy", "a&#64;b&period;cy", "a＠b．cy", "a%40b"]) == ["a@b.cy", "a@b.cy", "a@b.cy", "a@b"]
    code = lambda s, k=0x5A: f"{k:02x}" + "".join(f"{b ^ k:02x}" for b in s.encode())
    assert values(spark, email.decode_cfemail(C), [code("a@b.cy"), code("é@b.cy"), "abc", "zz11", "5a"]) == ["a@b.cy", "é@b.cy", None, None, None]
    assert values(spark, email.join_script_strings(C), ["'info' + '@' + \"shop.cy\""]) == ["'info@shop.cy\""]


URLS = {
    "https://www.Shop.cy/about?utm_source=x&id=1&fbclid=2#top": "https://www.shop.cy/about?id=1", "shop.cy": "http://shop.cy/", "//shop.cy/a": "https://shop.cy/a", "taplink.cc/shop.": "http://taplink.cc/shop", "ftp://x.cy": None, "mailto:a@b.cy": None,
    "http://user:pw@shop.cy:80/x": "http://shop.cy/x", "https://shop.cy:8443/": "https://shop.cy:8443/", "http://localhost/": None, "a b.cy": None, "": None, None: None, "http://shop.cy./": "http://shop.cy/", "http://a..b/": None,
}


def test_urls(spark):
    assert values(spark, urls.clean_url(C), list(URLS)) == list(URLS.values())
    own = {"https://www.shop.cy/": "shop.cy", "https://m.facebook.com/x": None, "https://n8.alteg.io/": None, "https://www.tripadvisor.co.uk/": None, "https://mybooking.com/": "mybooking.com"}
    assert values(spark, urls.own_domain(C), list(own)) == list(own.values())
    assert values(spark, urls.platform_domain(C), ["gold.setmore.com", "x.cy"]) == ["setmore.com", None]
    assert values(spark, urls.link_kind(C, F.col("c1")), [("Επικοινωνία", "/x"), ("", "/About-us"), ("AGB", "/impressum"), ("GDPR", "/contact"), ("home", "/")]) == ["CONTACT", "ABOUT", "LEGAL", "CONTACT", None]
    assert values(spark, urls.sitemap_locations(C), ["<loc> https://a.cy/x?a=1&amp;b=2 </loc><loc>b</loc>"]) == [["https://a.cy/x?a=1&b=2", "b"]]
    assert values(spark, urls.charset(C, F.col("c1")), [("text/html; charset=ISO-8859-7", ""), (None, '<meta charset="Windows-1253">'), ("text/html", None)]) == ["iso-8859-7", "windows-1253", "utf-8"]
    assert values(spark, urls.maps_url(C, F.col("c1")), [("id/1", "A & B")]) == ["https://www.google.com/maps/search/?api=1&query=A%20%26%20B&query_place_id=id%2F1"]


def test_shop_signals(spark):
    pages = ['<script src="https://cdn.shopify.com/x.js">', '<a href="/basket">', '<a href="/basketball">', "> Add to Cart <", "<a href='https://www.etsy.com/gr/shop/x'>", "plain", ">προσθήκη στο ΚΑΛΆΘΙ<"]
    assert values(spark, urls.shop_signals(C), pages) == [["shopify"], ["cart"], [], ["cart"], ["etsy"], [], ["cart"]]
    assert values(spark, urls.looks_javascript_rendered(C), ['<body><div id="root"></div><script>long</script></body>', f'<div id="root">{"text " * 60}</div>', "<p>x</p>"]) == [True, False, False]


def test_phones(spark):
    cases = [("99 123456", "CY"), ("+357 22-123456", "GR"), ("0035725123456", "CY"), ("12345", "CY"), ("(0)20 7946 0958", "GB"), ("020 7946 0958", "GB"), ("+30 210 1234567", "CY"), ("6912345678", "GR"), ("call us", "CY"), ("99123456 ext. 5", "cy"), (None, "CY")]
    assert values(spark, phones.e164(C, F.col("c1")), cases) == ["+35799123456", "+35722123456", "+35725123456", None, "+442079460958", "+442079460958", "+302101234567", "+306912345678", None, "+35799123456", None]


def test_geo(spark):
    d = spark.createDataFrame([(34.7, 33.0, 34.7, 33.0021), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    near, far = [r["km"] for r in d.select(geo.distance_km(*map(F.col, "abcd")).alias("km")).collect()]
    assert near == pytest.approx(0.192, abs=1e-3) and far == pytest.approx(20015.087, abs=1e-3)
    assert geo.refreshed_cutoff(24, "2026-10-03") == "2024-10-03" and geo.refreshed_cutoff(6, "2026-10-03") == "2026-04-03" and geo.refreshed_cutoff(1, "2023-03-31") == "2023-03-03"
    r = spark.range(1).select(geo.quadrants(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(4.0)).alias("q"), geo.round_half_up(F.lit(-2.5)).alias("r"), geo.local_name(F.array(F.lit("Nicosia"), F.lit("Λευκωσία")), "Greek").alias("n"), geo.quota_bounds(F.lit(1000), 0.9, 0.75).alias("b")).first()
    assert [tuple(x) for x in r["q"]] == [(0, 0, 1, 2), (0, 2, 1, 4), (1, 0, 2, 2), (1, 2, 2, 4)]
    assert r["r"] == -2.0 and r["n"] == "Λευκωσία" and tuple(r["b"]) == (900, 750)


def test_csv(spark):
    cells = {"=1+1": "'=1+1", "+35799123456": "+35799123456", "+1": "'+1", "-x": "'-x", "@a": "'@a", 'say "hi", you': '"say ""hi"", you"', "a\nb": '"a\nb"', None: "", "plain": "plain"}
    assert values(spark, sinks.csv_cell(C), list(cases := list(cells))) == [cells[c] for c in cases]
