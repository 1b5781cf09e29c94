"""Queries on whole pipelines: leads, the merge of staged rows, page records, repair of primary addresses, search areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import datasets, leads, places, state
from terrane.plans.registry import Registry
from terrane.session import table

query = Registry()

_SCORE = leads.ScoreRules()


@query(f"""WITH c AS (SELECT c_custkey AS id, c_custkey // 3 AS g, c_acctbal < 0 AS far, c_mktsegment AS seg, c_acctbal AS bal, c_mktsegment <> 'BUILDING' AS fresh,
   EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has FROM customer),
s AS (SELECT *, first_value(id) OVER (PARTITION BY g, far ORDER BY fresh, NOT has, id) AS survivor FROM c),
e AS (SELECT survivor, 'e' || id || '@g' || g || '.cy' AS email, CASE WHEN bal < 1000 THEN false WHEN bal <= 8000 THEN true END AS mx, row_number() OVER (PARTITION BY survivor ORDER BY id <> survivor,
   CASE WHEN bal < 1000 THEN 1000 WHEN bal <= 8000 THEN -1 ELSE 0 END, 'e' || id || '@g' || g || '.cy') AS r FROM s WHERE has),
p AS (SELECT s.survivor AS id, count(*) AS n, bool_or(bal > 5000) AS phone, any_value(seg) FILTER (s.id = survivor) AS seg FROM s GROUP BY 1)
SELECT p.id, email, CASE WHEN seg = 'MACHINERY' THEN 'BLOCKLIST' END AS chain_reason,
   CASE WHEN email IS NULL THEN '' ELSE concat_ws(',', CASE WHEN mx = false THEN 'EMAIL_NO_MX' END, CASE WHEN mx IS NULL THEN 'EMAIL_MX_UNKNOWN' END, CASE WHEN seg = 'FURNITURE' THEN 'NO_CATEGORY' END, CASE WHEN NOT phone THEN 'PHONE_INVALID' END) END AS reasons,
   CASE WHEN email IS NULL THEN 0 ELSE {_SCORE.own_domain_email} END + {_SCORE.has_website} + CASE WHEN phone THEN {_SCORE.valid_phone} ELSE 0 END + {_SCORE.open} + CASE WHEN seg = 'MACHINERY' THEN {_SCORE.chain} ELSE 0 END AS score
FROM p LEFT JOIN (SELECT * FROM e WHERE r = 1) e ON e.survivor = p.id""")
def lead_pipeline(spark, d):
    """Duplicates merged, primary addresses, chains, review reasons and scores of all customers as places."""
    k, g = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3)
    null = lambda kind: F.lit(None).cast(kind)
    c = table(spark, d, "customer")
    site = F.concat(F.lit("g"), g.cast("string"), F.lit(".cy"))
    phone = F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("+3579"), F.lpad(k.cast("string"), 9, "0")))
    name = F.concat(F.lower("c_mktsegment"), F.lit(" "), F.translate(k.cast("string"), "0123456789", "qwrtzpsdfg"))
    rows = c.select(
        k.alias("id"), name.alias("name"), name.alias("name_normalized"), F.when(F.col("c_mktsegment") == "BUILDING", "CONTACTED").otherwise("NEW").alias("status"), F.lit("CY").alias("country_code"), F.lit("Limassol").alias("city_name"), null("string").alias("address"),
        (g % 8000 * 0.01 + 1 + F.when(F.col("c_acctbal") < 0, 0.005).otherwise(0.0)).alias("lat"), (F.floor(g / 8000) * 0.01 + 20).alias("lng"), F.concat(F.lit("http://"), site, F.lit("/")).alias("website"), site.alias("website_domain"),
        phone.alias("phone_raw"), phone.alias("phone_e164"), phone.isNotNull().alias("phone_valid"), F.lit("OPERATIONAL").alias("business_status"), null("double").alias("rating"), null("int").alias("rating_count"), (F.col("c_mktsegment") != "FURNITURE").alias("has_category"),
        null("boolean").alias("sells_online"), *[null("timestamp").alias(t) for t in ("first_seen_at", "last_seen_at", "last_crawled_at")],
    )
    rich = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey").distinct()
    mx = F.when(F.col("c_acctbal") < 1000, F.lit(False)).when(F.col("c_acctbal") <= 8000, F.lit(True))
    emails = c.join(rich, k == F.col("o_custkey"), "left_semi").select(k.alias("place_id"), F.concat(F.lit("e"), k.cast("string"), F.lit("@"), site).alias("email"), F.lit(True).alias("is_primary"), F.lit(True).alias("is_own_domain"), F.lit("PERSONAL").alias("email_type"), mx.alias("mx_valid"))
    block = spark.createDataFrame([("machinery", None)], "name_normalized string, domain string")
    found = leads.run_lead_pipeline(rows, emails, block)
    return found.places.select("id", "email", "chain_reason", F.array_join("review_reasons", ",").alias("reasons"), F.col("score").cast("long").alias("score"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey AS p, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS prime, o_orderstatus = 'F' AS own, o_orderstatus = 'O' AS generic, o_orderpriority = '1-URGENT' AS role,
   CASE WHEN o_totalprice < 100000 THEN false WHEN o_totalprice >= 200000 THEN true END AS mx, month(o_orderdate) AS m FROM orders),
b AS (SELECT p, id FROM e WHERE prime AND (mx = false OR role)),
a AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY NOT own, generic DESC, id) AS r FROM e WHERE NOT prime AND mx AND NOT role AND m > 2 AND (own OR generic)),
w AS (SELECT b.id AS old, a.id AS new FROM b JOIN a ON a.p = b.p AND r = 1)
SELECT e.id, (prime AND e.id NOT IN (SELECT old FROM w)) OR e.id IN (SELECT new FROM w) AS is_primary FROM e""")
def primary_repair(spark, d):
    """Primaries without a mail server or of a role give way to the best other address of their place."""
    o = table(spark, d, "orders")
    first = o.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("first"))
    mail = F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("dpo")).otherwise(F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))), F.lit("@d.cy"))
    mx = F.when(F.col("o_totalprice") < 100000, F.lit(False)).when(F.col("o_totalprice") >= 200000, F.lit(True))
    emails = o.join(first, F.col("o_custkey") == F.col("c")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("place_id"), mail.alias("email"), (F.col("o_orderkey") == F.col("first")).alias("is_primary"), (F.col("o_orderstatus") == "F").alias("is_own_domain"),
        F.when(F.col("o_orderstatus") == "O", "GENERIC").otherwise("PERSONAL").alias("email_type"), mx.alias("mx_valid"), (F.month("o_orderdate") == 1).alias("is_disposable"), (F.month("o_orderdate") == 2).alias("exported"),
    )
    return state.repair_primaries(emails).select("id", "is_primary")


@query("""WITH n AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS nat FROM customer),
o AS (SELECT k AS id, 'o' || k AS oid, CASE WHEN nat < 10 THEN 'g' || k END AS gid, 'Old ' || k AS name, CASE WHEN nat % 2 = 0 THEN 'old street' END AS address, CASE WHEN bal > 5000 THEN 'http://old.cy/' END AS site, CASE WHEN bal > 5000 THEN 'old.cy' END AS dom FROM n WHERE bal > 0),
s AS (SELECT 'o' || k AS oid, name, nat FROM n WHERE seg NOT IN ('BUILDING', 'MACHINERY')),
f AS (SELECT s.oid, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY s.oid) AS id FROM s WHERE oid NOT IN (SELECT oid FROM o))
SELECT coalesce(o.id, f.id) AS id, coalesce(o.oid, s.oid) AS overture_id, CASE WHEN s.oid IS NULL OR o.gid IS NOT NULL THEN o.name ELSE s.name END AS name,
   CASE WHEN s.oid IS NULL THEN o.address WHEN o.gid IS NULL THEN 'new ' || s.nat ELSE coalesce(o.address, 'new ' || s.nat) END AS address,
   coalesce(o.site, CASE WHEN s.oid IS NOT NULL THEN 'http://shop.cy/' END) AS website, CASE WHEN o.site IS NULL AND s.oid IS NOT NULL THEN 'shop.cy' ELSE o.dom END AS website_domain, o.oid IS NULL AS inserted
FROM o FULL JOIN s ON s.oid = o.oid LEFT JOIN f ON f.oid = s.oid""")
def staging_merge(spark, d):
    """Staged rows of mapped categories merged into places; the first source keeps its name, new rows get new ids."""
    return _merge(spark, d).places.select("id", "overture_id", "name", "address", "website", "website_domain", F.col("__inserted").alias("inserted"))


def _merge(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    null = lambda kind: F.lit(None).cast(kind)
    oid, rich, nation = F.concat(F.lit("o"), k.cast("string")), F.col("c_acctbal") > 5000, F.col("c_nationkey")
    old = c.where("c_acctbal > 0").select(
        k.alias("id"), oid.alias("overture_id"), F.when(nation < 10, F.concat(F.lit("g"), k.cast("string"))).alias("google_place_id"), F.concat(F.lit("Old "), k.cast("string")).alias("name"), F.concat(F.lit("old "), k.cast("string")).alias("name_normalized"), F.when(nation % 2 == 0, "old street").alias("address"),
        null("double").alias("lat"), null("double").alias("lng"), null("int").alias("city_id"), null("string").alias("city_name"), F.when(rich, "http://old.cy/").alias("website"), F.when(rich, "old.cy").alias("website_domain"), null("string").alias("phone_raw"), null("string").alias("phone_e164"), F.lit(False).alias("phone_valid"),
    )
    mails = F.array(F.concat(F.lit("m"), k.cast("string"), F.lit("@shop.cy")), F.concat(F.lit("nation"), nation.cast("string"), F.lit("@shop.cy")), F.concat(F.lit("x@blocked"), nation.cast("string"), F.lit(".cy")))
    staged = c.where("c_mktsegment <> 'BUILDING'").select(
        oid.alias("id"), F.col("c_name").alias("name"), F.lit("shop.cy").alias("website"), null("string").alias("phone"), F.lit("CY").alias("country_code"), null("double").alias("lat"), null("double").alias("lng"), F.concat(F.lit("new "), nation.cast("string")).alias("address"), mails.alias("emails"),
        F.array(F.when(F.col("c_mktsegment") == "MACHINERY", "junk").otherwise("spa")).alias("taxonomy_hierarchy"), null("string").alias("basic_category"), null("string").alias("taxonomy_primary"),
    )
    rules = spark.createDataFrame([("spa", 1, None), ("junk", None, "no")], "match string, subcategory_id int, excluded_reason string")
    blocked = table(spark, d, "nation").select(null("string").alias("email_hash"), F.concat(F.lit("blocked"), F.col("n_nationkey").cast("string"), F.lit(".cy")).alias("domain"))
    known = c.where("c_acctbal > 9000").select(F.concat(F.lit("m"), k.cast("string"), F.lit("@shop.cy")).alias("email"), F.lit(0).cast("long").alias("place_id"), F.lit("PERSONAL").alias("email_type"), F.lit(False).alias("is_own_domain"))
    return datasets.merge_staged(old, known, staged, rules, blocked)


@query("""WITH o AS (SELECT c_custkey AS id, 'o' || c_custkey AS oid FROM customer WHERE c_acctbal > 0), s AS (SELECT 'o' || c_custkey AS oid, c_custkey AS k, c_nationkey AS nat FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')),
f AS (SELECT s.oid, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY s.oid) AS id FROM s WHERE oid NOT IN (SELECT oid FROM o)),
p AS (SELECT s.*, coalesce(o.id, f.id) AS id FROM s LEFT JOIN o ON o.oid = s.oid LEFT JOIN f ON f.oid = s.oid),
k AS (SELECT 'm' || c_custkey || '@shop.cy' AS email, 0 AS place_id FROM customer WHERE c_acctbal > 9000)
SELECT email, place_id FROM k UNION ALL SELECT 'm' || p.k || '@shop.cy', id FROM p WHERE 'm' || p.k || '@shop.cy' NOT IN (SELECT email FROM k) UNION ALL SELECT 'nation' || nat || '@shop.cy', min(id) FROM p GROUP BY nat""")
def staging_emails(spark, d):
    """New addresses go to their first place; known and suppressed ones are left alone."""
    return _merge(spark, d).emails.select("email", "place_id")


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey < 5 THEN 'Town ' || c_nationkey ELSE 'Paphos' END AS city, CASE WHEN c_acctbal > 0 THEN '+35799123456' WHEN c_acctbal > -500 THEN '+35725123456' END AS phone,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'https://shop' || c_custkey || '.cy/' END AS website, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'fresha.com' END AS booking_platform, CASE WHEN c_acctbal > 5000 THEN 'p@x.cy' END AS email,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'https://instagram.com/shop' END AS instagram, CAST(round(100.0 * (2 + (c_acctbal > -500)::INT + (c_acctbal > 1000)::INT + (c_mktsegment <> 'MACHINERY')::INT + (c_acctbal > 5000)::INT) / 9) AS INT) AS completeness,
  concat_ws(';', CASE WHEN c_acctbal <= -500 THEN 'phone' END, CASE WHEN c_acctbal <= 1000 THEN 'address' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'website or social link' END, CASE WHEN c_acctbal <= 5000 THEN 'email' END, 'opening hours', 'photos', 'services and prices') AS missing,
  c_mktsegment <> 'MACHINERY' OR (c_acctbal <= 0 AND c_acctbal > -500) AS uses_second_source FROM customer""")
def page_record_fields(spark, d):
    """Page records by precedence of sources, with links by kind and completeness."""
    from terrane.sources.sinks import page_csv

    c, k, bal, seg = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    null, texts = F.lit(None).cast("string"), lambda *x: F.array_compact(F.array(*x)).cast("array<string>")
    a = F.struct(
        F.concat(F.lit("o"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(bal > 1000, "Street 1").alias("address"), null.alias("postcode"), F.when(F.col("c_nationkey") < 5, F.concat(F.lit("Town "), F.col("c_nationkey").cast("string"))).alias("locality"),
        texts(F.lit("bad"), F.when(bal > 0, "99 123456")).alias("phones"), texts(F.when(seg == "FURNITURE", "https://www.fresha.com/x"), F.when(seg == "BUILDING", F.concat(F.lit("https://shop"), k.cast("string"), F.lit(".cy")))).alias("websites"),
        texts(F.lit(None)).alias("socials"), texts(F.lit(None)).alias("emails"), F.lit("spa").alias("taxonomy_primary"), F.lit(34.7).alias("lat"), F.lit(33.0).alias("lng"),
    )
    b = F.struct(F.lit("f").alias("id"), F.when(bal > -500, "25 123456").alias("tel"), null.alias("website"), F.when(seg != "MACHINERY", "@shop").alias("instagram"), F.lit(None).cast("long").alias("facebook_id"))
    rows = c.select(k.alias("id"), F.lit("CY").alias("country_code"), F.lit("Paphos").alias("city_name"), F.when(bal > 5000, "p@x.cy").alias("primary_email"), F.lit(True).alias("sells_online"), null.alias("google_place_id"), a.alias("a"), b.alias("b"))
    flat = page_csv(places.page_records(rows))
    return flat.select("id", "name", "city", "phone", "website", "booking_platform", "email", "instagram", "completeness", "missing", "uses_second_source")
