"""Queries on algorithmic joins: keys, grids, boxes, polygons, prefixes, components, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import fixed, geo, text, urls
from terrane.operators import components, dedupe, joins, leads, webpages
from terrane.plans.registry import Registry
from terrane.plans.scalars import HOST_SQL
from terrane.session import table

query = Registry()

POINTS_SQL = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 0.02 + 35 AS lat, CAST(embedding[2] AS DOUBLE) * 0.02 + 33 AS lng, label FROM embeddings)"
KM_SQL = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


def _points(spark, d):
    v = lambda k: F.element_at("embedding", k).cast("double") * 0.02
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (v(1) + 35).alias("lat"), (v(2) + 33).alias("lng"), "label")


@query(f"SELECT a.page_id AS id_a, b.page_id AS id_b FROM (SELECT page_id, {HOST_SQL} AS h FROM pages) a JOIN (SELECT page_id, {HOST_SQL} AS h FROM pages) b ON a.h = b.h AND a.page_id < b.page_id WHERE abs(a.page_id - b.page_id) <= 20")
def same_key_pairs(spark, d):
    """Pairs of a key within a distance; blocked by key and cell, so a large key is not all pairs."""
    rows = table(spark, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("h"), F.floor(F.col("page_id") / 20).alias("c"))
    other = rows.select(F.col("page_id").alias("id_b"), F.col("h").alias("h2"), F.explode(F.array(F.col("c"), F.col("c") - 1)).alias("c2"))
    near = rows.join(other, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2")) & (F.col("page_id") < F.col("id_b")))
    return near.where("id_b - page_id <= 20").select(F.col("page_id").alias("id_a"), "id_b").distinct()


@query(f"""WITH h AS (SELECT page_id AS id, regexp_replace({HOST_SQL}, '^www\\.', '') AS w FROM pages), n AS (SELECT w FROM h GROUP BY 1 HAVING count(*) >= 3)
 SELECT id, CASE WHEN w LIKE 'blog.%' OR w = 'ththon.example.com' THEN 'BLOCKLIST' ELSE 'SHARED_DOMAIN' END AS chain_reason FROM h WHERE w LIKE 'blog.%' OR w = 'ththon.example.com' OR w IN (SELECT w FROM n)""")
def chain_keys(spark, d):
    """Chains by blocklist or by a domain of three places and more."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(urls.host_of(F.col("url")), r"^www\.", "").alias("website_domain"))
    rows = rows.withColumn("name_normalized", F.replace("website_domain", F.lit("."), F.lit(" ")))
    block = spark.createDataFrame([("blog", None), ("", "www.ththon.example.com")], "name_normalized string, domain string")
    return leads.detect_chains(rows, block)


DICE_SQL = """g AS (SELECT DISTINCT p_name, list_transform(range(length(replace(p_name, ' ', '')) - 1), lambda i: substr(replace(p_name, ' ', ''), i + 1, 2)) AS g FROM part)"""


@query(f"""WITH {DICE_SQL} SELECT a.p_name AS a, b.p_name AS b, round(2.0 * list_sum(list_transform(list_distinct(a.g), lambda x: least(len(list_filter(a.g, lambda y: y = x)), len(list_filter(b.g, lambda z: z = x))))) / (len(a.g) + len(b.g)), 6) AS dice
 FROM g a JOIN g b ON a.p_name < b.p_name WHERE 2.0 * list_sum(list_transform(list_distinct(a.g), lambda x: least(len(list_filter(a.g, lambda y: y = x)), len(list_filter(b.g, lambda z: z = x))))) / (len(a.g) + len(b.g)) >= 0.6""")
def dice_pairs(spark, d):
    """Bigram similarity of distinct names; similar ones share one of their rarer bigrams."""
    names = dedupe.name_blocks(table(spark, d, "part").select(F.col("p_name").alias("name_c")).distinct(), 0.6)
    a, b = names.select(F.col("name_c").alias("a"), "block"), names.select(F.col("name_c").alias("b"), "block")
    pairs = a.join(b, "block").where("a < b").select("a", "b").distinct().select("a", "b", text.dice(F.col("a"), F.col("b")).alias("dice"))
    return pairs.where("dice >= 0.6").select("a", "b", F.round("dice", 6).alias("dice"))


@query()
def match_components(spark, d):
    """Connected components over all orders; recursive SQL is too slow for the large ones, tests use union-find."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), (-1 - F.col("o_orderkey") % 4001).alias("v"))
    return components.connected_components(e)


@query(f"""WITH {POINTS_SQL} SELECT a.id AS id_a, b.id AS id_b, round(1000 * {KM_SQL}, 3) AS metres FROM p a JOIN p b ON a.id < b.id AND abs(floor(a.lat / 0.002) - floor(b.lat / 0.002)) <= 1 AND abs(floor(a.lng / 0.002) - floor(b.lng / 0.002)) <= 1
 WHERE 1000 * {KM_SQL} <= 200 AND a.label % 2 = b.label % 2""")
def grid_pairs(spark, d):
    """Near pairs by grid cells, as the matching of names uses them."""
    places = _points(spark, d).select("id", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("name_c"), "lat", "lng")
    pairs = dedupe.name_pairs(places, dedupe.DedupeRules(name_similarity=0.99))
    return pairs.select("id_a", "id_b", geo.round_half_up(F.col("metres"), 3).alias("metres"))


CENTERS_SQL = "c AS (SELECT id, lat, lng FROM p WHERE id % 20 = 0)"


@query(f"""WITH {POINTS_SQL}, {CENTERS_SQL}, k AS (SELECT a.id AS point_id, b.id AS center_id, {KM_SQL} AS km FROM p a, c b)
 SELECT point_id, arg_min(center_id, (km, center_id)) AS center_id, round(min(km), 6) AS km FROM k WHERE km <= 0.5 GROUP BY 1""")
def nearest_center(spark, d):
    """The nearest centre within a limit, by cells."""
    p = _points(spark, d)
    centers = p.where("id % 20 = 0").select(F.col("id").alias("center_id"), F.lit("").alias("name"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return joins.nearest(p.select(F.col("id").alias("point_id"), "lat", "lng"), centers, 0.5).select("point_id", "center_id", F.round("km", 6).alias("km"))


BOXES_SQL = "bx AS (SELECT id AS box_id, label AS population, lat - 0.004 AS south, lng - 0.003 AS west, lat + 0.004 AS north, lng + 0.003 AS east FROM p WHERE label = 3)"


def _boxes(spark, d):
    return _points(spark, d).where("label = 3").select(F.col("id").alias("box_id"), F.lit("x").alias("name"), F.col("label").alias("population"), (F.col("lat") - 0.004).alias("south"), (F.col("lng") - 0.003).alias("west"), (F.col("lat") + 0.004).alias("north"), (F.col("lng") + 0.003).alias("east"))


@query(f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT id AS point_id FROM p WHERE EXISTS (SELECT 1 FROM bx WHERE lat BETWEEN south AND north AND lng BETWEEN west AND east)")
def box_semi(spark, d):
    """Points in any box, once."""
    return joins.in_any_box(_points(spark, d).select(F.col("id").alias("point_id"), "lat", "lng"), _boxes(spark, d), 0.005).select("point_id")


@query(f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT id AS point_id, arg_max(box_id, (population, -box_id)) AS box_id FROM p JOIN bx ON lat BETWEEN south AND north AND lng BETWEEN west AND east GROUP BY 1")
def largest_box(spark, d):
    """The most populous box that contains a point."""
    return joins.largest_box(_points(spark, d).select(F.col("id").alias("point_id"), "lat", "lng"), _boxes(spark, d), 0.005).select("point_id", "box_id")


#: A square with a hole, and an island (x is longitude).
RINGS = [(1, [(32.99, 34.985), (33.015, 34.985), (33.015, 35.012), (32.99, 35.012), (32.99, 34.985)]), (1, [(32.998, 34.995), (33.004, 34.995), (33.002, 35.003), (32.998, 34.995)]), (2, [(33.02, 35.0), (33.03, 35.01), (33.02, 35.02), (33.02, 35.0)])]
EDGES_SQL = ", ".join(f"({f}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for f, ring in RINGS for a, b in zip(ring, ring[1:], strict=False))


@query(f"""WITH {POINTS_SQL}, e(f, x1, y1, x2, y2) AS (VALUES {EDGES_SQL}) SELECT DISTINCT id AS point_id FROM (SELECT p.id, e.f FROM p JOIN e ON (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)""")
def poly_contains(spark, d):
    """Even-odd rule with holes and several areas."""
    rings = spark.createDataFrame([(f, [{"x": x, "y": y} for x, y in ring]) for f, ring in RINGS], "feature_id long, points array<struct<x:double,y:double>>")
    points = _points(spark, d).select(F.col("id").alias("point_id"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    return joins.inside_outline(points, joins.edges_of(rings))


RULES = [("a", 1, None), ("a > b", 2, None), ("a > b > c", None, "junk"), ("z", 3, None), ("basic:spa", 4, None)]


@query("""SELECT p_partkey AS row_id, CASE WHEN s = 0 THEN NULL WHEN s = 1 THEN 'a' WHEN s IN (2, 3) THEN 'a > b' WHEN s = 4 THEN 'a > b > c' WHEN s = 5 THEN NULL ELSE 'basic:spa' END AS match,
 CASE WHEN s IN (0, 5) THEN 'unmapped' WHEN s = 4 THEN 'excluded' ELSE 'mapped' END AS kind FROM (SELECT p_partkey, p_partkey % 7 AS s FROM part)""")
def longest_prefix(spark, d):
    """The longest rule that is a prefix of a path in whole steps; basic rules without a path."""
    paths = ["az > q", "a > x", "a > b", "a > b > d", "a > b > c > d", "zz", ""]
    path = F.get(F.array(*[F.lit(x) for x in paths]), F.col("p_partkey") % 7)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.filter(F.split(path, " > "), lambda x: x != "").alias("taxonomy_hierarchy"), F.lit("none").alias("basic_category"), F.lit("spa").alias("taxonomy_primary"))
    rules = spark.createDataFrame(RULES, "match string, subcategory_id int, excluded_reason string")
    return joins.classify_places(rows, rules).select("row_id", "match", "kind")


@query("SELECT c_custkey AS id, CASE WHEN n_name LIKE '%1%' THEN 'one' WHEN n_name LIKE '%2%' THEN 'two' WHEN c_mktsegment LIKE '%BUILD%' THEN 'build' END AS area FROM customer JOIN nation ON c_nationkey = n_nationkey")
def area_of_name(spark, d):
    """The first name that contains any area's word, areas in order."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), joins.first_containing(F.array("n_name", "c_mktsegment"), [("1", "one"), ("2", "two"), ("build", "build")]).alias("area"))


TREE_SQL = """t AS (SELECT r_regionkey + 1000 AS id, NULL AS parent_id, 'COUNTRY' AS type FROM region UNION ALL SELECT n_nationkey + 500, n_regionkey + 1000, 'REGION' FROM nation UNION ALL SELECT s_suppkey + 10000, s_nationkey + 500, 'CITY' FROM supplier)"""


def _tree(spark, d):
    null = F.lit(None).cast("long")
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), null.alias("parent_id"), F.lit("COUNTRY").alias("type"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 500).cast("long"), (F.col("n_regionkey") + 1000).cast("long"), F.lit("REGION"))
    return r.union(n).union(table(spark, d, "supplier").select((F.col("s_suppkey") + 10000).cast("long"), (F.col("s_nationkey") + 500).cast("long"), F.lit("CITY")))


@query(f"""WITH RECURSIVE {TREE_SQL}, w AS (SELECT id, type FROM t WHERE id IN (1001, 503, 10003) UNION SELECT t.id, t.type FROM t JOIN w ON t.parent_id = w.id) SELECT DISTINCT id FROM w WHERE type = 'CITY'""")
def tree_leaves(spark, d):
    """J22."""
    return joins.tree_leaves(_tree(spark, d), spark.createDataFrame([(1001,), (503,), (10003,)], "id long"))


@query("""SELECT node, min(b) AS south, max(b) AS north FROM (SELECT unnest([CAST(n_nationkey + 500 AS BIGINT), n_regionkey + 1000]) AS node, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def box_rollup(spark, d):
    """Bounds of all levels above."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    up = rows.select(F.explode(F.array((F.col("n_nationkey") + 500).cast("long"), (F.col("n_regionkey") + 1000).cast("long"))).alias("node"), F.col("c_acctbal").alias("b"))
    return up.groupBy("node").agg(F.min("b").alias("south"), F.max("b").alias("north"))


@query(f"""SELECT {HOST_SQL} AS domain, contains(string_agg(html, ''), 'myshopify.com') AS sells_online FROM pages GROUP BY 1""")
def selling_signals(spark, d):
    """Signals of selling online over the pages of a domain."""
    rows = table(spark, d, "pages").select(urls.host_of(F.col("url")).alias("domain"), "html")
    return webpages.selling_signals(rows).select("domain", "sells_online")


@query(r"""WITH p AS (SELECT regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS site, html FROM pages WHERE html IS NOT NULL),
e AS (SELECT DISTINCT site, lower(unnest(regexp_extract_all(html, '[A-Za-z0-9._-]+@mail[0-9]+\.example\.com'))) AS email FROM p)
SELECT DISTINCT site, 'info@shop.cy' AS email, 'mailto' AS source, NULL AS rejected, 'GENERIC' AS email_type, true AS is_primary FROM p UNION ALL SELECT site, email, 'text', 'PLACEHOLDER', 'PERSONAL', false FROM e""")
def html_emails(spark, d):
    """Addresses of sites, with reasons, classes and the primary one."""
    p = table(spark, d, "pages").select(urls.host_of(F.col("url")).alias("site"), F.col("page_id").cast("long").alias("page_order"), "url", F.concat("html", F.lit('<a href="mailto:info%40shop.cy?subject=x">mail</a>')).alias("html"))
    free = spark.createDataFrame([("gmail.com",)], "domain string")
    mx = spark.createDataFrame([("shop.cy", True)], "domain string, mx_valid boolean")
    return webpages.evaluate_sites(p, free, mx).select("site", "email", "source", "rejected", "email_type", "is_primary")


@query()
def html_links(spark, d):
    """Links to contact and legal pages."""
    p = table(spark, d, "pages").select("page_id", "url", F.replace("html", F.lit('href="/the"'), F.lit('href="/contact-us?x=1#a"')).alias("html"))
    return webpages.contact_links(p)


@query("SELECT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) < 20 AND regexp_extract(c_name, '[0-9]+$') <> regexp_extract(s_name, '[0-9]+$')")
def unsure_pairs(spark, d):
    """Near pairs of a key that share no distinctive word."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", text.comparable_name(text.matching_name(F.regexp_extract("c_name", "[0-9]+$", 0))).alias("cn"), F.floor(F.col("c_acctbal") / 20).alias("cell"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", text.comparable_name(text.matching_name(F.regexp_extract("s_name", "[0-9]+$", 0))).alias("sn"), F.explode(F.sequence(F.floor(F.col("s_acctbal") / 20) - 1, F.floor(F.col("s_acctbal") / 20) + 1)).alias("cell2"))
    j = c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("cell") == F.col("cell2"))).where(F.abs(F.col("c_acctbal") - F.col("s_acctbal")) < 20)
    return j.where(~text.share_distinctive_word(F.col("cn"), F.col("sn"))).select(F.col("c_custkey").alias("a"), F.col("s_suppkey").alias("b"))
