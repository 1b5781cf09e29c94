"""Queries on small operators and on idioms that others build on: semi-joins, ages, latest rows, cells of text, arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo, text, urls
from terrane.operators import places, reports, services
from terrane.plans.registry import Registry
from terrane.session import table
from terrane.sources import places as sources
from terrane.sources import sinks

query = Registry()


def _words(spark, d):
    """Names of two nations, some marks and a number, for functions of text."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("k"), F.concat_ws(" ", F.lit("The"), "n_name", F.lit("salon & spa, "), F.col("n_nationkey").cast("string"), F.lit("Áéñ")).alias("name"))


WORDS_SQL = "w AS (SELECT n_nationkey AS k, concat_ws(' ', 'The', n_name, 'salon & spa, ', CAST(n_nationkey AS VARCHAR), 'Áéñ') AS name FROM nation)"


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def semi_join(spark, d):
    """J04."""
    rich = table(spark, d, "orders").where("o_totalprice > 150000")
    return table(spark, d, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def anti_join(spark, d):
    """J06."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 350000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("WITH t AS (SELECT max(o_orderdate) AS now, count(*) AS n FROM orders) SELECT o_orderkey AS k, date_diff('day', CAST(o_orderdate AS DATE), CAST(now AS DATE)) AS age, n FROM orders CROSS JOIN t")
def cross_one_row(spark, d):
    """A one-row table beside every row; its size is one by the aggregate that makes it."""
    o = table(spark, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"), F.count("*").alias("n"))
    return o.crossJoin(F.broadcast(now)).select(F.col("o_orderkey").alias("k"), F.date_diff("now", "o_orderdate").cast("long").alias("age"), "n")


@query("SELECT l_orderkey AS k, l_linenumber AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def count_over(spark, d):
    """A count beside each row; over a key by partial sums joined back, so a hot key is no window."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"))
    n = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return rows.join(n, F.col("l_orderkey") == F.col("k")).select("k", "i", "n")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def latest_rows(spark, d):
    """The newest thirty events."""
    return services.latest(table(spark, d, "events"), "ts", "event_id", 30).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def retention(spark, d):
    """Snapshots of the last days stay."""
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return services.kept_snapshots(e.withColumnRenamed("ts", "taken_at"), now, 20).select("event_id")


@query("""SELECT 'd' || c_custkey % 40 || '.cy' AS website_domain, min(c_custkey) AS priority FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 > 0 AND c_custkey % 40 NOT BETWEEN 5 AND 14 AND c_custkey % 40 <> 20 GROUP BY 1""")
def due_shop_checks(spark, d):
    """domains of places with an address and no fresh or running check."""
    domain = lambda n: F.concat(F.lit("d"), n.cast("string"), F.lit(".cy"))
    c, at = table(spark, d, "customer"), lambda text: F.to_timestamp(F.lit(text))
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "REJECTED").otherwise("NEW").alias("status"), F.lit("x").alias("website"), domain(F.col("c_custkey") % 40).alias("website_domain"))
    emails = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("place_id"))
    n = F.col("id")
    checks = spark.range(5, 22).select(domain(n).alias("domain"), F.when(n >= 20, "RUNNING").otherwise("DONE").alias("status"), F.when(n < 15, at("2024-05-01")).otherwise(at("2023-01-01")).alias("checked_at"), F.when(n == 20, at("2024-05-31 23:50:00")).otherwise(at("2024-05-31")).alias("updated_at"))
    return services.due_shop_checks(rows, emails, checks, at("2024-06-01"))


@query("SELECT p_partkey AS k, list_contains(['Brand#11', 'Brand#23'], p_brand) AS member, regexp_matches(p_name, '^[a-m]') AS early, NOT regexp_matches(p_type, '(STEEL|TIN)$') AS other FROM part")
def membership_and_patterns(spark, d):
    """Membership in a list, a pattern, a pattern denied."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_contains(F.array(F.lit("Brand#11"), F.lit("Brand#23")), F.col("p_brand")).alias("member"), F.col("p_name").rlike("^[a-m]").alias("early"), (~F.col("p_type").rlike("(STEEL|TIN)$")).alias("other"))


@query("SELECT c_custkey AS k, lower(trim(c_mktsegment)) AS a, split_part(c_name, '#', 2) AS b, replace(c_name, '#', '-') AS c, len(string_split(c_mktsegment, 'E')) AS n FROM customer")
def text_builtins(spark, d):
    """T13."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lower(F.trim("c_mktsegment")).alias("a"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("b"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("c"), F.size(F.split("c_mktsegment", "E")).cast("long").alias("n"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'Cyprus' WHEN 1 THEN 'Greece' WHEN 2 THEN 'Germany' ELSE 'XX' END AS name FROM nation")
def country_names(spark, d):
    """Names of known codes, others keep their code."""
    code = F.get(F.array(F.lit("cy"), F.lit("GR"), F.lit("DE"), F.lit("XX")), F.col("n_nationkey") % 4)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), sinks.country_name(code).alias("name"))


@query(f"WITH {WORDS_SQL} SELECT k, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[&,_]', ' ', 'g'), ' +'), lambda x: x <> '' AND NOT list_contains([{', '.join(repr(x) for x in text.PLACE_NOISE)}], x)), ' ') AS comparable FROM w")
def comparable_names(spark, d):
    """T03."""
    return _words(spark, d).select("k", text.comparable_name(F.col("name")).alias("comparable"))


@query(r"SELECT c_custkey AS k, replace(replace(replace(c_name || '%x_', '\', '\\'), '%', '\%'), '_', '\_') AS pattern, array_to_string([lower(trim(x)) FOR x IN string_split(' Dr , ' || c_mktsegment || ',,MR', ',') IF trim(x) <> ''], '|') AS titles FROM customer")
def text_lists(spark, d):
    """A comma list as values, a text as a literal pattern."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.like_escaped(F.concat("c_name", F.lit("%x_"))).alias("pattern"), F.array_join(text.title_list(F.concat(F.lit(" Dr , "), "c_mktsegment", F.lit(",,MR"))), "|").alias("titles"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS is_real FROM nation")
def real_cities(spark, d):
    """Empty, unknown, the country's code, or a real one."""
    city = F.get(F.array(F.lit(" "), F.lit("Unknown"), F.lit("CY"), F.lit("Larnaca")), F.col("n_nationkey") % 4)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), text.is_real_city(city, F.lit("cy")).alias("is_real"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') = 'tiontion.example.net' AS same FROM pages")
def same_sites(spark, d):
    """R04."""
    return table(spark, d, "pages").select("page_id", urls.same_site(urls.host_of(F.col("url")), F.lit("WWW.tiontion.example.net")).alias("same"))


@query("SELECT page_id, 'http://a/' || page_id || '?x=1&y|http://b/' || page_id AS found FROM pages")
def sitemap(spark, d):
    """R06."""
    k = F.col("page_id").cast("string")
    xml = F.concat(F.lit("<urlset><url><LOC> http://a/"), k, F.lit("?x=1&amp;y\n</loc></url><loc><![CDATA[http://b/"), k, F.lit("]]></loc>"))
    return table(spark, d, "pages").select("page_id", F.array_join(urls.sitemap_locations(xml), "|").alias("found"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'iso-8859-7' WHEN 1 THEN 'utf-8' ELSE 'utf-8' END AS charset FROM pages")
def charsets(spark, d):
    """By header, by meta tag, else UTF-8."""
    header = F.when(F.col("page_id") % 3 == 0, F.lit("text/html; Charset=ISO-8859-7"))
    head = F.when(F.col("page_id") % 3 != 2, F.substring("html", 1, 300))
    return table(spark, d, "pages").select("page_id", urls.charset(header, head).alias("charset"))


@query("SELECT c_custkey AS k, 'https://www.google.com/maps/search/?api=1&query=' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '%20x&query_place_id=p%2F' || c_custkey AS url FROM customer")
def maps_urls(spark, d):
    """R11."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), urls.maps_url(F.concat(F.lit("p/"), F.col("c_custkey").cast("string")), F.concat("c_name", F.lit(" x"))).alias("url"))


@query("SELECT c_custkey AS k, CAST(floor(c_custkey * 0.9) AS BIGINT) AS cap, CAST(ceil(c_custkey * 0.75) AS BIGINT) AS warn_at FROM customer")
def quota_limits(spark, d):
    """G08."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), geo.quota_bounds(F.col("c_custkey"), 0.9, 0.75).alias("q")).select("k", "q.cap", "q.warn_at")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'Λάρνακα' END AS local FROM nation")
def local_names(spark, d):
    """The first alternate in Greek letters."""
    names = F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("Λάρνακα")).otherwise(F.lit("Ларнака")), F.lit("x"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), geo.local_name(names, "Greek").alias("local"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'closed' WHEN c_acctbal < 0 THEN 'low_confidence' WHEN c_custkey % 3 = 0 THEN 'no_contact' ELSE 'kept' END AS outcome FROM customer")
def place_outcomes(spark, d):
    """Why a place is dropped, first reason first."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, "permanently_closed").alias("operating_status"), F.when(F.col("c_acctbal") < 0, 0.1).otherwise(0.9).alias("confidence"), F.when(k % 3 == 1, F.array(F.lit("a@b.cy"))).otherwise(F.array().cast("array<string>")).alias("emails"), F.when(k % 3 == 2, F.array(F.lit("own.cy"))).otherwise(F.array(F.lit("facebook.com/x"))).alias("websites"))
    return rows.select("id", sources.nested_outcome(0.5, True).alias("outcome"))


@query("SELECT max(r) AS release FROM (SELECT '2024-' || lpad(CAST(1 + n_nationkey % 9 AS VARCHAR), 2, '0') || '-15.' || n_nationkey % 2 AS r FROM nation)")
def newest_release(spark, d):
    """S04."""
    n = F.col("n_nationkey")
    return sources.latest_release(table(spark, d, "nation").select(F.concat(F.lit("2024-"), F.lpad((1 + n % 9).cast("string"), 2, "0"), F.lit("-15."), (n % 2).cast("string")).alias("release")))


@query("SELECT s_suppkey AS geonames_id, s_name AS name, CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 1000, 3) END AS lat, CAST(s_nationkey AS BIGINT) AS population FROM supplier")
def gazetteer_rows(spark, d):
    """Tab-separated rows of nineteen columns; an empty number is none."""
    blank = F.lit("")
    lat = F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 1000, 3).cast("string")).otherwise(blank)
    cells = [F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_name"), F.lit("a, b,"), lat, F.lit("33.0"), F.lit("P"), F.lit("PPL"), F.lit("CY"), blank, F.lit("01"), blank, blank, blank, F.col("s_nationkey").cast("string"), blank, blank, blank, blank]
    rows = table(spark, d, "supplier").select(F.concat_ws("\t", *cells).alias("value")).union(spark.createDataFrame([("short\tline",)], "value string"))
    return sources.gazetteer(rows).select("geonames_id", "name", "lat", "population")


@query("SELECT s_suppkey || '@x.cy' AS email, CASE WHEN s_nationkey % 2 = 0 THEN 'hard_bounce' ELSE '' END AS status, s_nationkey % 2 = 0 AS valid FROM supplier")
def mailer_results(spark, d):
    """Addresses in normal form, statuses with underscores; rows without a status are not valid."""
    rows = table(spark, d, "supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit("@X.CY")).alias("email"), F.when(F.col("s_nationkey") % 2 == 0, " Hard-Bounce ").alias("status"))
    return sources.mailer_rows(rows).select("email", "status", "valid")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark, d):
    """S23."""
    return reports.counts_by(table(spark, d, "part"), "p_brand").toDF("value", "n")


@query("WITH a AS (SELECT c_nationkey AS country_code, c_custkey AS id, CAST(c_custkey % 11 AS DOUBLE) AS lat, CAST(c_custkey % 7 AS DOUBLE) AS lng, CAST(c_acctbal AS BIGINT) AS p FROM customer), b AS (SELECT country_code, id FROM (SELECT *, row_number() OVER (PARTITION BY country_code, lat, lng ORDER BY p DESC, id) AS rn FROM a) WHERE rn = 1 AND p >= 5000) SELECT CAST(country_code AS VARCHAR) AS country_code, 'city:' || id AS key FROM b")
def search_areas(spark, d):
    """The largest city of each place on a lattice has an area, smaller ones there are absorbed."""
    k = F.col("c_custkey")
    lat, lng = (k % 11).cast("double"), (k % 7).cast("double")
    cities = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("country_code"), k.alias("id"), F.lit("x").alias("name"), lat.alias("lat"), lng.alias("lng"), F.rint("c_acctbal").cast("long").alias("population"), F.lit(1).cast("long").alias("parent_id"), F.lit("p").alias("parent_name"), (lat - 0.1).alias("south"), (lng - 0.1).alias("west"), (lat + 0.1).alias("north"), (lng + 0.1).alias("east"))
    return places.plan_search_areas(cities, include_rural=False).select("country_code", "key")


@query(r"""WITH s AS (SELECT p_partkey, list_distinct(list_transform(list_filter(string_split(lower(p_name || ' Shops & Bars ' || p_type), ' '), lambda w: len(w) >= 3), lambda w: regexp_replace(w, '^(.{4,})s$', '\1'))) AS stems FROM part)
SELECT p_partkey AS k, array_to_string(list_sort(stems), ',') AS stems, CAST(list_contains(stems, 'bars') AS INT) + CAST(list_contains(stems, 'anvil') AS INT) + CAST(list_contains(stems, 'glass') AS INT) AS hits FROM s""")
def stem_hits(spark, d):
    """Stems of names, and how many of a keyword list a name has; common words do not count."""
    p = table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", F.lit("Shops & Bars"), "p_type")
    words = F.array(F.lit("Bars"), F.lit("anvils and the shop"), F.lit("Glass"))
    hits = text.keyword_hits(name, words)
    return p.select(F.col("p_partkey").alias("k"), F.array_join(F.array_sort(text.stems(name)), ",").alias("stems"), hits.alias("hits"))


@query("""SELECT user_id, CASE WHEN epoch_us(now) // 1000 - epoch_us(max(ts)) // 1000 < 3600000 THEN 'running' ELSE 'stopped' END AS state FROM events, (SELECT max(ts) AS now FROM events) GROUP BY user_id, now""")
def worker_states(spark, d):
    """Q-9: workers by the age of their last sign of life."""
    e = table(spark, d, "events")
    last, now = e.groupBy("user_id").agg(F.max("ts").alias("beat")), e.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("user_id", reports.worker_state(F.col("beat"), F.col("now"), 3600).alias("state"))


@query("SELECT page_id, length(html) % 400 < 200 AS needs_browser FROM pages WHERE html IS NOT NULL")
def script_built_pages(spark, d):
    """Pages with little visible text in the shell of a script-built site."""
    shown = F.repeat(F.lit("x"), (F.length("html") % 400).cast("int"))
    shell = F.concat(F.lit('<html><head><title>A title that is not shown</title></head><body><!-- no text --><div id="root"><b>'), shown, F.lit("</b></div><script>var a = 1 < 2;</script><noscript>off</noscript></body></html>"))
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", urls.looks_javascript_rendered(shell).alias("needs_browser"))


@query("""WITH s AS (SELECT count(*) AS n, CAST(sum(length(o_orderpriority) * 100) AS BIGINT) AS bytes, (SELECT count(*) FROM customer) AS more FROM orders), e AS (SELECT *, CASE WHEN n >= 1000 THEN bytes / n ELSE 2500.0 END AS each FROM s)
SELECT round(each, 6) AS bytes_per_place, round((bytes + each * more) / 1e6, 6) AS after_mb, (bytes + each * more) / 1e6 <= 900 AS fits FROM e""")
def storage_forecast(spark, d):
    """The size after an import by what a place takes now."""
    o = table(spark, d, "orders").agg(F.count("*").alias("n"), F.sum(F.length("o_orderpriority") * 100).alias("bytes")).first()
    found = services.storage_estimate(o["n"], o["bytes"], table(spark, d, "customer").count())
    return spark.createDataFrame([(round(found["bytes_per_place"], 6), round(found["after_mb"], 6), bool(found["fits"]))], "bytes_per_place double, after_mb double, fits boolean")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark, d):
    """Of equal keys the last in a stable order stays."""
    last = F.max(F.struct("ts", "event_id")).alias("x")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "x.event_id")
