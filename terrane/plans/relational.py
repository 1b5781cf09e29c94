"""Queries on the lead list: filters, joins, aggregates, windows, sorts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators import joins, leads, reports
from terrane.plans.registry import Registry
from terrane.session import table
from terrane.sources import sinks

query = Registry()


#: A customer is a place, its nation the city, its first order the primary address.
LEADS_SQL = """
l AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS city_name, c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment AS segment, o.email, o.domain, o.orders
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS orders,
                    arg_min(CAST(o_orderkey AS VARCHAR) || '@' || lower(o_orderpriority), (o_orderdate, o_orderkey)) AS email,
                    arg_min(lower(o_orderpriority), (o_orderdate, o_orderkey)) AS domain
             FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
sup AS (
  SELECT sha256(CAST(s_suppkey AS VARCHAR) || '@1-urgent') AS email_hash, NULL AS domain FROM supplier
  UNION ALL SELECT NULL, '5-low'),
ok AS (
  SELECT * FROM l WHERE email IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM sup WHERE email_hash = sha256(l.email))
    AND NOT EXISTS (SELECT 1 FROM sup WHERE email_hash IS NULL AND sup.domain = split_part(l.email, '@', 2)))
"""


def lead_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    priority = F.lower("o_orderpriority")
    when = F.struct("o_orderdate", "o_orderkey")
    first = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min_by(F.concat(F.col("o_orderkey").cast("string"), F.lit("@"), priority), when).alias("email"), F.min_by(priority, when).alias("domain"))
    places = table(spark, d, "customer").join(joins.small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return places.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city_name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), "email", "domain", "orders"
    )


def suppression_rows(spark: SparkSession, d: str) -> DataFrame:
    hashes = table(spark, d, "supplier").select(F.sha2(F.concat(F.col("s_suppkey").cast("string"), F.lit("@1-urgent")), 256).alias("email_hash"), F.lit(None).cast("string").alias("domain"))
    return hashes.union(spark.range(1).select(F.lit(None).cast("string"), F.lit("5-low")))


@query(f"""WITH {LEADS_SQL}
SELECT city_name AS city, count(*) FILTER (WHERE email IS NOT NULL) AS with_email,
       count(*) FILTER (WHERE acctbal > 0 AND segment <> 'MACHINERY' AND id IN (SELECT id FROM ok)) AS ready
FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def ready_top_groups(spark, d):
    """Cities by leads with an address, and how many of them are ready."""
    rows = lead_rows(spark, d)
    fit = rows.where(F.col("email").isNotNull() & (F.col("acctbal") > 0) & (F.col("segment") != "MACHINERY"))
    ready = joins.not_suppressed(fit, F.col("email"), suppression_rows(spark, d)).groupBy("city_name").agg(F.count("*").alias("r")).withColumnRenamed("city_name", "c")
    with_email = rows.groupBy("city_name").agg(F.count("email").alias("with_email"))
    joined = with_email.join(ready, F.col("city_name") == F.col("c"), "left")
    return joined.select(F.col("city_name").alias("city"), "with_email", F.coalesce("r", F.lit(0)).alias("ready")).orderBy(F.col("with_email").desc(), "city").limit(10)


def _lead_view(spark, d):
    return lead_rows(spark, d).select(
        "id", "name", "city_name", "email", F.col("domain").alias("website_domain"), F.floor("acctbal").cast("int").alias("score"), F.when(F.col("nation") % 5 == 0, "EXPORTED").otherwise("NEW").alias("status"),
        F.lit("CY").alias("country_code"), F.when(F.col("id") % 7 == 0, F.array(F.lit("NO_CATEGORY"))).otherwise(F.array().cast("array<string>")).alias("review_reasons"), (F.col("segment") == "MACHINERY").alias("is_chain"),
    )


@query(f"""WITH {LEADS_SQL}
SELECT id, name, city_name, email, CAST(floor(acctbal) AS INT) AS score FROM l
WHERE email IS NOT NULL AND floor(acctbal) >= 1000 AND nation % 5 <> 0 AND id % 7 <> 0 AND segment <> 'MACHINERY'
  AND (name ILIKE '%9\\%%' ESCAPE '\\' OR name ILIKE '%1%' OR domain ILIKE '%1%' OR email ILIKE '%1%')
ORDER BY score DESC, name, id LIMIT 50 OFFSET 50""")
def lead_list_page(spark, d):
    """The second page of a filtered list."""
    f = leads.LeadFilters(country="CY", has_email=True, min_score=1000, status="NEW", needs_review=False, chain=False, q="1")
    return leads.lead_page(_lead_view(spark, d), f, page=2).select("id", "name", "city_name", "email", "score")


@query(f"WITH {LEADS_SQL} SELECT city_name AS value, count(*) AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def lead_facets(spark, d):
    """A05."""
    return leads.facet(lead_rows(spark, d), "city_name")


@query(f"WITH {LEADS_SQL} SELECT id, email FROM ok")
def suppress_split(spark, d):
    """Not suppressed by hash nor by domain, as two equi anti-joins."""
    rows = lead_rows(spark, d).where("email IS NOT NULL")
    return joins.not_suppressed(rows, F.col("email"), suppression_rows(spark, d)).select("id", "email")


@query("""SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)
AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def anti_any_key(spark, d):
    """No match by any of several keys."""
    s, o = table(spark, d, "supplier"), table(spark, d, "orders")
    out = joins.anti_join_any(table(spark, d, "customer"), s, [(F.col("c_custkey"), F.col("s_suppkey"))])
    out = joins.anti_join_any(out, s.where("s_acctbal < 0"), [(F.col("c_nationkey"), F.col("s_nationkey"))])
    return joins.anti_join_any(out, o.where("o_orderstatus = 'P'"), [(F.col("c_custkey"), F.col("o_custkey"))]).select(F.col("c_custkey").alias("id"))


@query("""SELECT c_custkey AS id, o.o_orderkey AS top_order, o.o_totalprice AS top_price FROM customer LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1) o ON o_custkey = c_custkey""")
def lateral_top1(spark, d):
    """The best row of each key, kept for keys without any."""
    best = joins.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])
    return table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("o_orderkey").alias("top_order"), F.col("o_totalprice").alias("top_price"))


@query("""SELECT c_custkey AS id, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY (o_orderstatus = 'O') DESC, o_orderkey), '') AS orders,
 coalesce(string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority), '') AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def ordered_arrays(spark, d):
    """Ordered and distinct array aggregates, empty where there is nothing."""
    item = F.struct((F.col("o_orderstatus") != "O").alias("late"), "o_orderkey")
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["o_orderkey"]).alias("a"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return table(spark, d, "customer").join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce(F.array_join(F.transform("a", lambda x: x.cast("string")), ";"), F.lit("")).alias("orders"), F.coalesce(F.array_join("p", ";"), F.lit("")).alias("priorities"))


@query("""SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS has_large,
 (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer""")
def existence_flags(spark, d):
    """Existence and counts as columns."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 200000).alias("large"), F.count("*").alias("n"))
    return table(spark, d, "customer").join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("large", F.lit(False)).alias("has_large"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT n_name, r_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def country_rollup(spark, d):
    """Three aggregates joined to a dimension."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    n = table(spark, d, "nation").join(joins.small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select("n_name", "r_name", F.coalesce("s", F.lit(0)).alias("suppliers"), F.coalesce("c", F.lit(0)).alias("customers"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value IS NULL) AS missing,
 coalesce(round(sum(value) FILTER (WHERE user_id % 2 = 0), 4), 0) AS even_sum, max(ts) FILTER (WHERE user_id % 2 = 1) AS odd_last FROM events GROUP BY 1""")
def metric_bank(spark, d):
    """Many filtered measures in one pass."""
    even, odd = F.col("user_id") % 2 == 0, F.col("user_id") % 2 == 1
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value").isNull()).alias("missing"), F.coalesce(F.round(F.sum(F.when(even, F.col("value"))), 4), F.lit(0.0)).alias("even_sum"), F.max(F.when(odd, F.col("ts"))).alias("odd_last"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS error_users FROM events")
def distinct_filtered(spark, d):
    """A03."""
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("error_users"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def pivot_status(spark, d):
    """A12 A22."""
    g = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return g.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""SELECT l_returnflag, max(l_quantity) AS highest, list_extract(list(l_quantity ORDER BY l_quantity DESC), CAST(floor(count(*) / 2) AS BIGINT) + 1) AS median, min(l_quantity) AS lowest FROM lineitem GROUP BY 1""")
def median_floor(spark, d):
    """Order statistics by ranks, not by interpolation."""
    return reports.order_statistics(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", ["l_returnflag"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def enum_counts(spark, d):
    """A10."""
    return reports.counts_by(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def unnest_histogram(spark, d):
    """A11 J25."""
    return reports.histogram(table(spark, d, "part").select(F.split("p_name", " ").alias("words")), "words")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, len(string_split(p_name, ' ')) AS n_words FROM part")
def posexplode_first(spark, d):
    """Unnest with ordinality."""
    words = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "w"))
    return words.groupBy("p_partkey").agg(F.max(F.when(F.col("pos") == 0, F.col("w"))).alias("first_word"), F.count("*").alias("n_words"))


@query(f"""WITH {LEADS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY acctbal DESC, name, id) AS rn FROM ok WHERE acctbal > 5000)
SELECT rn, name AS business_name, email, city_name AS city FROM r WHERE nation % 2 = 0""")
def export_rows(spark, d):
    """Rows keep their number in the whole export when only fresh ones are taken.

    Numbers come from a range partitioned sort, so they need no single task.
    """
    rows = joins.not_suppressed(lead_rows(spark, d).where("email IS NOT NULL AND acctbal > 5000"), F.col("email"), suppression_rows(spark, d))
    return row_numbers(rows, [F.col("acctbal").desc(), F.col("name"), F.col("id")], "rn").where("nation % 2 = 0").select("rn", F.col("name").alias("business_name"), "email", F.col("city_name").alias("city"))


def row_numbers(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Global row numbers by a total order: ranks within ranges, plus the rows of the ranges before."""
    from terrane.session import checkpointed

    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return numbered.join(joins.small(before), F.col("__range") == F.col("__r")).withColumn(name, F.col("__n") + F.col("__before")).drop("__range", "__r", "__n", "__before")


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(t, '[",\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM (
 SELECT p_partkey, CASE WHEN regexp_matches(s, '^[=+\-@\t\r]') AND NOT regexp_matches(s, '^\+[1-9][0-9]{6,14}$') THEN '''' || s ELSE s END AS t FROM (
 SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' || p_name WHEN 1 THEN '+3579912' || p_partkey WHEN 2 THEN p_name || ', "' || p_brand || '"' WHEN 3 THEN '-' || p_size ELSE p_name END AS s FROM part))""")
def export_csv_cells(spark, d):
    """Protection against formulas and quoting."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("="), n)).when(k == 1, F.concat(F.lit("+3579912"), "p_partkey")).when(k == 2, F.concat(n, F.lit(', "'), "p_brand", F.lit('"'))).when(k == 3, F.concat(F.lit("-"), "p_size")).otherwise(n)
    return table(spark, d, "part").select("p_partkey", sinks.csv_cell(text).alias("cell"))


@query("""SELECT p_partkey, 'Cyprus' || ' | ' || p_type || ';' || p_brand || ' | ' || 'google_places' || CASE WHEN p_size > 25 THEN ' | extra_emails=a@x.com;b@y.com' ELSE '' END AS notes FROM part""")
def export_profile_notes(spark, d):
    """S20."""
    rows = table(spark, d, "part").select("p_partkey", F.lit("cy").alias("country_code"), F.array("p_type", "p_brand").alias("subcategories"), F.array(F.lit("google_places")).alias("sources"), F.when(F.col("p_size") > 25, F.array(F.lit("a@x.com"), F.lit("b@y.com"))).alias("extra_emails"))
    return rows.select("p_partkey", sinks.mailer_notes().alias("notes"))


@query("""WITH cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day),
 c AS (SELECT CAST(timezone('Asia/Nicosia', timezone('UTC', ts)) AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)
SELECT day, coalesce(n, 0) AS n FROM cal LEFT JOIN c ON d = day""")
def activity_calendar(spark, d):
    """Events of each local day."""
    return reports.activity(joins.calendar("2024-01-01", "2024-02-05", spark), table(spark, d, "events").select("ts"))


@query("SELECT strftime(timezone('Asia/Nicosia', timezone('UTC', o_orderdate)), '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1")
def local_month_rollup(spark, d):
    """Billing months in a time zone."""
    period = F.date_format(F.from_utc_timestamp("o_orderdate", "Asia/Nicosia"), "yyyy-MM")
    return table(spark, d, "orders").groupBy(period.alias("period")).agg(F.count("*").alias("n"))


@query("""SELECT 'status' AS kind, o_orderstatus AS what, CAST(o_orderkey AS VARCHAR) AS ref FROM orders WHERE o_custkey = 7
 UNION ALL SELECT 'ship', l_returnflag, CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)""")
def history_union(spark, d):
    """U01."""
    o = table(spark, d, "orders").where("o_custkey = 7")
    a = o.select(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("what"), F.col("o_orderkey").cast("string").alias("ref"))
    li = table(spark, d, "lineitem").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return a.unionByName(li.select(F.lit("ship").alias("kind"), F.col("l_returnflag").alias("what"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref")))


@query("""SELECT s_suppkey AS id, 'no_customer_nation' AS gap FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)
 UNION ALL SELECT c_custkey, 'no_supplier_nation' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def coverage_check(spark, d):
    """What is missing in either direction."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a = joins.anti_join_any(s, c.where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000"), [(F.col("s_nationkey"), F.col("c_nationkey"))]).select(F.col("s_suppkey").alias("id"), F.lit("no_customer_nation").alias("gap"))
    b = joins.anti_join_any(c, s.where("s_acctbal > 5000"), [(F.col("c_nationkey"), F.col("s_nationkey"))]).select(F.col("c_custkey").alias("id"), F.lit("no_supplier_nation").alias("gap"))
    return a.unionByName(b)


@query("""SELECT c_custkey AS id, (c_acctbal IS DISTINCT FROM s_acctbal) AS differs, coalesce(s_acctbal > 0, true) AS not_false FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def three_valued(spark, d):
    """F13."""
    j = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    return j.select(F.col("c_custkey").alias("id"), (~F.col("c_acctbal").eqNullSafe(F.col("s_acctbal"))).alias("differs"), F.coalesce(F.col("s_acctbal") > 0, F.lit(True)).alias("not_false"))


@query("""SELECT c_custkey AS id, o.last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_totalprice > 150000 GROUP BY 1) o ON o_custkey = c_custkey ORDER BY o.last ASC NULLS FIRST, c_custkey LIMIT 25""")
def nulls_first_queue(spark, d):
    """A queue with the never handled first."""
    g = table(spark, d, "orders").where("o_totalprice > 150000").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    j = table(spark, d, "customer").join(g, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(F.col("c_custkey").alias("id"), "last").orderBy(F.col("last").asc_nulls_first(), "id").limit(25)


@query("""SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey""")
def distinct_on(spark, d):
    """W01."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.first_of(rows, ["o_custkey"], [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")]).drop("o_orderdate")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 10""")
def cap_per_key(spark, d):
    """The first ten of each key."""
    return joins.ranked(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).where("rn <= 10").select("o_custkey", "o_orderkey", "rn")


@query("""SELECT id, verdict, minimum, estimated, maximum_without_splits, pages FROM (SELECT o_custkey AS id, count(*) AS minimum, CAST(ceil(count(*) * p) AS BIGINT) AS estimated, count(*) * 3 AS maximum_without_splits, floor(p * 100 + 0.5) / 100 AS pages,
 CASE WHEN count(*) * 3 <= free THEN 'FITS' WHEN ceil(count(*) * p) <= free THEN 'MAY_NOT_FIT' ELSE 'DOES_NOT_FIT' END AS verdict
 FROM (SELECT o_custkey, least(greatest(coalesce(CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 9) / 2.0 END, 2.0), 1.0), 3.0) AS p, o_custkey % 40 AS free FROM orders) GROUP BY o_custkey, p, free)""")
def cost_estimate(spark, d):
    """A13."""
    jobs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("tasks_to_run"))
    jobs = jobs.select("*", F.when(F.col("id") % 3 > 0, (F.col("id") % 9) / 2.0).alias("average_pages"), (F.col("id") % 40).alias("free_remaining"))
    return reports.estimate_cost(jobs).select("id", "minimum", "estimated", "maximum_without_splits", "pages", "verdict")


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN n_chars < 50 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN text LIKE '%|%' THEN 'table' ELSE 'kept' END AS outcome FROM documents) GROUP BY 1""")
def scan_drop_reasons(spark, d):
    """The first reason that drops a row counts."""
    rows = table(spark, d, "documents").select("n_chars", "lang", "text")
    return reports.drop_reasons(rows, [("short", F.col("n_chars") < 50), ("language", F.col("lang") != "en"), ("table", F.contains("text", F.lit("|")))])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-03' AND o_orderdate < TIMESTAMP '1998-03-01'")
def freshness_filter(spark, d):
    """A cutoff some months back, days beyond a month's end rolling over."""
    from terrane.functions.geo import refreshed_cutoff

    cutoff = refreshed_cutoff(12, "1998-02-31"[:8] + "28")
    assert refreshed_cutoff(1, "2023-03-31") == "2023-03-03" and cutoff == "1997-02-28"
    return table(spark, d, "orders").where((F.col("o_orderdate") >= F.to_timestamp(F.lit(refreshed_cutoff(1, "1997-03-31")))) & (F.col("o_orderdate") < F.to_timestamp(F.lit("1998-03-01")))).select("o_orderkey")
