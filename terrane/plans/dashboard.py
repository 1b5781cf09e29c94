"""Queries on the dashboard, exportable leads, lead details and merged child rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import dashboard, dedupe, joins, leads, reports
from terrane.plans.registry import Registry
from terrane.plans.relational import suppression_rows
from terrane.session import table

query = Registry()

#: A customer is a place, its orders the addresses, the one of the smallest order the primary one.
ROWS_SQL = """
p AS (SELECT c_custkey AS id, c_name AS name, list_extract(['CY', 'GR', 'MT'], c_nationkey % 3 + 1) AS country_code, CASE c_custkey % 4 WHEN 2 THEN 'EXPORTED' WHEN 3 THEN 'REJECTED' ELSE 'NEW' END AS status,
             CASE c_custkey % 5 WHEN 0 THEN 'CLOSED_TEMPORARILY' WHEN 1 THEN 'CLOSED_PERMANENTLY' ELSE 'OPERATIONAL' END AS business_status, c_custkey % 7 = 0 AS is_chain, c_acctbal < 0 AS held,
             CASE WHEN c_nationkey % 5 > 0 THEN 'city ' || c_nationkey END AS city_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS category,
             'd' || c_custkey % 500 || CASE WHEN c_custkey % 11 = 0 THEN '.example.com' ELSE '.cy' END AS website_domain, TIMESTAMP '1998-07-01 22:30:00' + INTERVAL (c_custkey % 40) DAY AS first_seen_at FROM customer),
e AS (SELECT o_orderkey AS id, o_custkey AS place_id, o_orderkey || '@' || lower(o_orderpriority) AS email, lower(o_orderpriority) AS domain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_primary, o_orderkey % 2 = 0 AS is_own_domain,
             CASE WHEN o_orderkey % 3 = 0 THEN 'GENERIC' ELSE 'PERSONAL' END AS email_type, CASE WHEN o_orderkey % 13 = 0 THEN false WHEN o_orderkey % 13 < 6 THEN true END AS mx_valid,
             CASE o_orderkey % 9 WHEN 0 THEN 'BOUNCED' WHEN 1 THEN 'UNSUBSCRIBED' WHEN 2 THEN 'EXPORTED' ELSE 'NEW' END AS status, CASE WHEN o_orderkey % 9 = 2 THEN o_orderdate END AS exported_at, o_orderdate AS first_seen_at FROM orders),
sup AS (SELECT sha256(s_suppkey || '@1-urgent') AS email_hash, NULL AS domain FROM supplier UNION ALL SELECT NULL, '5-low'),
l AS (SELECT p.*, e.email, e.status AS email_status, e.exported_at, e.email IS NOT NULL AND NOT held AND NOT is_chain AND business_status = 'OPERATIONAL' AND NOT EXISTS (SELECT 1 FROM sup WHERE email_hash = sha256(e.email)) AND NOT EXISTS (SELECT 1 FROM sup WHERE email_hash IS NULL AND sup.domain = e.domain) AS open
      FROM p LEFT JOIN (SELECT * FROM e WHERE is_primary) e ON e.place_id = p.id),
r AS (SELECT * FROM l WHERE open AND status = 'NEW' AND email_status = 'NEW' AND exported_at IS NULL)
"""


def _places(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    domain = F.concat(F.lit("d"), (k % 500).cast("string"), F.when(k % 11 == 0, ".example.com").otherwise(".cy"))
    held = F.when(F.col("c_acctbal") < 0, F.array(F.lit("NO_CATEGORY"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.get(F.array(*[F.lit(c) for c in ("CY", "GR", "MT")]), n % 3).alias("country_code"),
        F.when(k % 4 == 2, "EXPORTED").when(k % 4 == 3, "REJECTED").otherwise("NEW").alias("status"),
        F.when(k % 5 == 0, "CLOSED_TEMPORARILY").when(k % 5 == 1, "CLOSED_PERMANENTLY").otherwise("OPERATIONAL").alias("business_status"),
        (k % 7 == 0).alias("is_chain"),
        held.alias("review_reasons"),
        F.when(n % 5 > 0, F.concat(F.lit("city "), n.cast("string"))).alias("city_name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("category"),
        domain.alias("website"),
        domain.alias("website_domain"),
        (F.to_timestamp(F.lit("1998-07-01 22:30:00")) + F.make_dt_interval(days=(k % 40).cast("int"))).alias("first_seen_at"),
    )


def _emails(spark, d):
    o, k, domain = table(spark, d, "orders"), F.col("o_orderkey"), F.lower("o_orderpriority")
    first = o.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("first"))
    return o.join(first, F.col("o_custkey") == F.col("c")).select(
        k.alias("id"),
        F.col("o_custkey").alias("place_id"),
        F.concat(k.cast("string"), F.lit("@"), domain).alias("email"),
        domain.alias("domain"),
        (k == F.col("first")).alias("is_primary"),
        (k % 2 == 0).alias("is_own_domain"),
        F.when(k % 3 == 0, "GENERIC").otherwise("PERSONAL").alias("email_type"),
        F.when(k % 13 == 0, F.lit(False)).when(k % 13 < 6, F.lit(True)).alias("mx_valid"),
        F.when(k % 9 == 0, "BOUNCED").when(k % 9 == 1, "UNSUBSCRIBED").when(k % 9 == 2, "EXPORTED").otherwise("NEW").alias("status"),
        F.when(k % 9 == 2, F.col("o_orderdate")).alias("exported_at"),
        F.col("o_orderdate").alias("first_seen_at"),
    )


def _leads(spark, d):
    primary = _emails(spark, d).where("is_primary").select("place_id", "email", F.col("status").alias("email_status"), "exported_at")
    return _places(spark, d).join(primary, F.col("id") == F.col("place_id"), "left").drop("place_id")


def _ready(spark, d):
    return leads.ready_leads(_leads(spark, d), suppression_rows(spark, d))


@query(f"WITH {ROWS_SQL} SELECT id, email FROM r")
def export_new(spark, d):
    """Places closed for a time are not exported either."""
    return _ready(spark, d).select("id", "email")


@query(f"WITH {ROWS_SQL} SELECT id, email FROM l WHERE open AND status IN ('NEW', 'EXPORTED') AND email_status IN ('NEW', 'EXPORTED')")
def export_all(spark, d):
    """also what was exported before, but no bounced or unsubscribed addresses."""
    rows = _leads(spark, d)
    return joins.not_suppressed(rows.where(F.col("email").isNotNull() & leads.export_scope("all")), F.col("email"), suppression_rows(spark, d)).select("id", "email")


@query(f"WITH {ROWS_SQL} SELECT country_code, count(*) AS n FROM l WHERE open AND status = 'NEW' AND exported_at IS NULL GROUP BY 1")
def ready_count(spark, d):
    """The count of the health report, whatever the address's state."""
    return leads.ready_leads(_leads(spark, d), suppression_rows(spark, d), status_of_email=False).groupBy("country_code").agg(F.count("*").alias("n"))


@query(f"""WITH {ROWS_SQL}, h AS (SELECT *, id IN (SELECT place_id FROM e) AS has FROM p)
SELECT country_code, count(*) AS total, count(*) FILTER (WHERE has) AS with_email, count(*) FILTER (WHERE has AND held AND status = 'NEW') AS needs_review, count(*) FILTER (WHERE has AND is_chain AND status = 'NEW') AS chains,
       count(*) FILTER (WHERE business_status <> 'OPERATIONAL') AS closed, (SELECT count(*) FROM r WHERE r.country_code = h.country_code) AS ready FROM h GROUP BY 1""")
def dashboard_leads(spark, d):
    """P09."""
    return dashboard.lead_counts(_places(spark, d), _emails(spark, d), _ready(spark, d))


@query(f"WITH {ROWS_SQL} SELECT country_code, status, count(*) AS n FROM p WHERE id IN (SELECT place_id FROM e) GROUP BY 1, 2")
def dashboard_status(spark, d):
    """P09."""
    return dashboard.status_counts(_places(spark, d), _emails(spark, d))


@query(f"""WITH {ROWS_SQL} SELECT p.country_code, count(*) AS total, count(*) FILTER (WHERE email_type = 'GENERIC') AS generic, count(*) FILTER (WHERE email_type = 'PERSONAL') AS personal, count(*) FILTER (WHERE is_own_domain) AS own_domain,
 count(*) FILTER (WHERE domain IN ('5-low', '2-high')) AS free_mail, count(*) FILTER (WHERE mx_valid = false) AS no_mail_server, count(*) FILTER (WHERE e.status = 'BOUNCED') AS bounced, count(*) FILTER (WHERE e.status = 'UNSUBSCRIBED') AS unsubscribed,
 count(*) FILTER (WHERE exported_at IS NOT NULL) AS exported, count(*) FILTER (WHERE e.first_seen_at >= TIMESTAMP '1998-01-01') AS new_this_month FROM e JOIN p ON p.id = e.place_id GROUP BY 1""")
def dashboard_emails(spark, d):
    """P09."""
    free = spark.createDataFrame([("5-low",), ("2-high",), ("2-high",)], "domain string")
    return dashboard.email_counts(_places(spark, d), _emails(spark, d), free, F.lit("1998-01-01").cast("timestamp_ntz"))


@query(f"""WITH {ROWS_SQL}, site AS (SELECT * FROM p WHERE website_domain NOT LIKE '%.example.com'), own AS (SELECT DISTINCT country_code, website_domain, CAST(regexp_extract(website_domain, '[0-9]+') AS INT) AS n FROM site WHERE status <> 'REJECTED'),
c AS (SELECT 1)
SELECT country_code, (SELECT count(*) FROM site WHERE site.country_code = own.country_code) AS with_website, count(*) FILTER (WHERE n % 4 > 0) AS crawled, count(*) FILTER (WHERE n % 3 > 0) AS email_found,
       count(*) FILTER (WHERE n % 4 = 1 AND n % 3 = 0 AND n % 10 > 0) AS no_email_found, count(*) FILTER (WHERE n % 4 = 2) AS failed, count(*) FILTER (WHERE n % 10 = 0) AS robots_blocked FROM own GROUP BY 1""")
def dashboard_websites(spark, d):
    """P09."""
    sites, n = _places(spark, d).where("website_domain NOT LIKE '%.example.com'").select("website_domain").distinct(), F.regexp_extract("website_domain", "[0-9]+", 0).cast("int")
    crawls = sites.select(F.col("website_domain").alias("domain"), F.when(n % 4 == 0, "RUNNING").when(n % 4 == 1, "DONE").otherwise(F.when(n % 4 == 2, "FAILED").otherwise("SKIPPED")).alias("status"), F.when(n % 4 > 0, F.lit("1998-01-01")).alias("crawled_at"), (n % 3).alias("emails_found"), (n % 10 == 0).alias("robots_blocked"))
    return dashboard.website_counts(_places(spark, d), crawls)


@query("""WITH b AS (SELECT o_custkey AS id, count(*) AS row_count, max(o_orderdate) AS created_at, CASE WHEN o_custkey % 3 = 0 THEN 'UNDONE' ELSE 'ACTIVE' END AS status FROM orders GROUP BY o_custkey)
SELECT count(*) FILTER (WHERE status = 'ACTIVE') AS batches, CAST(sum(row_count) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS rows, CAST(sum(row_count) FILTER (WHERE status = 'ACTIVE' AND created_at >= TIMESTAMP '1998-01-01') AS BIGINT) AS rows_this_month, max(created_at) FILTER (WHERE status = 'ACTIVE') AS last_export_at FROM b""")
def dashboard_exports(spark, d):
    """P09."""
    return dashboard.export_totals(_batches(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"))


def _batches(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("row_count"), F.max("o_orderdate").alias("created_at"), F.max(F.when(F.col("o_custkey") % 3 == 0, "UNDONE").otherwise("ACTIVE")).alias("status"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS requests, count(*) FILTER (WHERE o_totalprice > 100000) AS paid FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 1 DESC LIMIT 6")
def dashboard_usage(spark, d):
    """A top-k report, the last six months."""
    usage = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("provider"), F.lit("search").alias("sku"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("request_count"), F.count_if(F.col("o_totalprice") > 100000).alias("paid_count"))
    return dashboard.usage_months(usage, "O", "search")


TOP_SQL = """SELECT country_code, name, with_email, ready, rank FROM (SELECT country_code, coalesce({0}, '{1}') AS name, count(*) AS with_email, count(*) FILTER (WHERE id IN (SELECT id FROM r)) AS ready,
 row_number() OVER (PARTITION BY country_code ORDER BY count(*) DESC, coalesce({0}, '{1}')) AS rank FROM l WHERE email IS NOT NULL GROUP BY 1, 2) WHERE rank <= {2}"""


@query(f"WITH {ROWS_SQL} {TOP_SQL.format('city_name', 'Unknown', 5)}")
def dashboard_cities(spark, d):
    """The five largest of each country."""
    return dashboard.top_groups(_leads(spark, d), _ready(spark, d), "city_name", "Unknown", 5)


@query(f"WITH {ROWS_SQL} {TOP_SQL.format('category', 'No category', 10)}")
def dashboard_categories(spark, d):
    """P09."""
    return dashboard.top_groups(_leads(spark, d), _ready(spark, d), "category", "No category")


@query(f"""WITH {ROWS_SQL}, b AS (SELECT count(*) AS row_count, max(o_orderdate) AS created_at FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey), cy AS (SELECT * FROM p WHERE country_code = 'CY'), days AS (SELECT CAST(unnest(generate_series(DATE '1998-07-01', DATE '1998-07-30', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, (SELECT count(*) FROM cy WHERE CAST(first_seen_at + INTERVAL 3 HOUR AS DATE) = day) AS new_places, (SELECT count(*) FROM e JOIN cy ON cy.id = e.place_id WHERE CAST(e.first_seen_at + INTERVAL 3 HOUR AS DATE) = day) AS new_emails,
       (SELECT CAST(coalesce(sum(row_count), 0) AS BIGINT) FROM b WHERE CAST(created_at + INTERVAL 3 HOUR AS DATE) = day) AS exported FROM days""")
def dashboard_activity(spark, d):
    """A month of local days (three hours ahead in summer)."""
    days = joins.calendar("1998-07-01", "1998-07-30", spark)
    return dashboard.daily_activity(days, _places(spark, d).where("country_code = 'CY'"), _emails(spark, d), _batches(spark, d))


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'BOUNCED' ELSE 'MANUAL' END AS reason, count(*) AS n FROM supplier GROUP BY 1")
def dashboard_suppression(spark, d):
    """P09."""
    return reports.counts_by(table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "BOUNCED").otherwise("MANUAL").alias("reason")), "reason")


@query(f"""WITH {ROWS_SQL}, h AS (SELECT l_partkey % 1000 + 1 AS place_id, l_shipdate AS day, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
top AS (SELECT place_id, string_agg(k, ',' ORDER BY day DESC, k) AS history FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY day DESC, k) AS n FROM h) WHERE n <= 50 GROUP BY 1)
SELECT id, (SELECT string_agg(email, ',' ORDER BY is_primary DESC, e.id) FROM e WHERE e.place_id = p.id) AS emails, (SELECT string_agg(DISTINCT lower(o_orderstatus), ',' ORDER BY lower(o_orderstatus)) FROM orders WHERE o_custkey = p.id) AS sources,
       (SELECT history FROM top WHERE top.place_id = p.id) AS history, CASE WHEN id % 500 % 2 = 1 AND id % 11 > 0 THEN id % 500 % 3 = 0 END AS sells_online FROM p""")
def lead_details(spark, d):
    """Addresses, sources, history and shop check of each lead."""
    o, n = table(spark, d, "orders"), F.col("id")
    none = F.lit(None).cast("string")
    subs = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_mktsegment").alias("name"), F.lit("c").alias("category"), F.lit(True).alias("is_primary"), none.alias("keyword"), F.lit(1).alias("created_at"))
    sources = o.groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderdate").alias("fetched_at")).select(F.col("o_custkey").alias("place_id"), F.col("o_orderstatus").alias("source"), none.alias("record_id"), "fetched_at")
    i = table(spark, d, "lineitem")
    audit = i.select((F.col("l_partkey") % 1000 + 1).alias("place_id"), F.col("l_shipdate").alias("at"), F.lpad((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), 12, " ").alias("action"), none.alias("details"))
    exports = spark.createDataFrame([], f"place_id long, at {dict(i.dtypes)['l_shipdate']}, batch_id int, file string, undone boolean")
    checks = spark.range(500).select(F.concat(F.lit("d"), n.cast("string"), F.lit(".cy")).alias("domain"), F.when(n % 2 == 0, "RUNNING").otherwise("DONE").alias("status"), (n % 3 == 0).alias("sells_online"), F.array(F.lit("cart")).alias("signals"), none.alias("checked_at"))
    found = dashboard.lead_details(_places(spark, d), _emails(spark, d), subs, sources, audit, exports, checks)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return found.select("id", text(F.col("emails.email")).alias("emails"), text(F.array_sort("sources.source")).alias("sources"), text(F.transform("history.action", lambda x: F.trim(x))).alias("history"), F.col("shop_check.sells_online").alias("sells_online"))


def _mapping(spark, d):
    """Every tenth place and the nine after it are one business; a third of these groups stay apart."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").where((F.col("c_acctbal") > 0) & (k % 10 > 0)).select(k.alias("loser_id"), (F.floor(k / 10) * 10).alias("survivor_id"))


MOVED_SQL = "m AS (SELECT c_custkey AS loser_id, c_custkey // 10 * 10 AS survivor_id FROM customer WHERE c_acctbal > 0 AND c_custkey % 10 > 0)"


@query(f"""WITH {ROWS_SQL}, {MOVED_SQL}, moved AS (SELECT e.*, coalesce(survivor_id, place_id) AS to_id, is_primary AND survivor_id IS NULL AS still FROM e LEFT JOIN m ON loser_id = place_id),
g AS (SELECT to_id, bool_or(still) AS has, arg_max(id, (CASE WHEN is_own_domain THEN 100 ELSE 0 END + CASE WHEN email_type = 'PERSONAL' THEN 10 ELSE 0 END + CASE WHEN mx_valid = false THEN -1000 WHEN mx_valid THEN 1 ELSE 0 END, -id)) AS best FROM moved WHERE to_id IN (SELECT survivor_id FROM m) GROUP BY 1)
SELECT id, moved.to_id AS place_id, still OR coalesce(NOT has AND best = id, false) AS is_primary FROM moved LEFT JOIN g ON g.to_id = moved.to_id""")
def merged_emails(spark, d):
    """Moved addresses are no longer primary; a place without one gets its best."""
    return dedupe.moved_emails(_emails(spark, d), _mapping(spark, d)).select("id", "place_id", "is_primary")


@query(f"""WITH {MOVED_SQL}, s AS (SELECT o_custkey AS place_id, o_orderkey % 5 AS subcategory_id, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), moved AS (SELECT s.*, coalesce(survivor_id, place_id) AS to_id, survivor_id IS NOT NULL AS came FROM s LEFT JOIN m ON loser_id = place_id)
SELECT to_id AS place_id, subcategory_id, arg_min(k, (came, place_id)) AS k, arg_min(k % 2 = 0 AND NOT came, (came, place_id)) AS is_primary FROM moved GROUP BY 1, 2""")
def merged_subcategories(spark, d):
    """The union; a survivor's own row stays."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("place_id"), (F.col("o_orderkey") % 5).alias("subcategory_id")).agg(F.max("o_orderkey").alias("k"))
    return dedupe.united_subcategories(rows.withColumn("is_primary", F.col("k") % 2 == 0), _mapping(spark, d))


@query(f"""WITH {MOVED_SQL} SELECT survivor_id AS entity_id, 'place.merge' AS action, '{{"reasons":["DOMAIN"],"merged":[' || string_agg('{{"id":' || c_custkey || ',"name":"' || c_name || '"}}', ',' ORDER BY c_custkey) || ']}}' AS details FROM m JOIN customer ON c_custkey = loser_id GROUP BY 1""")
def merge_audit(spark, d):
    """One audit row a merge."""
    m = _mapping(spark, d).select(F.col("loser_id").alias("id"), F.col("survivor_id").alias("group_id"), "survivor_id")
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("google_place_id"))
    groups = m.select("group_id").distinct().withColumn("reasons", F.array(F.lit("DOMAIN")))
    return dedupe.merge_audit(places, m, groups)
