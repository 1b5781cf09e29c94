"""Queries on exports, statuses, rechecks, jobs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import services
from terrane.plans.registry import Registry
from terrane.session import table

query = Registry()


def _places(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "EXPORTED").when(k % 3 == 1, "NEW").otherwise("CONTACTED").alias("status"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("exported_at"), F.when(k % 3 == 0, (k % 4).cast("int")).alias("export_batch_id"))


STATUS_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'EXPORTED' WHEN 1 THEN 'NEW' ELSE 'CONTACTED' END"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN 'EXPORTED' ELSE {STATUS_SQL} END AS status, CASE WHEN o_totalprice > 400000 THEN 9 WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS batch FROM orders")
def mark_exported(spark, d):
    """M09."""
    items = table(spark, d, "orders").where("o_totalprice > 400000").select(F.lit(9).alias("batch_id"), F.col("o_orderkey").alias("place_id"))
    return services.mark_exported(_places(spark, d), items, 9, F.to_timestamp(F.lit("2024-01-01")).cast("timestamp_ntz")).select("id", "status", F.col("export_batch_id").alias("batch"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 2 THEN 'NEW' ELSE {STATUS_SQL} END AS status, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 2 THEN o_orderkey % 4 END AS batch FROM orders")
def undo_export(spark, d):
    """M10."""
    return services.undo_export(_places(spark, d), 2).select("id", "status", F.col("export_batch_id").alias("batch"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderkey % 1000 AS row_number FROM orders WHERE month(o_orderdate) = 3")
def redownload(spark, d):
    """M11."""
    items = table(spark, d, "orders").select(F.month("o_orderdate").alias("batch_id"), F.col("o_orderkey").alias("place_id"), (F.col("o_orderkey") % 1000).alias("row_number"))
    return services.redownload(items, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), 3)


@query("""SELECT DISTINCT sha256(o_orderkey || '@x.cy') AS email_hash, 'ERASED' AS reason FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus <> 'F'
 UNION ALL SELECT sha256(o_orderkey || '@x.cy'), 'MANUAL' FROM orders WHERE o_orderstatus = 'F'""")
def erase(spark, d):
    """Hashes of erased addresses stay suppressed, known ones keep their reason."""
    o, null = table(spark, d, "orders"), F.lit(None).cast("string")
    address = F.concat(F.col("o_orderkey").cast("string"), F.lit("@x.cy"))
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("NEW").alias("status"), F.lit("1").alias("phone_raw"), F.lit("+3571").alias("phone_e164"), F.lit(True).alias("phone_valid"))
    emails = o.select(F.col("o_custkey").alias("place_id"), address.alias("email"))
    old = o.where("o_orderstatus = 'F'").select(F.sha2(address, 256).alias("email_hash"), null.alias("email_normalized"), F.lit("x.cy").alias("domain"), F.lit("MANUAL").alias("reason"), F.lit("f").alias("source_file"))
    return services.erase(places, emails, old, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))[2].select("email_hash", "reason")


@query(f"SELECT o_orderkey AS id, {STATUS_SQL} AS old, 'REJECTED' AS new FROM orders WHERE o_orderstatus = 'P'")
def bulk_reject(spark, d):
    """M13."""
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return services.set_status(_places(spark, d), ids, "REJECTED")[1]


@query("""SELECT coalesce(o.k, n.k) AS place_id, CASE WHEN o.s = 'REMOVED' THEN 'REMOVED' ELSE coalesce(n.s, o.s) END AS status FROM (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'REMOVED' ELSE 'PUBLISHED' END AS s FROM orders WHERE o_orderstatus <> 'P') o
 FULL JOIN (SELECT o_orderkey AS k, 'CLAIMED' AS s FROM orders WHERE o_totalprice > 250000) n ON o.k = n.k""")
def page_statuses(spark, d):
    """Removed pages stay removed."""
    o, none = table(spark, d, "orders"), F.lit(None).cast("string")
    old = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("place_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "REMOVED").otherwise("PUBLISHED").alias("status"), none.alias("url"))
    new = o.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("place_id"), F.lit("CLAIMED").alias("status"), none.alias("url"))
    return services.page_statuses(old, new).select("place_id", "status")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 < 3 THEN CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false ELSE true END AS mx_valid FROM customer""")
def recheck_mx(spark, d):
    """Null or long-failed answers are asked again; no answer keeps the old."""
    k, now = F.col("c_custkey"), F.to_timestamp(F.lit("2024-02-01"))
    emails = table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("a@d"), (k % 4).cast("string")).alias("email"), F.when(k % 3 == 1, F.lit(False)).when(k % 3 == 2, F.lit(True)).alias("mx_valid"), F.when(k % 2 == 1, F.to_timestamp(F.lit("2024-01-25"))).alias("mx_checked_at"))
    mx = spark.createDataFrame([("d0", True), ("d1", False), ("d2", None)], "domain string, mx_valid boolean")
    return services.recheck_mx(emails, mx, now).select("id", "mx_valid")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 = 0 OR (o_orderkey % 15 = 0)")
def changed_rows(spark, d):
    """What a recomputation would write."""
    k = F.col("o_orderkey")
    old = table(spark, d, "orders").select(k.alias("k"), F.when(k % 15 != 0, k).alias("a"), F.lit("x").alias("b"))
    new = table(spark, d, "orders").select(k.alias("k"), k.alias("a"), F.when(k % 10 == 0, "y").otherwise("x").alias("b"))
    return services.changed(old, new, "k", ["a", "b"])


@query("""SELECT 'd' || o_custkey % 50 || CASE WHEN o_custkey % 50 = 7 THEN '.example.com' ELSE '.cy' END AS website_domain, min(o_orderkey) AS priority FROM orders
 WHERE o_totalprice <= 350000 AND o_orderstatus <> 'P' AND o_orderkey % 13 > 0 AND o_custkey % 50 <> 7 AND NOT (o_custkey % 50 BETWEEN 10 AND 29 AND o_custkey % 50 NOT IN (12, 14)) GROUP BY 1""")
def due_domains(spark, d):
    """Domains to crawl, without example sites, rejected places, known addresses and fresh crawls; two are looked at again."""
    o, n = table(spark, d, "orders"), F.col("o_custkey") % 50
    domain = lambda x: F.concat(F.lit("d"), x.cast("string"), F.when(x == 7, ".example.com").otherwise(".cy"))
    places = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("NEW").alias("status"), F.when(F.col("o_orderkey") % 13 > 0, domain(n)).alias("website"), domain(n).alias("website_domain"))
    at, x = lambda text: F.to_timestamp(F.lit(text)), F.col("id")
    now = at("2024-01-01 12:00:00")
    state = F.when(x.between(20, 39), "RUNNING").otherwise("DONE")
    retry = F.when(x < 20, at("2024-03-01")).otherwise(at("2023-12-01"))
    started = F.when(x < 30, at("2024-01-01 11:50:00")).otherwise(at("2024-01-01 11:00:00"))
    crawls = spark.range(10, 50).select(domain(x).alias("domain"), state.alias("status"), retry.alias("retry_at"), started.alias("started_at"), F.when(x.isin(12, 13, 14), 0).otherwise(1).alias("emails_found"), F.when(x == 13, now).otherwise(at("2023-06-01")).alias("crawled_at"))
    emails = o.where("o_totalprice > 350000").select(F.col("o_orderkey").alias("place_id"))
    return services.due_domains(places, crawls, emails, now, recheck_before=at("2023-12-31"))


@query("SELECT l_partkey AS email, arg_min(l_orderkey, (l_shipdate, l_linenumber, l_orderkey)) AS place_id FROM lineitem GROUP BY 1")
def first_owner(spark, d):
    """W06."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("email"), F.col("l_shipdate").alias("place_order"), F.struct("l_linenumber", "l_orderkey").alias("email_order"), F.col("l_orderkey").alias("place_id"))
    return services.first_owner(rows)


@query("""SELECT CASE WHEN s IN (0, 5) THEN 'unmapped' WHEN s = 4 THEN 'excluded' ELSE 'mapped' END AS kind, CASE WHEN s IN (0, 5) THEN 'spa' WHEN s = 4 THEN 'junk' WHEN s = 1 THEN '1' WHEN s IN (2, 3) THEN '2' ELSE '4' END AS what, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS with_email FROM (SELECT p_partkey % 7 AS s, p_size FROM part) GROUP BY 1, 2""")
def mapping_report(spark, d):
    """A15."""
    from terrane.plans.matching import RULES

    path = F.get(F.array(*[F.lit(x) for x in ["az > q", "a > x", "a > b", "a > b > d", "a > b > c > d", "zz", ""]]), F.col("p_partkey") % 7)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.filter(F.split(path, " > "), lambda x: x != "").alias("taxonomy_hierarchy"), F.lit("none").alias("basic_category"), F.lit("spa").alias("taxonomy_primary"), (F.col("p_size") > 25).alias("has_email"))
    return services.mapping_report(rows, spark.createDataFrame(RULES, "match string, subcategory_id int, excluded_reason string"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'timeout' WHEN o_orderstatus = 'P' THEN 'dns' ELSE 'ok' END AS code, count(*) AS n, count(*) FILTER (WHERE o_custkey % 3 > 0) AS with_email FROM orders GROUP BY 1")
def crawl_funnel(spark, d):
    """A20."""
    error = F.when(F.col("o_orderstatus") == "F", F.lit("timeout: 10 s: x")).when(F.col("o_orderstatus") == "P", F.lit("dns"))
    return services.crawl_funnel(table(spark, d, "orders").select(error.alias("error"), (F.col("o_custkey") % 3).alias("emails_found")))


JOBS_SQL = """
j AS (SELECT o_orderkey AS id, list_extract(['QUEUED', 'RUNNING', 'PAUSED_USER', 'PAUSED_QUOTA', 'COMPLETED', 'FAILED', 'CANCELLED'], CAST(o_orderkey % 7 AS INT) + 1) AS was,
             list_extract(['start', 'pause', 'resume', 'cancel', 'continue-free'], CAST(o_orderkey % 5 AS INT) + 1) AS asked FROM orders),
t AS (SELECT l_orderkey AS job_id, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'GOOGLE_PLACES' ELSE 'OVERTURE' END AS source, list_extract(['PENDING', 'DEFERRED', 'FAILED', 'DONE'], CAST(l_partkey % 4 AS INT) + 1) AS status FROM lineitem),
a AS (SELECT *, CASE WHEN (asked = 'start' AND was = 'QUEUED') OR (asked = 'pause' AND was = 'RUNNING') OR (asked = 'resume' AND (was IN ('PAUSED_USER', 'PAUSED_QUOTA', 'FAILED') OR (was = 'COMPLETED' AND id IN (SELECT job_id FROM t WHERE source = 'GOOGLE_PLACES' AND status = 'DEFERRED'))))
             OR (asked = 'cancel' AND was NOT IN ('COMPLETED', 'CANCELLED')) OR (asked = 'continue-free' AND was IN ('RUNNING', 'PAUSED_USER', 'PAUSED_QUOTA', 'FAILED')) THEN asked END AS did FROM j),
u AS (SELECT job_id, n, CASE WHEN did IN ('start', 'resume') AND status IN ('DEFERRED', 'FAILED') THEN 'PENDING' WHEN did = 'continue-free' AND source = 'GOOGLE_PLACES' AND status <> 'DONE' THEN 'DEFERRED'
             WHEN did = 'continue-free' AND source <> 'GOOGLE_PLACES' AND status IN ('DEFERRED', 'FAILED') THEN 'PENDING' WHEN did = 'cancel' AND status IN ('PENDING', 'DEFERRED') THEN 'SKIPPED' ELSE status END AS status FROM t LEFT JOIN a ON id = job_id)
"""


def _jobs(spark, d):
    k, pick = F.col("o_orderkey"), lambda n, *words: F.get(F.array(*[F.lit(w) for w in words]), n)
    o = table(spark, d, "orders")
    jobs = o.select(k.alias("id"), pick(k % 7, "QUEUED", "RUNNING", "PAUSED_USER", "PAUSED_QUOTA", "COMPLETED", "FAILED", "CANCELLED").alias("status"))
    actions = o.select(k.alias("job_id"), pick(k % 5, "start", "pause", "resume", "cancel", "continue-free").alias("action"))
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, "GOOGLE_PLACES").otherwise("OVERTURE").alias("source"), pick(F.col("l_partkey") % 4, "PENDING", "DEFERRED", "FAILED", "DONE").alias("status"))
    return services.job_actions(jobs, actions, tasks)


@query(f"""WITH {JOBS_SQL} SELECT id, CASE WHEN did = 'continue-free' AND id NOT IN (SELECT job_id FROM u WHERE status = 'PENDING') THEN 'COMPLETED' WHEN did IN ('start', 'resume', 'continue-free') THEN 'RUNNING' WHEN did = 'pause' THEN 'PAUSED_USER' WHEN did = 'cancel' THEN 'CANCELLED' ELSE was END AS status FROM a""")
def job_actions(spark, d):
    """Q-7: states of jobs after allowed actions."""
    return _jobs(spark, d)[0]


@query(f"WITH {JOBS_SQL} SELECT job_id, n, status FROM u")
def job_task_states(spark, d):
    """Q-7: their tasks put back, deferred or skipped."""
    return _jobs(spark, d)[1].select("job_id", "n", "status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 < 4 THEN 'RUNNING' WHEN o_orderkey % 2 = 0 THEN 'PAUSED_QUOTA' ELSE 'RUNNING' END AS status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 < 4 THEN floor((o_orderkey % 100 * 0.03 + o_orderkey % 5 * 5) * 100 + 0.5) / 100 ELSE 0.0 END AS extra_budget_eur FROM orders""")
def approve_budgets(spark, d):
    """Q-7: extra budgets of jobs that the quota paused, up to the monthly cap."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    jobs = o.select(k.alias("id"), F.when(k % 2 == 0, "PAUSED_QUOTA").otherwise("RUNNING").alias("status"), (k % 100).alias("paid_requests_used"), F.lit(0.0).alias("extra_budget_eur"))
    return services.approve_budgets(jobs, o.select(k.alias("job_id"), (k % 5 * 5.0).alias("extra_eur")), 0.03, 15.0).select("id", "status", "extra_budget_eur")


@query("SELECT l_orderkey AS job_id FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def complete_jobs(spark, d):
    """Q-6."""
    return services.complete_jobs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_linestatus") == "F", "DONE").otherwise("PENDING").alias("status")))


@query("""SELECT 'city:' || s_suppkey AS area_key, k AS keyword, 'en' AS language, s_acctbal > 5000 AND k = 'spa' AS in_cooldown FROM supplier, (SELECT unnest(['spa', 'nails']) AS k)""")
def job_tasks(spark, d):
    """Areas with keywords, and those in cooldown."""
    s = table(spark, d, "supplier")
    area = F.concat(F.lit("city:"), F.col("s_suppkey").cast("string"))
    words = spark.createDataFrame([("spa", "en"), ("nails", "en")], "keyword string, language string")
    done = s.where("s_acctbal > 5000").select(F.concat(area, F.lit("/root")).alias("tile_key"), F.lit("spa").alias("keyword"), F.lit("en").alias("language"))
    return services.job_tasks(s.select(area.alias("area_key")), words, done)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)) AS new_domains, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)) AS new_emails FROM orders")
def overlap_report(spark, d):
    """J30."""
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("domain"), F.col("o_orderkey").alias("email"))
    return services.overlap(new, table(spark, d, "supplier").select(F.col("s_suppkey").alias("domain")), table(spark, d, "customer").select(F.col("c_custkey").alias("email")))


@query("SELECT s_suppkey AS id, 'a=1,b=' || CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS settings FROM supplier")
def merged_settings(spark, d):
    """U05."""
    lit = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    new = F.when(F.col("s_suppkey") % 2 == 0, lit("b", "new")).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = services.merge_settings(lit("a", "1", "b", "old", "c", "x"), new, F.array(F.lit("c")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("settings"))


@query("SELECT c_custkey AS id, 'customer' AS name_normalized, c_custkey % 2 = 1 AS name_changed FROM customer")
def renormalised(spark, d):
    """M18."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("Customer Ltd.").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "customer").otherwise("customer ltd").alias("name_normalized"))
    return services.renormalise(rows).select("id", "name_normalized", "name_changed")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def prunable(spark, d):
    """F10."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, F.lit("g")).alias("google_place_id"), none.alias("website_domain"), F.when(k % 4 == 1, "NEW").otherwise("REJECTED").alias("status"), none.alias("exported_at"))
    return services.prunable(rows, table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("place_id"))).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal <= 9000 AND c_nationkey <> 5 AND c_mktsegment <> 'BUILDING'")
def not_removed(spark, d):
    """A removal by any of four keys."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("overture_id"), F.lit(None).cast("string").alias("phone_e164"), F.col("c_mktsegment").alias("website_domain"))
    ids = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("place_id"), *[F.lit(None).cast("string").alias(c) for c in ("overture_id", "phone_e164", "website_domain")])
    more = spark.createDataFrame([(None, "5", None, None), (None, None, "+1", "BUILDING")], "place_id long, overture_id string, phone_e164 string, website_domain string")
    return services.not_removed(rows, ids.union(more)).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey % 3 = 1 AND c_nationkey IN (1, 2, 3, 4, 5) AND c_custkey % 7 <> 0 AND c_custkey % 100 >= 40")
def page_candidates(spark, d):
    """F04."""
    from terrane.operators.datasets import page_scope

    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "CLOSED_PERMANENTLY").otherwise("OPERATIONAL").alias("business_status"), F.when(k % 3 == 0, "REMOVED").when(k % 3 == 2, "PUBLISHED").alias("page_status"), F.col("c_nationkey").cast("string").alias("taxonomy_primary"), (k % 7 == 0).alias("is_chain"), (k % 100).alias("completeness"))
    return rows.where(page_scope(types=("1", "2", "3", "4", "5"), min_completeness=40)).select("id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0 AND (CAST(s_suppkey AS VARCHAR) LIKE '%1%' OR s_nationkey = 7)")
def suppression_search(spark, d):
    """F05."""
    from terrane.operators.datasets import suppression_search as search

    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 2 == 0, "MANUAL").otherwise("BOUNCED").alias("reason"), F.concat(F.lit("Ab_"), k.cast("string"), F.lit("@x.cy")).alias("email_normalized"), F.when(F.col("s_nationkey") == 7, F.lit("1.cy")).alias("domain"), F.sha2(k.cast("string"), 256).alias("email_hash"))
    return rows.where(search("MANUAL", "1")).select("id")


@query("""SELECT c_custkey AS id, 'info@shop.cy' AS email, 'GENERIC' AS email_type, c_custkey % 2 = 0 AS is_own_domain FROM customer UNION ALL SELECT c_custkey, 'anna' || c_custkey || '@gmail.com', 'PERSONAL', false FROM customer""")
def prepared_emails(spark, d):
    """Addresses in normal form, once a place, without junk."""
    from terrane.operators.datasets import prepare_emails

    k = F.col("c_custkey")
    emails = F.array(F.lit(" Info@Shop.cy"), F.concat(F.lit("Anna"), k.cast("string"), F.lit("@gmail.com")), F.lit("mailto:info@shop.cy?x"), F.lit("noreply@shop.cy"), F.lit("no address"))
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, F.lit("shop.cy")).alias("website_domain"), emails.alias("emails"))
    return prepare_emails(rows).select("id", "email", "email_type", "is_own_domain")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'SOCIAL' ELSE 'OWN' END AS platform, count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 <> 1) AS changed, count(*) FILTER (WHERE c_custkey % 2 = 0) AS valid_phones FROM customer GROUP BY 1")
def cleaning_summary(spark, d):
    """What a cleaning changes."""
    from terrane.operators import datasets

    k = F.col("c_custkey")
    site = F.when(k % 3 == 0, F.lit("https://facebook.com/x?fbclid=1")).when(k % 3 == 1, F.lit("https://shop.cy/")).otherwise(F.lit("shop.cy"))
    raw = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), site.alias("website"), F.when(k % 2 == 0, "99123456").otherwise("12").alias("phone"), F.lit("CY").alias("country_code"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    return datasets.cleaning_summary(raw, datasets.normalize_places(raw))
