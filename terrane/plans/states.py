"""Queries on state changes, as-of joins, quotas, streaks, alerts and the lead pipeline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import joins, reports, state
from terrane.plans.registry import Registry
from terrane.session import table

query = Registry()


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS name, o_totalprice AS rating, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS site, CASE WHEN o_custkey % 3 > 0 THEN 'd' || o_custkey % 9 END AS dom FROM orders WHERE o_orderstatus <> 'F'),
 n AS (SELECT o_orderkey AS k, 'new' AS name, o_totalprice + 1 AS rating, CASE WHEN o_custkey % 2 = 0 THEN 'site' END AS site, NULL AS dom FROM orders WHERE o_orderstatus <> 'O')
 SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.rating, o.rating) AS rating, coalesce(n.site, o.site) AS site, CASE WHEN n.site IS NOT NULL THEN n.dom ELSE o.dom END AS dom, o.k IS NULL AS inserted FROM o FULL JOIN n ON o.k = n.k""")
def upsert_state(spark, d):
    """New values win, sites are kept where the new row has none, the domain follows a new site."""
    o = table(spark, d, "orders")
    site = F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority"))
    old = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("rating"), site.alias("site"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("d"), F.col("o_custkey") % 9)).alias("dom"))
    new = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("name"), (F.col("o_totalprice") + 1).alias("rating"), F.when(F.col("o_custkey") % 2 == 0, F.lit("site")).alias("site"), F.lit(None).cast("string").alias("dom"))
    return state.upsert(old, new, "k", keep_if_null=("site",), together={"dom": "site"}).withColumnRenamed("__inserted", "inserted")


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'g' END AS gid, o_orderstatus AS name, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS phone FROM orders WHERE o_orderpriority <> '1-URGENT'),
 n AS (SELECT o_orderkey AS k, 'overture' AS name, 'p' AS phone FROM orders WHERE o_orderpriority <> '5-LOW')
 SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.name WHEN o.k IS NULL OR o.gid IS NULL THEN n.name ELSE o.name END AS name, coalesce(o.phone, n.phone) AS phone FROM o FULL JOIN n ON o.k = n.k""")
def upsert_precedence(spark, d):
    """A name of the first source stays, other fields are only filled."""
    o = table(spark, d, "orders")
    old = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 2 == 0, F.lit("g")).alias("gid"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).alias("phone"))
    new = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.lit("overture").alias("name"), F.lit("p").alias("phone"))
    own = F.when(F.col("o.gid").isNull(), F.col("n.name")).otherwise(F.col("o.name"))
    return state.upsert(old, new, "k", fill_only=("phone",), overrides={"name": own}).select("k", "name", "phone")


@query("""WITH o AS (SELECT DISTINCT user_id AS email, 1 AS place_id, 2 AS seen_count FROM events WHERE event_type = 'view'), n AS (SELECT user_id AS email, count(*) AS c, min(event_id) AS p FROM events WHERE event_type <> 'view' GROUP BY 1)
 SELECT coalesce(o.email, n.email) AS email, coalesce(o.place_id, n.p) AS place_id, coalesce(o.seen_count, 0) + coalesce(n.c, 0) AS seen_count FROM o FULL JOIN n ON o.email = n.email""")
def insert_or_count(spark, d):
    """M04."""
    e = table(spark, d, "events")
    old = e.where("event_type = 'view'").select(F.col("user_id").alias("email"), F.lit(1).cast("long").alias("place_id"), F.lit(2).cast("long").alias("seen_count"), F.lit(None).cast("timestamp_ntz").alias("last_seen")).distinct()
    seen = e.where("event_type <> 'view'").select(F.col("user_id").alias("email"), F.col("event_id").alias("place_id"), F.col("ts").alias("seen_at"))
    return state.insert_or_count(old, seen).select("email", "place_id", "seen_count")


def _reasons(spark, d, customers):
    pick = lambda key, *words: F.get(F.array(*[F.lit(w) for w in words]), F.col(key) % len(words))
    row = lambda df, key, reason: df.select(F.col(key).cast("string").alias("email_hash"), F.lit("x@y.cy").alias("email_normalized"), F.lit("y.cy").alias("domain"), reason.alias("reason"), F.lit("f").alias("source_file"))
    old = row(table(spark, d, "supplier"), "s_suppkey", pick("s_suppkey", "ERASED", "UNSUBSCRIBED", "BOUNCED", "MANUAL", "EXISTING_VENDOR"))
    new = row(customers, "c_custkey", pick("c_custkey", "UNSUBSCRIBED", "BOUNCED", "MANUAL"))
    return state.import_suppression(old, new).select("email_hash", "reason", "change")


@query("""WITH o AS (SELECT s_suppkey AS h, list_extract(['ERASED', 'UNSUBSCRIBED', 'BOUNCED', 'MANUAL', 'EXISTING_VENDOR'], CAST(s_suppkey % 5 AS INT) + 1) AS reason FROM supplier), n AS (SELECT c_custkey AS h, list_extract(['UNSUBSCRIBED', 'BOUNCED', 'MANUAL'], CAST(c_custkey % 3 AS INT) + 1) AS reason FROM customer),
 r AS (SELECT * FROM (VALUES ('ERASED', 3), ('UNSUBSCRIBED', 2), ('BOUNCED', 1), ('MANUAL', 0), ('EXISTING_VENDOR', 0)) t(reason, k))
 SELECT CAST(coalesce(o.h, n.h) AS VARCHAR) AS email_hash, CASE WHEN o.h IS NULL OR rn.k > ro.k THEN n.reason ELSE o.reason END AS reason, CASE WHEN o.h IS NULL THEN 'inserted' WHEN rn.k > ro.k THEN 'upgraded' ELSE 'kept' END AS change
 FROM o FULL JOIN n ON o.h = n.h LEFT JOIN r ro ON ro.reason = o.reason LEFT JOIN r rn ON rn.reason = n.reason""")
def reason_priority(spark, d):
    """All customers as new rows."""
    return _reasons(spark, d, table(spark, d, "customer"))


@query("""WITH s AS (SELECT c_custkey AS id, list_extract(['NEW', 'EXPORTED', 'CONTACTED', 'REPLIED', 'ONBOARDED', 'REJECTED'], CAST(c_custkey % 6 AS INT) + 1) AS status, CASE WHEN c_custkey % 6 < 5 THEN c_custkey % 6 END AS r FROM customer),
 m AS (SELECT o_custkey AS id, max(2 + o_orderkey % 4) AS t FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
 SELECT s.id, CASE WHEN t > r THEN list_extract(['NEW', 'EXPORTED', 'CONTACTED', 'REPLIED', 'ONBOARDED', 'PRODUCT_ADDED'], CAST(t AS INT) + 1) ELSE status END AS status FROM s LEFT JOIN m ON m.id = s.id""")
def forward_status(spark, d):
    """Statuses only move forward."""
    pick = lambda n, *words: F.get(F.array(*[F.lit(w) for w in words]), n)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), pick(F.col("c_custkey") % 6, "NEW", "EXPORTED", "CONTACTED", "REPLIED", "ONBOARDED", "REJECTED").alias("status"))
    moves = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"), pick(F.col("o_orderkey") % 4, "contacted", "replied", "onboarded", "product_added").alias("status"))
    return state.move_forward(rows, moves).select("id", "status")


@query("""SELECT coalesce(f, t) AS key, CASE WHEN t IS NULL THEN 'create' WHEN f IS NOT NULL AND NOT a THEN 'reactivate' WHEN f IS NULL AND a THEN 'deactivate' ELSE 'none' END AS action
 FROM (SELECT DISTINCT o_custkey AS f FROM orders WHERE o_totalprice > 180000) FULL JOIN (SELECT c_custkey AS t, c_acctbal > 0 AS a FROM customer WHERE c_mktsegment <> 'BUILDING') ON f = t""")
def sync_diff(spark, d):
    """U03."""
    file = table(spark, d, "orders").where("o_totalprice > 180000").select(F.col("o_custkey").alias("key"))
    have = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("active"))
    return state.sync_diff(file, have, "key")


@query("""SELECT o_custkey, arg_min(o_orderkey, ((o_orderstatus = 'O')::INT, (NOT o_totalprice > 100000)::INT, o_orderkey)) AS survivor FROM orders GROUP BY 1""")
def survivor_pick(spark, d):
    """W03."""
    from terrane.operators.dedupe import survivors

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "NEW").otherwise("CONTACTED").alias("status"), (F.col("o_totalprice") > 100000).alias("has_primary_email"))
    return survivors(rows).select(F.col("group_id").alias("o_custkey"), F.col("survivor_id").alias("survivor"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN -1000 WHEN o_orderkey % 7 < 4 THEN 1 ELSE 0 END, -o_orderkey)) AS best FROM orders GROUP BY 1""")
def primary_pick(spark, d):
    """Own domain, personal, mail server; ties to the first found."""
    from terrane.functions.email import primary_rank

    k = F.col("o_orderkey")
    rank = primary_rank(k % 2 == 0, F.when(k % 3 == 0, F.lit("PERSONAL")).otherwise(F.lit("GENERIC")), F.when(k % 7 == 0, F.lit(False)).when(k % 7 < 4, F.lit(True)))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", rank.alias("rank"))
    return joins.first_of(rows, ["o_custkey"], [-F.col("rank"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("best"))


@query("""SELECT o_custkey AS group_id, min(o_orderkey) AS id, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) AS address, max(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END) AS lat_any, arg_max(o_totalprice, (coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END, -1), -o_orderkey)) AS rating FROM orders GROUP BY 1""")
def first_non_null_merge(spark, d):
    """One record for a group, gaps filled in order, the best rated rating."""
    from terrane.operators.dedupe import merged_records

    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    o = table(spark, d, "orders")
    rows = o.select(k.alias("id"), F.col("o_orderstatus").alias("name"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("address"), F.when(k % 4 == 0, F.col("o_totalprice")).alias("lat"), F.lit(0.0).alias("lng"), none.alias("website"), none.alias("website_domain"), none.alias("phone_raw"), none.alias("phone_e164"), F.lit(False).alias("phone_valid"), F.col("o_totalprice").alias("rating"), F.when(k % 5 > 0, k % 5).alias("rating_count"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderdate").alias("last_seen_at"), F.col("o_orderdate").alias("last_crawled_at"))
    low = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("survivor_id"))
    mapping = o.select("o_custkey", k.alias("id")).join(low, "o_custkey").select("id", F.col("o_custkey").alias("group_id"), "survivor_id")
    any_lat = o.groupBy(F.col("o_custkey").alias("g")).agg(F.max(F.when(k % 4 == 0, F.col("o_totalprice"))).alias("lat_any"))
    return merged_records(rows, mapping).join(any_lat, F.col("group_id") == F.col("g")).select("group_id", "id", "address", "lat_any", "rating")


@query("""WITH s AS (SELECT event_type AS key, date_trunc('hour', ts) AS taken_at, CAST(max(event_id) AS BIGINT) AS value FROM events GROUP BY 1, 2), m AS (SELECT DISTINCT event_type AS key, date_trunc('day', ts) AS at FROM events)
 SELECT m.key, m.at, max(s.taken_at) AS taken_at, arg_max(s.value, s.taken_at) AS value FROM m LEFT JOIN s ON s.key = m.key AND s.taken_at BETWEEN m.at - INTERVAL 36 HOUR AND m.at - INTERVAL 24 HOUR GROUP BY 1, 2""")
def asof_tolerance(spark, d):
    """Snapshots of all events."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    snaps = e.groupBy(F.col("event_type").alias("key"), F.date_trunc("hour", "ts").alias("taken_at")).agg(F.max("event_id").alias("value"))
    moments = e.select(F.col("event_type").alias("key"), F.date_trunc("day", "ts").alias("at")).distinct()
    out = joins.snapshot_ago(moments, snaps, 24)
    return out.select("key", F.col("at").cast("timestamp_ntz").alias("at"), F.col("taken_at").cast("timestamp_ntz").alias("taken_at"), "value")


@query("""WITH j AS (SELECT user_id AS job, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) SELECT job, count(*) AS hits FROM j JOIN events e ON e.user_id % 50 = j.job % 49 AND e.ts BETWEEN a AND b GROUP BY 1""")
def interval_hits(spark, d):
    """All users as jobs; rows up to a run's end less those before its start, counted by key and hour, so no run meets its rows."""
    e = table(spark, d, "events").where("ts IS NOT NULL")
    j = e.where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    none = F.lit(None).cast("long")
    # A start comes before the rows of its moment, an end after them.
    point = lambda at, place, sign: j.select((F.col("job") % 49).alias("m"), F.col(at).alias("ts"), F.lit(place).alias("place"), F.col("job").cast("long").alias("job"), F.lit(sign).alias("sign"))
    rows = e.where("user_id IS NOT NULL").select((F.col("user_id") % 50).alias("m"), "ts", F.lit(1).alias("place"), none.alias("job"), F.lit(0).alias("sign"))
    points = rows.union(point("a", 0, -1)).union(point("b", 2, 1)).withColumn("hour", F.date_trunc("hour", "ts"))
    is_row = (F.col("place") == 1).cast("long")
    within = points.withColumn("seen", F.sum(is_row).over(Window.partitionBy("m", "hour").orderBy("ts", "place").rowsBetween(Window.unboundedPreceding, 0)))
    hours = points.groupBy("m", "hour").agg(F.sum(is_row).alias("n"))
    earlier = hours.select(F.col("m").alias("m2"), F.col("hour").alias("hour2"), (F.sum("n").over(Window.partitionBy("m").orderBy("hour")) - F.col("n")).alias("earlier"))
    counted = within.where("place <> 1").join(earlier, (F.col("m") == F.col("m2")) & (F.col("hour") == F.col("hour2")))
    return counted.groupBy("job").agg(F.sum(F.col("sign") * (F.col("seen") + F.col("earlier"))).alias("hits")).where("hits > 0")


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT DISTINCT user_id, event_type FROM events e WHERE EXISTS (SELECT 1 FROM events p, n WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.ts >= n.now - INTERVAL 7 DAY)""")
def cooldown(spark, d):
    """Keys with a search within some days."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    recent = e.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).select(F.col("user_id").alias("u"), F.col("event_type").alias("t")).distinct()
    return e.select("user_id", "event_type").distinct().join(recent, (F.col("user_id") == F.col("u")) & (F.col("event_type") == F.col("t")), "left_semi")


@query("""SELECT event_type AS period, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 50 THEN 'free' WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 53 THEN 'paid' ELSE 'denied' END AS "grant" FROM events""")
def quota_running(spark, d):
    """Q-8: the first requests of a period free, then paid within budget and cap."""
    return state.reserve(table(spark, d, "events").select(F.col("event_type").alias("period"), F.col("event_id").alias("seq")), 50, budget=5.0, price=0.035, paid_cap=3)


@query("""WITH l AS (SELECT user_id AS name, max(ts) FILTER (event_type <> 'error') AS ok_at FROM events GROUP BY 1) SELECT name, ok_at, count(event_id) AS errors FROM l LEFT JOIN events ON user_id = name AND event_type = 'error' AND (ok_at IS NULL OR ts > ok_at) GROUP BY 1, 2""")
def failure_streak(spark, d):
    """Q-10."""
    log = table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return state.failure_streaks(log).select("name", "ok_at", "errors")


@query("""WITH c AS (SELECT CAST(n_nationkey AS VARCHAR) AS country, n_nationkey AS k FROM nation) SELECT country, level, code, amount FROM (
 SELECT country, CASE WHEN k >= 10 THEN 'error' ELSE 'warning' END AS level, 'LOOP_FAILING_CRAWL' AS code, CAST(k AS BIGINT) AS amount FROM c WHERE k >= 3
 UNION ALL SELECT country, 'warning', 'CRAWL_STALLED', k FROM c WHERE k % 2 = 0 AND k > 0 AND k % 5 >= 2
 UNION ALL SELECT country, 'error', 'NOTHING_BECAME_READY', 10 + k FROM c WHERE 10 + k >= 20 AND k % 3 <= 0
 UNION ALL SELECT country, 'warning', 'REASON_SPIKE_NO_CATEGORY', 4 * k FROM c WHERE 4 * k >= 50 AND (k % 4 = 0 OR 4.0 * k / (100 * (k % 4)) >= 0.3)
 UNION ALL SELECT country, 'warning', 'MX_CHECKS_STUCK', 90 + k FROM c WHERE k >= 10 AND k % 2 = 1)""")
def alerts(spark, d):
    """Q-11: the five rules over current counts and those of a day and of six hours ago."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("country"), F.col("n_nationkey").alias("k"))
    counts = lambda ready, emails, category, mx: n.select("country", ready.alias("ready"), emails.alias("emails_total"), F.lit(0).alias("exported_total"), F.map_from_arrays(F.array(F.lit("NO_CATEGORY"), F.lit("EMAIL_MX_UNKNOWN")), F.array(category.cast("int"), mx.cast("int"))).alias("reasons"))
    k = F.col("k")
    before = 100 * (k % 4)
    current = counts(k % 3, 110 + k, before + 4 * k, 90 + k)
    day = counts(F.lit(0), F.lit(100), before, F.lit(0) + 90 + k)
    six = counts(F.lit(0), F.lit(100), before, F.when(k % 2 == 1, 90 + k).otherwise(91 + k))
    loops = n.select("country", F.lit("crawl").alias("name"), k.alias("errors"))
    now = F.to_timestamp(F.lit("2024-01-10 12:00:00"))
    sites = n.select("country", k.alias("waiting"), (now - F.make_interval(hours=k % 5)).alias("last_crawl_at"), (k % 2 == 0).alias("crawling"))
    return reports.alerts(current, day, six, loops, sites, now).select("country", "level", "code", "amount")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 15 MINUTE THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE o_orderstatus END AS status FROM orders")
def stale_leases(spark, d):
    """Q-3."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return state.recover_stale(rows, F.to_timestamp(F.lit("1998-01-01 00:00:00")), 15).select("id", "status")
