"""Queries on mechanisms: counters of a scan, row groups, commits of several tables, ids of trees, recursion, documents, locale order, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import numbering, urls
from terrane.operators import documents, trees
from terrane.plans.registry import Registry
from terrane.session import shared_folder, table
from terrane.sources import scans, snapshots
from terrane.streaming import state

query = Registry()


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("""SELECT count(*) AS read, count(*) FILTER (WHERE r = 'kept') AS kept, count(*) FILTER (WHERE r = 'closed') AS closed, count(*) FILTER (WHERE r = 'low_value') AS low_value,
  count(*) FILTER (WHERE r = 'old') AS old, count(*) FILTER (WHERE r = 'kept' AND o_orderpriority = '1-URGENT') AS urgent, (SELECT round(sum(o_totalprice) FILTER (WHERE r = 'kept'), 2) FROM x) AS written
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice < 50000 THEN 'low_value' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'old' ELSE 'kept' END AS r FROM orders) x""".replace("(SELECT round(sum(o_totalprice) FILTER (WHERE r = 'kept'), 2) FROM x)", "round(sum(o_totalprice) FILTER (WHERE r = 'kept'), 2)"))
def observed_scan(spark, d):
    """Rows read, kept and dropped by reason, counted by the job that writes the kept ones; an import log around it."""
    reason = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_totalprice") < 50000, "low_value").when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "old").otherwise(scans.KEPT)
    path, log = _scratch(spark, "scan"), scans.ImportLog(_scratch(spark, "imports"))
    write = lambda kept: kept.write.parquet(path)
    log.run(spark, "orders", "ALL", "r1", lambda: scans.import_scan(table(spark, d, "orders"), reason, ("closed", "low_value", "old"), write, {"urgent": F.col("o_orderpriority") == "1-URGENT"}))
    names = ("read", "kept", "closed", "low_value", "old", "urgent")
    stats = F.from_json("stats", ", ".join(f"{n} long" for n in names))
    done = scans.last_import(log.states(spark)).select(stats.alias("s")).select("s.*")
    return done.crossJoin(F.broadcast(spark.read.parquet(path).agg(F.round(F.sum("o_totalprice"), 2).alias("written"))))


@query()
def row_groups_read(spark, d):
    """Row groups that a range of keys can touch, by the statistics in the footers."""
    lines = table(spark, d, "lineitem")
    top = lines.agg(F.max("l_orderkey")).first()[0] or 0
    groups = scans.row_groups(lines, "l_orderkey", "l_returnflag")
    test = ~F.coalesce((F.col("l_orderkey_min") > top / 10) | (F.col("l_orderkey_max") < 0), F.lit(False)) & scans.may_hold("l_returnflag", "R")
    return scans.group_report(groups, test)


@query("""SELECT o_orderstatus AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM orders) AS n_before, 2 AS version
FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_totalprice > 100000) GROUP BY 1""")
def snapshot_commit(spark, d):
    """A commit that replaces one part of a table, removes another and leaves the third, beside the version before."""
    orders = table(spark, d, "orders")
    store = snapshots.Store(spark, _scratch(spark, "store"))
    by = {s: orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    first = store.commit({"orders": by}, 0)
    version = store.commit({"orders": {"F": by["F"].where("o_totalprice > 100000"), "P": None}, "audit": {"all": spark.range(1)}}, first)
    before = store.read("orders", first).agg(F.count("*").alias("n_before"))
    now = store.read("orders").groupBy(F.col("o_orderstatus").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return now.crossJoin(F.broadcast(before)).withColumn("version", F.lit(version))


_TREE_SQL = """WITH old AS (SELECT r_regionkey + 1 AS id, r_regionkey + 1 AS g, NULL AS p, 'COUNTRY' AS type, r_name AS name, true AS active FROM region
    UNION ALL SELECT n_nationkey + 101, n_nationkey + 101, n_regionkey + 1, 'REGION', lower(n_name), n_regionkey <> 1 FROM nation WHERE n_regionkey IN (0, 1)),
  new AS (SELECT r_regionkey + 1 AS g, NULL AS pg, 'COUNTRY' AS type, r_name AS name, 1 AS level FROM region UNION ALL SELECT n_nationkey + 101, n_regionkey + 1, 'REGION', n_name, 2 FROM nation
    UNION ALL SELECT s_suppkey + 1001, s_nationkey + 101, 'CITY', s_name, 3 FROM supplier),
  fresh AS (SELECT g, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY level, g) AS id FROM new WHERE g NOT IN (SELECT g FROM old)),
  ids AS (SELECT g, id FROM fresh UNION ALL SELECT g, id FROM old)
SELECT CAST(i.id AS BIGINT) AS id, n.g AS geonames_id, CAST(p.id AS BIGINT) AS parent_id, n.type, n.name, coalesce(o.active, true) AS active,
  CASE WHEN o.g IS NULL THEN 'inserted' WHEN o.name = n.name THEN 'same' ELSE 'updated' END AS change
FROM new n JOIN ids i ON i.g = n.g LEFT JOIN ids p ON p.g = n.pg LEFT JOIN old o ON o.g = n.g"""


@query(_TREE_SQL)
def tree_ids(spark, d):
    """A tree of regions, nations and suppliers merged into a snapshot that has a part of it; ids and active stay."""
    regions, nations, suppliers = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    shape = ["id", "geonames_id", "parent_id", "type", "name", "active"]
    top = regions.select((F.col("r_regionkey") + 1).cast("long").alias("id"), (F.col("r_regionkey") + 1).cast("long").alias("geonames_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("COUNTRY").alias("type"), F.col("r_name").alias("name"), F.lit(True).alias("active"))
    some = nations.where(F.col("n_regionkey").isin(0, 1)).select((F.col("n_nationkey") + 101).cast("long").alias("id"), (F.col("n_nationkey") + 101).cast("long").alias("geonames_id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.lit("REGION").alias("type"), F.lower("n_name").alias("name"), (F.col("n_regionkey") != 1).alias("active"))
    drafts = top.select("geonames_id", F.col("parent_id").alias("parent_geonames_id"), "type", "name")
    drafts = drafts.union(nations.select((F.col("n_nationkey") + 101).cast("long"), (F.col("n_regionkey") + 1).cast("long"), F.lit("REGION"), "n_name"))
    drafts = drafts.union(suppliers.select((F.col("s_suppkey") + 1001).cast("long"), (F.col("s_nationkey") + 101).cast("long"), F.lit("CITY"), "s_name"))
    return trees.upsert_tree(top.union(some).select(shape), drafts)


@query("""WITH RECURSIVE n AS (SELECT 'n' || n_nationkey AS id, NULL AS parent_id, 'REGION' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'REGION' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'CITY' FROM orders),
r AS (SELECT DISTINCT 'n' || s_nationkey AS id FROM supplier WHERE s_acctbal < 0 UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000),
w AS (SELECT n.id, n.type FROM n JOIN r ON n.id = r.id UNION SELECT n.id, n.type FROM w JOIN n ON n.parent_id = w.id)
SELECT id FROM w WHERE type = 'CITY'""")
def tree_walk(spark, d):
    """Leaves below several roots, some below others, in one recursive plan."""
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    nations, customers, orders = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    nodes = nations.select(name("n", "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("REGION").alias("type"))
    nodes = nodes.union(customers.select(name("c", "c_custkey"), name("n", "c_nationkey"), F.lit("REGION"))).union(orders.select(name("o", "o_orderkey"), name("c", "o_custkey"), F.lit("CITY")))
    roots = table(spark, d, "supplier").where("s_acctbal < 0").select(name("n", "s_nationkey").alias("id")).union(customers.where("c_acctbal > 9000").select(name("c", "c_custkey")))
    return trees.leaves_below(nodes, roots)


@query("""WITH x AS (SELECT event_id, unnest([props, '{"k": null, "n": {"t": "' || event_type || '"}}', '{"n": {"t": 7}, "k": "x"}']) AS j FROM events)
SELECT event_id, CASE WHEN json_type(j, '$.k') = 'UBIGINT' THEN CAST(j->>'$.k' AS INT) END AS k, CASE WHEN json_exists(j, '$.n.t') THEN j->>'$.n.t' END AS t,
  CASE WHEN json_type(j, '$.k') IS NULL THEN 'missing' WHEN json_type(j, '$.k') = 'NULL' THEN 'null' ELSE 'value' END AS k_state,
  CASE WHEN json_type(j, '$.n') IS NULL THEN 'missing' WHEN json_type(j, '$.n') = 'NULL' THEN 'null' ELSE 'value' END AS n_state FROM x""")
def json_records(spark, d):
    """Rows out of an array of JSON records; missing keys, nulls and values of another type told apart."""
    e = table(spark, d, "events")
    second = F.concat(F.lit('{"k": null, "n": {"t": "'), F.col("event_type"), F.lit('"}}'))
    text = F.concat(F.lit("["), F.col("props"), F.lit(", "), second, F.lit(', {"n": {"t": 7}, "k": "x"}]'))
    rows = documents.records(e.select("event_id", text.alias("j")), "j", {"k": "$.k int", "t": "$.n.t string", "whole": "$ variant"}, ("event_id",))
    return rows.select("event_id", "k", "t", documents.value_state(F.col("whole"), "$.k").alias("k_state"), documents.value_state(F.col("whole"), "$.n").alias("n_state"))


@query("""WITH x AS (SELECT event_id, event_type, CAST(props->>'$.k' AS INT) AS k FROM events),
r AS (SELECT event_id, 'k' AS path, 'changed' AS change, CAST(k AS VARCHAR) AS old, CAST(k + 1 AS VARCHAR) AS new FROM x WHERE event_type = 'click'
  UNION ALL SELECT event_id, 'n.t', 'changed', '"' || event_type || '"', 'null' FROM x WHERE event_type = 'view'
  UNION ALL SELECT event_id, 'n.gone', 'removed', '[1,2]', NULL FROM x UNION ALL SELECT event_id, 'n.deep.more', 'added', NULL, 'true' FROM x WHERE k > 50
  UNION ALL SELECT event_id, 'n.deep', 'added', NULL, '{}' FROM x WHERE k <= 50)
SELECT event_id AS key, path, change, old, new FROM r""")
def settings_diff(spark, d):
    """What differs between two versions of nested settings, down to single values."""
    e = table(spark, d, "events").withColumn("k", F.try_variant_get(F.parse_json("props"), "$.k", "int"))
    old = F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit(', "n": {"t": "'), F.col("event_type"), F.lit('", "gone": [1, 2]}}'))
    k = F.when(F.col("event_type") == "click", F.col("k") + 1).otherwise(F.col("k")).cast("string")
    t = F.when(F.col("event_type") == "view", F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    deep = F.when(F.col("k") > 50, F.lit('{"more": true}')).otherwise(F.lit("{}"))
    new = F.concat(F.lit('{"n": {"deep": '), deep, F.lit(', "t": '), t, F.lit('}, "k": '), k, F.lit("}"))
    return documents.differences(e.select("event_id", old.alias("j")), e.select("event_id", new.alias("j")), "event_id", "j")


LETTERS = ("0123456789", "àÉéeΩωάzZñ")


@query(f"""SELECT c_custkey AS id, name, rank FROM (SELECT c_custkey, translate(substr(c_name, 10), '{LETTERS[0]}', '{LETTERS[1]}') AS name,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY translate(substr(c_name, 10), '{LETTERS[0]}', '{LETTERS[1]}') COLLATE en, c_custkey) AS rank FROM customer) WHERE rank <= 5""")
def locale_order(spark, d):
    """Names in the order of a locale: accents and case decide only between equal letters, Greek follows Latin."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.translate(F.substr("c_name", F.lit(10)), *LETTERS).alias("name"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.collate("name", "UNICODE"), "c_custkey"))
    return rows.withColumn("rank", rank).where("rank <= 5").select(F.col("c_custkey").alias("id"), "name", "rank")


@query("""SELECT page_id, 'http://' || lower(regexp_extract(url, '://([^/?#:]+)', 1)) || '/a/' || page_id || '/%C3%BC?x=%C3%A9+1' AS cleaned FROM pages""")
def url_standard(spark, d):
    """Credentials, default port, dot segments, letters to encode, tracking and fragment of one address."""
    host = F.upper(F.regexp_extract("url", "://([^/?#:]+)", 1))
    raw = F.concat(F.lit("HTTP://user:p@w@"), host, F.lit(":80/a/./b/%2E./"), F.col("page_id").cast("string"), F.lit("/ü?x=é%201&utm_source=q#part"))
    return table(spark, d, "pages").select("page_id", urls.clean_url(raw).alias("cleaned"))


_PHONES_SQL = """WITH plan AS (SELECT 'C' || n_nationkey AS country, CAST(n_nationkey % 5 + 30 AS VARCHAR) AS cc, CAST(n_nationkey // 5 + 1 AS VARCHAR) AS range, 8 AS least, 9 AS most, 'FIXED' AS kind FROM nation
  UNION ALL SELECT 'C' || n_nationkey, CAST(n_nationkey % 5 + 30 AS VARCHAR), CAST(n_nationkey // 5 + 1 AS VARCHAR) || '9', 9, 9, 'MOBILE' FROM nation),
p AS (SELECT c_custkey, CAST(c_nationkey % 5 + 30 AS VARCHAR) || CAST(c_nationkey // 5 + 1 AS VARCHAR) || lpad(CAST(c_custkey % 100000000 * 7 % 100000000 AS VARCHAR), CASE WHEN c_acctbal < 0 THEN 8 ELSE 7 END, '9') AS full_ FROM customer),
m AS (SELECT c_custkey, full_, country, kind, length(full_) - length(cc) BETWEEN least AND most AS ok, row_number() OVER (PARTITION BY c_custkey ORDER BY length(range) DESC) AS r FROM p JOIN plan ON starts_with(full_, cc || range))
SELECT c_custkey AS id, CASE WHEN ok THEN '+' || full_ END AS number, CASE WHEN ok THEN country END AS number_country, CASE WHEN ok THEN kind END AS number_kind FROM m WHERE r = 1"""


@query(_PHONES_SQL)
def phone_ranges(spark, d):
    """Numbers by the longest range of a plan; five countries share a calling code, some numbers are written at home."""
    n = F.col("n_nationkey")
    code, area = (n % 5 + 30).cast("string"), (F.floor(n / 5) + 1).cast("string")
    nations = table(spark, d, "nation")
    base = nations.select(F.concat(F.lit("C"), n.cast("string")).alias("country"), code.alias("calling_code"), F.lit("0").alias("national_prefix"), area.alias("range"), F.lit(8).alias("least"), F.lit(9).alias("most"), F.lit("FIXED").alias("kind"))
    plan = base.union(base.withColumns({"range": F.concat("range", F.lit("9")), "least": F.lit(9), "kind": F.lit("MOBILE")}))
    c = F.col("c_nationkey")
    rest = F.lpad((F.col("c_custkey") % 100000000 * 7 % 100000000).cast("string"), 8, "9")
    rest = F.when(F.col("c_acctbal") < 0, rest).otherwise(F.when(F.length((F.col("c_custkey") * 7).cast("string")) > 7, F.substring(F.lpad((F.col("c_custkey") % 100000000 * 7 % 100000000).cast("string"), 8, "9"), 1, 7)).otherwise(F.lpad((F.col("c_custkey") % 100000000 * 7 % 100000000).cast("string"), 7, "9")))
    national = F.concat((F.floor(c / 5) + 1).cast("string"), rest)
    phone = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("0"), national)).when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("00"), (c % 5 + 30).cast("string"), national)).otherwise(F.concat(F.lit("+"), (c % 5 + 30).cast("string"), F.lit(" "), national))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), phone.alias("phone"), F.concat(F.lit("c"), c.cast("string")).alias("country_code"))
    return numbering.numbers(rows, plan).select("id", "number", "number_country", "number_kind")


_STALE = 6 * 3600


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), top AS (SELECT max(t) AS seen FROM e),
g AS (SELECT user_id, t, lag(t) OVER w AS before, lead(t) OVER w AS after FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT 'w' || user_id AS task_id, 'RUNNING' AS status, t AS at_ms FROM g WHERE before IS NULL OR t - before >= {_STALE * 1000}
UNION ALL SELECT 'w' || user_id, 'EXPIRED', t + {_STALE * 1000} FROM g, top WHERE after - t >= {_STALE * 1000} OR (after IS NULL AND t + {_STALE * 1000} < seen)""")
def worker_stream(spark, d):
    """Q-9 Q-3: workers that appear and fall silent, as state over a stream of beats."""
    kind = table(spark, d, "events").schema
    beats = spark.readStream.schema(kind).parquet(f"{d}/events.parque[t]").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker"), F.col("ts").cast("timestamp").alias("at"))
    out, marks = _scratch(spark, "workers"), _scratch(spark, "marks")
    state.follow_workers(beats, out, marks, _STALE).awaitTermination()
    return state.worker_log(spark, out).select("task_id", "status", F.unix_millis("at").alias("at_ms"))
