"""Queries on scalar functions: names, emails, URLs, phones, boxes, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import email, fixed, geo, phones, text, urls
from terrane.operators import leads, places
from terrane.plans.registry import Registry
from terrane.session import table

query = Registry()


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _words(spark, d):
    """Words of the documents that may be addresses."""
    return table(spark, d, "documents").select("doc_id", "text").where(F.contains("text", F.lit("@")))


ADDRESSES_SQL = r"""
a AS (SELECT DISTINCT doc_id, lower(regexp_replace(m, '[.,;:!?''")\]}>]+$', '')) AS email FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[a-z0-9.!#$%&''*+=?^_`{|}~-]+@[a-z0-9.-]+\.[a-z0-9-]{2,}')) AS m FROM documents)
 WHERE regexp_matches(lower(regexp_replace(m, '[.,;:!?''")\]}>]+$', '')), '^[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*\.(?:[a-z]{2,}|xn--[a-z0-9-]+)$')
   AND length(split_part(m, '@', 1)) <= 64)
"""


def _addresses(spark, d):
    return _words(spark, d).select("doc_id", F.explode(email.extract_emails(F.col("text"))).alias("email"))


@query(f"WITH {ADDRESSES_SQL} SELECT doc_id, email FROM a")
def email_extract(spark, d):
    """All addresses of a text in normal form."""
    return _addresses(spark, d)


@query(f"WITH {ADDRESSES_SQL} SELECT email, sha256(email) AS email_hash, split_part(email, '@', 2) AS domain, count(*) AS n FROM a GROUP BY 1")
def email_hash(spark, d):
    """E03 E04."""
    e = F.col("email")
    return _addresses(spark, d).groupBy("email").agg(F.count("*").alias("n")).select("email", email.email_hash(e).alias("email_hash"), email.email_domain(e).alias("domain"), "n")


#: Mailboxes out of the tables: one of some words, a separator and a number at a domain.
MAILBOX_SQL = "SELECT c_custkey AS id, list_extract(['info', 'sales.', 'dpo', 'privacy-', 'support', 'anna', 'noreply', 'abcdef0123456789ab', 'optout', 'bookings_'], CAST(c_custkey % 10 AS INT) + 1) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 7 AS VARCHAR) END || '@' || list_extract(['shop.cy', 'mail.shop.cy', 'example.com', 'x.wix.com', 'gmail.com', 'instagram.com', 'a.png', 'yopmail.com'], CAST(c_custkey % 8 AS INT) + 1) AS email FROM customer"


def _mailboxes(spark, d):
    pick = lambda n, *words: F.get(F.array(*[F.lit(w) for w in words]), F.col("c_custkey") % n)
    local = pick(10, "info", "sales.", "dpo", "privacy-", "support", "anna", "noreply", "abcdef0123456789ab", "optout", "bookings_")
    number = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise((F.col("c_custkey") % 7).cast("string"))
    domain = pick(8, "shop.cy", "mail.shop.cy", "example.com", "x.wix.com", "gmail.com", "instagram.com", "a.png", "yopmail.com")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(local, number, F.lit("@"), domain).alias("email"))


@query(f"""WITH m AS ({MAILBOX_SQL}) SELECT id, email, CASE WHEN regexp_matches(split_part(email, '@', 1), '^(?:{"|".join(fixed.GENERIC_MAILBOXES)})(?:$|[._-]|[0-9])') THEN 'GENERIC' ELSE 'PERSONAL' END AS email_type,
 regexp_matches(split_part(email, '@', 1), '^(?:{"|".join(fixed.ROLE_MAILBOXES)})(?:$|[._-]|[0-9])') AS is_role, split_part(email, '@', 2) IN ({sql_list(fixed.DISPOSABLE_DOMAINS)}) AS is_disposable,
 split_part(email, '@', 2) = 'shop.cy' OR split_part(email, '@', 2) LIKE '%.shop.cy' AS is_own FROM m""")
def email_classify(spark, d):
    """T07 T08 E11 J20."""
    e, domain = F.col("email"), email.email_domain(F.col("email"))
    return _mailboxes(spark, d).select("id", "email", email.email_type(e).alias("email_type"), email.is_role_mailbox(e).alias("is_role"), email.is_disposable(domain).alias("is_disposable"), email.is_own_domain(domain, F.lit("www.shop.cy")).alias("is_own"))


@query(f"""WITH m AS ({MAILBOX_SQL}), x AS (SELECT id, email, split_part(email, '@', 1) AS l, split_part(email, '@', 2) AS dm FROM m) SELECT id, CASE WHEN regexp_extract(dm, '[^.]*$') IN ({sql_list(fixed.FILE_ENDINGS)}) THEN 'FILE_NAME'
 WHEN regexp_matches(dm, '{fixed.PLACEHOLDER_DOMAIN}') THEN 'PLACEHOLDER' WHEN list_has_any([{sql_list(fixed.TECH_DOMAINS)}], list_transform(range(len(string_split(dm, '.'))), lambda i: array_to_string(string_split(dm, '.')[i + 1:], '.'))) THEN 'TECH_DOMAIN'
 WHEN list_has_any([{sql_list(h for hosts in fixed.PLATFORM_HOSTS.values() for h in hosts)}], list_transform(range(len(string_split(dm, '.'))), lambda i: array_to_string(string_split(dm, '.')[i + 1:], '.'))) THEN 'PLATFORM_DOMAIN'
 WHEN regexp_matches(l, '{fixed.JUNK_MAILBOX}') THEN 'JUNK_LOCAL' WHEN regexp_matches(l, '^[0-9a-f]{{16,}}$') THEN 'HASH_LOCAL' END AS reason FROM x""")
def reject_reason(spark, d):
    """The first reason in fixed order."""
    return _mailboxes(spark, d).select("id", email.reject_reason(F.col("email")).alias("reason"))


HOST_SQL = r"lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(rf"""SELECT page_id, regexp_extract(url, '^https?', 0) || '://' || {HOST_SQL} || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END
 || CASE WHEN q = '' THEN '' ELSE '?' || q END AS cleaned FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
   lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) IN ({sql_list(fixed.TRACKING_NAMES)}) OR regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|mc_|hsa_|_hs|pk_|mtm_|matomo_)'))), '&') AS q FROM pages)""")
def url_clean(spark, d):
    """Addresses without tracking and fragments."""
    return table(spark, d, "pages").select("page_id", urls.clean_url(F.col("url")).alias("cleaned"))


@query(f"SELECT page_id, regexp_replace({HOST_SQL}, '^www\\.', '') AS domain FROM pages")
def own_domain(spark, d):
    """R03."""
    return table(spark, d, "pages").select("page_id", urls.own_domain(urls.clean_url(F.col("url"))).alias("domain"))


@query(rf"""WITH h AS (SELECT c_custkey AS id, list_extract(['www.instagram.com', 'n12.alteg.io', 'shop.cy', 'tripadvisor.co.uk', 'm.facebook.com', 'linktr.ee', 'maps.google.gr', 'wolt.com', 'x.com'], CAST(c_custkey % 9 AS INT) + 1) AS host FROM customer)
 SELECT id, host, list_extract(['SOCIAL', 'BOOKING', NULL, 'MAPS_LISTING', 'SOCIAL', 'LINK_IN_BIO', 'MAPS_LISTING', 'MARKETPLACE', 'SOCIAL'], CAST(id % 9 AS INT) + 1) AS kind, list_extract(['instagram', NULL, NULL, NULL, 'facebook', NULL, NULL, NULL, NULL], CAST(id % 9 AS INT) + 1) AS network FROM h""")
def host_suffix_kind(spark, d):
    """Kinds of platforms by suffix, then by brand."""
    hosts = ("www.instagram.com", "n12.alteg.io", "shop.cy", "tripadvisor.co.uk", "m.facebook.com", "linktr.ee", "maps.google.gr", "wolt.com", "x.com")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.get(F.array(*[F.lit(h) for h in hosts]), F.col("c_custkey") % 9).alias("host"))
    return rows.select("id", "host", urls.platform_kind(F.col("host")).alias("kind"), urls.social_key(F.col("host")).alias("network"))


@query(r"""SELECT doc_id, regexp_replace(lower(strip_accents(left(regexp_replace(text, '[ΣςßẞİıŁłØøĐđÆæŒœ]', '', 'g'), 200))), '^\s+|\s+$', '', 'g') AS folded FROM documents""")
def name_fold(spark, d):
    """Accents away, lower case (over letters that decompose)."""
    head = F.left(F.regexp_replace("text", "[ΣςßẞİıŁłØøĐđÆæŒœ]", ""), F.lit(200))
    return table(spark, d, "documents").select("doc_id", text.fold(head).alias("folded"))


@query(r"""WITH n AS (SELECT p_partkey AS id, p_name || list_extract([' Ltd.', ' & Co', ' S.A.', ' Company Limited', ''], CAST(p_partkey % 5 AS INT) + 1) AS name FROM part)
 SELECT id, regexp_replace(trim(regexp_replace(replace(lower(name), '.', ''), '[^a-z0-9&]+', ' ', 'g')), '( (ltd|limited|co|company|sa))+$', '') AS matching FROM n""")
def matching_name(spark, d):
    """Trailing legal forms go."""
    name = F.concat("p_name", F.get(F.array(*[F.lit(x) for x in (" Ltd.", " & Co", " S.A.", " Company Limited", "")]), F.col("p_partkey") % 5))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.matching_name(name).alias("matching"))


@query()
def phone_e164(spark, d):
    """National and international numbers (an approximation; see the module)."""
    n = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("99 "), n)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("+357 22-"), n)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("00357 25"), n)).otherwise(F.concat(F.lit("12"), n))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), raw.alias("raw"), phones.e164(raw, F.lit("CY")).alias("e164"))


SCORE_SQL = """CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN c_custkey % 5 <> 0 THEN 10 ELSE 0 END
 + CASE WHEN c_acctbal / 2000 >= 4 AND c_custkey % 20 >= 5 THEN 10 ELSE 0 END + CASE WHEN c_mktsegment <> 'MACHINERY' THEN 10 ELSE 0 END - CASE WHEN c_custkey % 11 = 0 THEN 50 ELSE 0 END + CASE WHEN c_custkey % 13 = 0 THEN 20 ELSE 0 END"""


def _facts(spark, d):
    k = F.col("c_custkey")
    primary = F.when(k % 4 != 3, F.struct((k % 17 != 0).alias("syntax_valid"), F.when(k % 6 == 0, F.lit(False)).when(k % 6 < 4, F.lit(True)).alias("mx_valid"), (k % 2 == 0).alias("is_own_domain"), (k % 23 == 0).alias("is_role")))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("id"), primary.alias("primary"), F.when(k % 9 == 0, F.lit(" Κύπρος ")).when(k % 10 == 0, F.lit("cy")).otherwise(F.col("n_name")).alias("city_name"), F.lit("CY").alias("country_code"), (k % 5 != 0).alias("phone_valid"),
        F.when(k % 3 == 0, F.lit("shop.cy")).alias("website_domain"), (F.col("c_acctbal") / 2000).alias("rating"), (k % 20).alias("rating_count"), F.when(F.col("c_mktsegment") != "MACHINERY", "OPERATIONAL").otherwise("CLOSED_TEMPORARILY").alias("business_status"),
        (k % 11 == 0).alias("is_chain"), (k % 8 != 0).alias("has_category"), F.when(k % 13 == 0, F.lit(True)).alias("sells_online"),
    )


@query(f"SELECT c_custkey AS id, {SCORE_SQL.replace('CASE WHEN c_custkey % 2 = 0 THEN 30', 'CASE WHEN c_custkey % 4 <> 3 AND c_custkey % 2 = 0 THEN 30')} AS score FROM customer")
def score(spark, d):
    """G06."""
    return _facts(spark, d).select("id", leads.lead_score().alias("score"))


REASONS_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN [] ELSE list_filter([CASE WHEN c_custkey % 17 = 0 THEN 'EMAIL_SYNTAX' END, CASE WHEN c_custkey % 6 = 0 THEN 'EMAIL_NO_MX' END, CASE WHEN c_custkey % 6 >= 4 THEN 'EMAIL_MX_UNKNOWN' END,
 CASE WHEN c_custkey % 23 = 0 THEN 'EMAIL_ROLE' END, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN 'NO_REAL_CITY' END, CASE WHEN c_custkey % 8 = 0 THEN 'NO_CATEGORY' END, CASE WHEN c_custkey % 5 = 0 THEN 'PHONE_INVALID' END], lambda x: x IS NOT NULL) END AS reasons FROM customer"""


@query(f"SELECT id, array_to_string(reasons, ',') AS reasons FROM ({REASONS_SQL})")
def review_reasons(spark, d):
    """Reasons in fixed order, only with a primary address; unknown mail servers count on their own."""
    return _facts(spark, d).select("id", F.array_join(leads.review_reasons(), ",").alias("reasons"))


@query(f"SELECT unnest(reasons) AS reason, count(*) AS n FROM ({REASONS_SQL}) GROUP BY 1")
def reason_histogram(spark, d):
    """A11 G07."""
    return _facts(spark, d).select(F.explode(leads.review_reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT id, floor((lat - h / 111.32) * 1e6 + 0.5) / 1e6 AS south, floor((lng - h / (111.32 * cos(radians(lat)))) * 1e6 + 0.5) / 1e6 AS west, floor((lat + h / 111.32) * 1e6 + 0.5) / 1e6 AS north, floor((lng + h / (111.32 * cos(radians(lat)))) * 1e6 + 0.5) / 1e6 AS east
 FROM (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 60 AS lat, CAST(embedding[2] AS DOUBLE) * 100 AS lng, least(greatest(0.02 * sqrt(label * 5000), 1.0), 12.0) AS h FROM embeddings)""")
def city_boxes(spark, d):
    """G02."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.element_at("embedding", 1).cast("double") * 60).alias("lat"), (F.element_at("embedding", 2).cast("double") * 100).alias("lng"), (F.col("label") * 5000).alias("p"))
    return rows.select("id", geo.city_box(F.col("lat"), F.col("lng"), F.col("p"), 1.0, 12.0, 0.02).alias("b")).select("id", "b.*")


@query("""SELECT id, k, south + CASE WHEN k >= 2 THEN 0.5 ELSE 0 END AS south, west + CASE WHEN k % 2 = 1 THEN 1.0 ELSE 0 END AS west FROM (SELECT l_orderkey AS id, CAST(l_linenumber AS DOUBLE) AS south, l_quantity AS west, l_discount FROM lineitem WHERE l_quantity >= 48), (SELECT unnest([0, 1, 2, 3]) AS k)""")
def split_tiles(spark, d):
    """G03 Q-4: the four children of saturated tiles."""
    tiles = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.lit(0).alias("depth"), F.when(F.col("l_quantity") >= 48, 60).otherwise(10).alias("found"), F.col("l_linenumber").cast("double").alias("south"), F.col("l_quantity").cast("double").alias("west"))
    tiles = tiles.select("*", (F.col("south") + 1).alias("north"), (F.col("west") + 2).alias("east"))
    out = places.split_saturated(tiles)
    return out.select(F.substring_index("path", ".", 1).cast("long").alias("id"), F.substring_index("path", ".", -1).cast("int").alias("k"), "south", "west")


@query("""SELECT p_partkey AS id, 'discovery|GOOGLE_PLACES|city:' || p_size || '|t:' || CASE WHEN p_partkey % 3 = 0 THEN 'root' ELSE CAST(p_partkey % 4 AS VARCHAR) END || '|sub:' || p_partkey % 65 || '|kw:' || p_type || '|en' AS key FROM part""")
def task_keys(spark, d):
    """Q-5."""
    path = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise((F.col("p_partkey") % 4).cast("string"))
    key = places.task_key(F.concat(F.lit("city:"), "p_size"), path, (F.col("p_partkey") % 65).cast("string"), F.col("p_type"), F.lit("en"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), key.alias("key"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN true WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN s_suppkey % 3 = 0 ELSE s_suppkey % 5 = 2 END AS mx FROM supplier")
def mx_states(spark, d):
    """Three-valued answers of two resolvers."""
    k = F.col("s_suppkey")
    first = F.when(k % 3 == 0, F.lit(True)).when(k % 5 == 0, F.lit(None)).otherwise(F.lit(False))
    second = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit(None)).otherwise(k % 5 == 2)
    return table(spark, d, "supplier").select(k.alias("id"), email.mx_state(first, second).alias("mx"))


@query(r"""SELECT conv_id, turn, 'mail info@shop.cy or x@y.gr' AS decoded FROM conversations""")
def deobfuscated(spark, d):
    """Hidden addresses as addresses."""
    hidden = F.lit(r"mail info [at] shop (dot) cy or x@y DOT gr")
    return table(spark, d, "conversations").select("conv_id", "turn", email.deobfuscate(email.decode_escapes(hidden)).alias("decoded"))
