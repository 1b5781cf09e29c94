"""The dashboard's blocks for all countries at once, and the details of leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.fixed import CLOSED_PLACES
from terrane.operators.joins import ranked, small
from terrane.operators.services import with_site
from terrane.session import checkpointed


def _with_email(places: DataFrame, emails: DataFrame) -> DataFrame:
    """Facts of each place and whether it has any address."""
    facts = places.select("id", "country_code", "status", "business_status", "is_chain", (F.size("review_reasons") > 0).alias("held"))
    having = emails.select(F.col("place_id").alias("p")).distinct()
    return facts.join(having, F.col("id") == F.col("p"), "left").withColumn("has", F.col("p").isNotNull())


def lead_counts(places: DataFrame, emails: DataFrame, ready: DataFrame) -> DataFrame:
    """Places of each country: all, with an address, ready, held, of chains, closed.

    ``ready``: the rows of ``leads.ready_leads``. Held and chain places count while new and with an address.
    """
    new = F.col("has") & (F.col("status") == "NEW")
    counted = _with_email(places, emails).groupBy("country_code").agg(
        F.count("*").alias("total"),
        F.count_if("has").alias("with_email"),
        F.count_if(new & F.col("held")).alias("needs_review"),
        F.count_if(new & F.col("is_chain")).alias("chains"),
        F.count_if(F.col("business_status").isin(*CLOSED_PLACES)).alias("closed"),
    )
    fit = ready.groupBy(F.col("country_code").alias("c")).agg(F.count("*").alias("r"))
    return counted.join(fit, F.col("country_code") == F.col("c"), "left").drop("c").withColumn("ready", F.coalesce("r", F.lit(0))).drop("r")


def status_counts(places: DataFrame, emails: DataFrame) -> DataFrame:
    """Places with an address of each country and status."""
    return _with_email(places, emails).where("has").groupBy("country_code", "status").agg(F.count("*").alias("n"))


def email_counts(places: DataFrame, emails: DataFrame, free_domains: DataFrame, month: Column) -> DataFrame:
    """Addresses of each country by kind, state and use (P09). ``month``: the moment at which the month began.

    ``emails``: ``(place_id, email_type, is_own_domain, domain, mx_valid, status, exported_at,
    first_seen_at)``; ``free_domains``: ``(domain)``, broadcast if small.
    """
    free = free_domains.select(F.col("domain").alias("f")).distinct()
    facts = emails.select("place_id", "email_type", "is_own_domain", "domain", "mx_valid", F.col("status").alias("state"), "exported_at", "first_seen_at").join(small(free), F.col("domain") == F.col("f"), "left")
    rows = facts.join(places.select(F.col("id").alias("p"), "country_code"), F.col("place_id") == F.col("p"))
    tests = {
        "generic": F.col("email_type") == "GENERIC",
        "personal": F.col("email_type") == "PERSONAL",
        "own_domain": F.col("is_own_domain"),
        "free_mail": F.col("f").isNotNull(),
        "no_mail_server": ~F.col("mx_valid"),
        "bounced": F.col("state") == "BOUNCED",
        "unsubscribed": F.col("state") == "UNSUBSCRIBED",
        "exported": F.col("exported_at").isNotNull(),
        "new_this_month": F.col("first_seen_at") >= month,
    }
    return rows.groupBy("country_code").agg(F.count("*").alias("total"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def website_counts(places: DataFrame, crawls: DataFrame) -> DataFrame:
    """Sites of each country: places with one, and its domains by the outcome of their crawl.

    ``places``: ``(country_code, status, website, website_domain)``; rejected ones count as having a site, but
    their domains are not looked at. ``crawls``: ``(domain, status, crawled_at, emails_found,
    robots_blocked)``, one row a domain.
    """
    open_ = F.col("status") != "REJECTED"
    of_domain = with_site(places).groupBy("country_code", "website_domain").agg(F.count("*").alias("n"), F.bool_or(open_).alias("open"))
    state = crawls.select("domain", F.col("status").alias("state"), "crawled_at", "emails_found", "robots_blocked")
    j, looked = of_domain.join(state, F.col("website_domain") == F.col("domain"), "left"), F.col("open")
    return j.groupBy("country_code").agg(
        F.sum("n").alias("with_website"),
        F.count_if(looked & F.col("crawled_at").isNotNull()).alias("crawled"),
        F.count_if(looked & (F.col("emails_found") > 0)).alias("email_found"),
        F.count_if(looked & (F.col("state") == "DONE") & (F.col("emails_found") == 0) & ~F.col("robots_blocked")).alias("no_email_found"),
        F.count_if(looked & (F.col("state") == "FAILED")).alias("failed"),
        F.count_if(looked & F.col("robots_blocked")).alias("robots_blocked"),
    )


def usage_months(usage: DataFrame, provider: str, sku: str, most: int = 6) -> DataFrame:
    """The last months of an interface's use, oldest first (P09). ``usage``: ``(provider, sku, period, request_count, paid_count)``."""
    mine = usage.where((F.col("provider") == provider) & (F.col("sku") == sku)).orderBy(F.col("period").desc()).limit(most)
    return mine.select("period", F.col("request_count").alias("requests"), F.col("paid_count").alias("paid")).orderBy("period")


def export_totals(batches: DataFrame, month: Column) -> DataFrame:
    """One row: active batches, their rows, those of this month, the last one's moment."""
    active, rows = F.col("status") == "ACTIVE", F.col("row_count")
    return batches.agg(
        F.count_if(active).alias("batches"),
        F.coalesce(F.sum(F.when(active, rows)), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(active & (F.col("created_at") >= month), rows)), F.lit(0)).alias("rows_this_month"),
        F.max(F.when(active, F.col("created_at"))).alias("last_export_at"),
    )


def top_groups(leads: DataFrame, ready: DataFrame, column: str, unknown: str, most: int = 10) -> DataFrame:
    """The groups of each country with most leads that have a primary address, and how many of them are ready.

    ``leads``: ``(country_code, email, <column>)``; ``ready``: a part of them. Groups are counted first, so only
    their counts are ranked; ties by name.
    """
    name = F.coalesce(F.col(column), F.lit(unknown)).alias("name")
    every = leads.where(F.col("email").isNotNull()).select("country_code", name, F.lit(0).alias("fit"))
    both = every.union(ready.select("country_code", name, F.lit(1)))
    counted = both.groupBy("country_code", "name").agg(F.count_if(F.col("fit") == 0).alias("with_email"), F.count_if(F.col("fit") == 1).alias("ready"))
    return ranked(counted, ["country_code"], [F.col("with_email").desc(), F.col("name")], "rank").where(F.col("rank") <= most)


def daily_activity(days: DataFrame, places: DataFrame, emails: DataFrame, batches: DataFrame, zone: str = "Asia/Nicosia") -> DataFrame:
    """New places, new addresses and exported rows of each local day, quiet days included.

    ``days``: ``(day)``, from ``joins.calendar``; ``places`` of the wanted countries. All three kinds are counted in
    one pass over their union.
    """
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone)).alias("d")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    mine = emails.select("place_id", "first_seen_at").join(places.select(F.col("id").alias("p")), F.col("place_id") == F.col("p"))
    rows = places.select(local("first_seen_at"), one.alias("a"), none.alias("b"), none.alias("c")).union(mine.select(local("first_seen_at"), none, one, none))
    rows = rows.union(batches.where("status = 'ACTIVE'").select(local("created_at"), none, none, F.col("row_count").cast("long")))
    counted = rows.groupBy("d").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    count = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return days.join(counted, F.col("day") == F.col("d"), "left").select("day", count("a", "new_places"), count("b", "new_emails"), count("c", "exported"))


def _nested(rows: DataFrame, key: str, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """One row a key with its rows as an array of structs, in order."""
    item = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
    return rows.groupBy(F.col(key).alias(f"{name}_of")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))


def _newest(events: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """The events of each wanted place ``w`` from the month on that completes its newest ``most``; those without a time are the newest of all.

    Months are counted in the map tasks, so a place with very many events is sorted only from that month on.
    """
    month = F.when(F.col("at").isNotNull(), F.year("at") * 12 + F.month("at")).otherwise(F.lit(2**31 - 1))
    counts = events.groupBy("place_id", month.alias("month")).count().join(wanted, F.col("place_id") == F.col("w"), "left_semi")
    newer = F.coalesce(F.sum("count").over(Window.partitionBy("place_id").orderBy(F.col("month").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = checkpointed(counts.withColumn("newer", newer).where(F.col("newer") < most).groupBy(F.col("place_id").alias("of")).agg(F.min("month").alias("first")))
    return events.join(small(first), F.col("place_id") == F.col("of")).where(month >= F.col("first")).drop("of", "first")


def lead_details(leads: DataFrame, emails: DataFrame, subcategories: DataFrame, sources: DataFrame, audit: DataFrame, exports: DataFrame, shop_checks: DataFrame, most_history: int = 50) -> DataFrame:
    """Chosen leads with all that is known of them, nested (P10).

    ``emails``: ``(place_id, id, email, is_primary, …)``, the primary one first, then by id; ``subcategories``:
    ``(place_id, name, category, is_primary, keyword, created_at)``, the primary one first, then oldest first;
    ``sources``: ``(place_id, source, record_id, fetched_at)``, newest first; ``audit``: ``(place_id, at, action,
    details)`` and ``exports``: ``(place_id, at, batch_id, file, undone)`` make the history, its newest
    ``most_history`` entries; ``shop_checks``: ``(domain, status, sells_online, signals, checked_at)``, one row a
    domain, no running one. Ties: by the remaining columns. Only rows of the chosen leads are nested.
    """
    wanted = leads.select(F.col("id").alias("w")).distinct()
    of = lambda df: df.join(wanted, F.col("place_id") == F.col("w"), "left_semi")
    late = (~F.col("is_primary")).alias("late")
    e = _nested(of(emails), "place_id", [late, F.col("id")], [c for c in emails.columns if c != "place_id"], "emails")
    s = _nested(of(subcategories), "place_id", [late, F.col("created_at"), F.col("name")], ["name", "category", "is_primary", "keyword"], "subcategories")
    newest = lambda c: F.struct(F.col(c).isNotNull(), -F.unix_micros(F.col(c).cast("timestamp")))
    r = _nested(of(sources).withColumn("source", F.lower("source")), "place_id", [newest("fetched_at"), F.col("source"), F.col("record_id")], ["source", "record_id", "fetched_at"], "sources")
    made = F.to_json(F.struct(F.col("batch_id").alias("batchId"), "file", "undone"))
    events = audit.select("place_id", "at", "action", "details").union(exports.select("place_id", "at", F.lit("export.create"), made))
    events = ranked(_newest(events, wanted, most_history), ["place_id"], [F.col("at").desc_nulls_first(), F.col("action"), F.col("details")], "n").where(F.col("n") <= most_history)
    h = _nested(events, "place_id", [F.col("n")], ["at", "action", "details"], "history")
    c = shop_checks.where("status <> 'RUNNING'").select(F.col("domain").alias("shop_of"), F.struct("sells_online", "signals", "checked_at").alias("shop_check"))
    out = leads.join(c, F.col("website_domain") == F.col("shop_of"), "left").drop("shop_of")
    for part, name in ((e, "emails"), (s, "subcategories"), (r, "sources"), (h, "history")):
        out = out.join(part, F.col("id") == F.col(f"{name}_of"), "left").drop(f"{name}_of")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out
