"""Exports and their undoing, erasure, statuses, mail-server and name rechecks, reports over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.email import email_domain
from terrane.functions.fixed import EXAMPLE_SITE
from terrane.functions.text import matching_name
from terrane.operators.joins import anti_join_any, classify_places
from terrane.operators.state import insert_ignore


def mark_exported(places: DataFrame, items: DataFrame, batch_id: int, at: Column) -> DataFrame:
    """Places of a new batch are exported (M09). ``items``: ``(batch_id, place_id, row_number)``."""
    fresh = items.where(F.col("batch_id") == batch_id).select(F.col("place_id").alias("__p")).distinct().withColumn("__hit", F.lit(True))
    j = places.join(fresh, F.col("id") == F.col("__p"), "left")
    change = {"status": F.when(F.col("__hit"), F.lit("EXPORTED")), "exported_at": F.when(F.col("__hit"), at), "export_batch_id": F.when(F.col("__hit"), F.lit(batch_id))}
    return j.select(*[F.coalesce(change[c], F.col(c)).alias(c) if c in change else F.col(c) for c in places.columns])


def undo_export(places: DataFrame, batch_id: int) -> DataFrame:
    """Rows that are still exactly exported by the batch are new again."""
    back = (F.col("status") == "EXPORTED") & (F.col("export_batch_id") == batch_id)
    change = {"status": F.lit("NEW"), "exported_at": F.lit(None), "export_batch_id": F.lit(None)}
    return places.select(*[F.when(back, change[c].cast(t)).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c, t in places.dtypes])


def redownload(items: DataFrame, leads: DataFrame, batch_id: int) -> DataFrame:
    """The rows of a batch in their order, with current data."""
    rows = items.where(F.col("batch_id") == batch_id).select(F.col("place_id").alias("__p"), "row_number")
    return leads.join(rows, F.col("id") == F.col("__p")).drop("__p").orderBy("row_number")


def erase(places: DataFrame, emails: DataFrame, suppression: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places rejected without phone, their emails gone, the hashes kept as ERASED."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    j = places.join(gone, F.col("id") == F.col("__gone"), "left")
    hit = F.col("__gone").isNotNull()
    blank = {"status": F.lit("REJECTED"), "phone_raw": F.lit(None), "phone_e164": F.lit(None), "phone_valid": F.lit(False)}
    next_places = j.select(*[F.when(hit, blank[c].cast(t)).otherwise(F.col(c)).alias(c) if c in blank else F.col(c) for c, t in places.dtypes])
    removed = emails.join(gone, F.col("place_id") == F.col("__gone"), "left_semi")
    kept = emails.join(gone, F.col("place_id") == F.col("__gone"), "left_anti")
    null = F.lit(None).cast("string")
    rows = removed.select(F.sha2("email", 256).alias("email_hash"), null.alias("email_normalized"), email_domain(F.col("email")).alias("domain"), F.lit("ERASED").alias("reason"), F.lit("erase").alias("source_file"))
    return next_places, kept, insert_ignore(suppression, rows.select(suppression.columns), ["email_hash"])


def set_status(places: DataFrame, ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """The next snapshot and the audit rows ``(id, old, new)`` of the places that changed."""
    chosen = ids.select(F.col("id").alias("__id")).distinct()
    j = places.join(chosen, F.col("id") == F.col("__id"), "left")
    to = F.when(F.col("__id").isNotNull(), F.lit(status)).otherwise(F.col("status"))
    audit = j.where(to != F.col("status")).select("id", F.col("status").alias("old"), F.lit(status).alias("new"))
    return j.select(*[to.alias(c) if c == "status" else F.col(c) for c in places.columns]), audit


def page_statuses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Next page statuses; REMOVED is final (M14). Both ``(place_id, status, url)``."""
    j = old.alias("o").join(new.alias("n"), F.col("o.place_id") == F.col("n.place_id"), "full_outer")
    final = F.coalesce(F.col("o.status") == "REMOVED", F.lit(False))
    status = F.when(final, F.lit("REMOVED")).otherwise(F.coalesce("n.status", "o.status"))
    return j.select(F.coalesce("o.place_id", "n.place_id").alias("place_id"), status.alias("status"), F.when(final, F.col("o.url")).otherwise(F.coalesce("n.url", "o.url")).alias("url"))


def not_removed(places: DataFrame, removals: DataFrame) -> DataFrame:
    """Places that no removal names by id, source id, phone or domain."""
    return anti_join_any(places, removals, [(F.col(c), F.col(r)) for c, r in (("id", "place_id"), ("overture_id", "overture_id"), ("phone_e164", "phone_e164"), ("website_domain", "website_domain"))])


def recheck_mx(emails: DataFrame, mx: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Addresses due for a check take the new answer; an answer of null keeps the old.

    ``emails``: ``(id, email, mx_valid, mx_checked_at)``; ``mx``: ``(domain, mx_valid)``.
    """
    due = F.col("mx_valid").isNull() | (~F.col("mx_valid") & (F.col("mx_checked_at").isNull() | (F.col("mx_checked_at") <= now - F.make_interval(days=F.lit(days)))))
    answers = mx.select(F.col("domain").alias("__d"), F.col("mx_valid").alias("__v"))
    j = emails.join(answers, email_domain(F.col("email")) == F.col("__d"), "left")
    asked = due & F.col("__d").isNotNull()
    change = {"mx_valid": F.when(asked, F.coalesce("__v", "mx_valid")).otherwise(F.col("mx_valid")), "mx_checked_at": F.when(asked, now).otherwise(F.col("mx_checked_at"))}
    return j.select(*[change[c].alias(c) if c in change else F.col(c) for c in emails.columns])


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose columns differ, nulls compared as values."""
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return j.where(differs).select(F.col(f"o.{key}").alias(key))


def renormalise(places: DataFrame) -> DataFrame:
    """Matching names computed anew; ``name_changed`` tells where."""
    name = matching_name(F.col("name"))
    return places.select(*[name.alias(c) if c == "name_normalized" else F.col(c) for c in places.columns], (~F.col("name_normalized").eqNullSafe(name)).alias("name_changed"))


def with_site(places: DataFrame) -> DataFrame:
    """Places with an own site that is none of the examples."""
    return places.where(F.col("website").isNotNull() & F.col("website_domain").isNotNull() & ~F.col("website_domain").rlike(EXAMPLE_SITE))


def crawlable(places: DataFrame) -> DataFrame:
    """Places with an own site that were not rejected."""
    return with_site(places).where(F.col("status") != "REJECTED")


def due_domains(places: DataFrame, crawls: DataFrame, emails: DataFrame, now: Column, stale_minutes: int = 15, recheck_before: Column | None = None) -> DataFrame:
    """Domains to crawl, first place first (F06, A08): never crawled, due again, or claimed too long ago.

    ``places``: ``(id, status, website, website_domain)``; ``crawls``: ``(domain, status, retry_at,
    started_at, emails_found, crawled_at)``, the last two only used with ``recheck_before``, which adds
    domains crawled before that moment without an address. Domains of example sites, of rejected places and
    of places with an address do not count.
    """
    found = emails.select(F.col("place_id").alias("p")).distinct()
    open_ = crawlable(places).select("id", "website_domain").join(found, F.col("id") == F.col("p"), "left_anti")
    queue = open_.groupBy("website_domain").agg(F.min("id").alias("priority"))
    running = F.col("status") == "RUNNING"
    due = (~running & (F.col("retry_at") <= now)) | (running & (F.col("started_at") < now - F.make_interval(mins=F.lit(stale_minutes))))
    if recheck_before is not None:
        due = due | (F.col("status").isin("DONE", "FAILED") & (F.col("emails_found") == 0) & (F.col("crawled_at") < recheck_before))
    asked = crawls.select("domain", F.coalesce(due, F.lit(False)).alias("due"))
    return queue.join(asked, F.col("website_domain") == F.col("domain"), "left").where(F.coalesce("due", F.lit(True))).select("website_domain", "priority").orderBy("priority")


def due_shop_checks(places: DataFrame, emails: DataFrame, checks: DataFrame, now: Column, days: int = 180, stale_minutes: int = 15) -> DataFrame:
    """Own domains of places with an address whose shop check is missing, too old or claimed too long ago, first place first.

    ``checks``: ``(domain, status, checked_at, updated_at)``.
    """
    having = emails.select(F.col("place_id").alias("p")).distinct()
    open_ = crawlable(places).select("id", "website_domain").join(having, F.col("id") == F.col("p"), "left_semi")
    running = F.col("status") == "RUNNING"
    due = (~running & (F.col("checked_at") < now - F.make_interval(days=F.lit(days)))) | (running & (F.col("updated_at") < now - F.make_interval(mins=F.lit(stale_minutes))))
    asked = checks.select("domain", F.coalesce(due, F.lit(False)).alias("due"))
    queue = open_.groupBy("website_domain").agg(F.min("id").alias("priority"))
    return queue.join(asked, F.col("website_domain") == F.col("domain"), "left").where(F.coalesce("due", F.lit(True))).select("website_domain", "priority").orderBy("priority")


def kept_snapshots(snapshots: DataFrame, now: Column, days: int = 45) -> DataFrame:
    """Snapshots that are not older than some days (M21); the others go with the next write."""
    return snapshots.where(F.col("taken_at") >= now - F.make_interval(days=F.lit(days)))


def latest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The newest rows, ties by the larger key (O05): a top-k, no sort of the table."""
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(most)


def prunable(places: DataFrame, emails: DataFrame) -> DataFrame:
    """Places without any use: one open source only, no site, new, no address, never exported."""
    plain = places.where(F.col("google_place_id").isNull() & F.col("website_domain").isNull() & (F.col("status") == "NEW") & F.col("exported_at").isNull())
    return plain.join(emails.select(F.col("place_id").alias("__p")).distinct(), F.col("id") == F.col("__p"), "left_anti")


def first_owner(emails: DataFrame) -> DataFrame:
    """The first place of each address inside a batch (W06). ``(email, place_order, email_order, place_id)``."""
    return emails.groupBy("email").agg(F.min_by("place_id", F.struct("place_order", "email_order")).alias("place_id"))


def mapping_report(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Places of each outcome and rule or category, and how many have an address."""
    rows = classify_places(places, rules)
    what = F.when(F.col("kind") == "mapped", F.col("subcategory_id").cast("string")).when(F.col("kind") == "excluded", F.col("excluded_reason")).otherwise(F.coalesce("taxonomy_primary", F.lit("(none)")))
    return rows.groupBy("kind", what.alias("what")).agg(F.count("*").alias("n"), F.count_if(F.col("has_email")).alias("with_email"))


def crawl_funnel(crawls: DataFrame) -> DataFrame:
    """Crawled, reachable and found domains, and failures by the code before the colon."""
    code = F.when(F.col("error").isNotNull(), F.substring_index("error", ":", 1)).otherwise(F.lit("ok"))
    return crawls.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.count_if(F.col("emails_found") > 0).alias("with_email"))


def storage_estimate(n_places: int, table_bytes: int, new_places: int, limit_mb: int = 900, default_bytes: int = 2500) -> dict[str, float | bool]:
    """Bytes a place, the size after an import, and whether it fits."""
    each = table_bytes / n_places if n_places >= 1000 else default_bytes
    after = (table_bytes + each * max(new_places, 0)) / 1e6
    return {"bytes_per_place": each, "after_mb": after, "fits": after <= limit_mb}


#: States in which a job takes an action, and the state after it.
JOB_ACTIONS = {
    "start": (("QUEUED",), "RUNNING"),
    "resume": (("PAUSED_USER", "PAUSED_QUOTA", "FAILED"), "RUNNING"),
    "continue-free": (("RUNNING", "PAUSED_USER", "PAUSED_QUOTA", "FAILED"), "RUNNING"),
    "pause": (("RUNNING",), "PAUSED_USER"),
    "cancel": (("QUEUED", "RUNNING", "PAUSED_USER", "PAUSED_QUOTA", "FAILED"), "CANCELLED"),
}
PAID_SOURCE = "GOOGLE_PLACES"


def _accepted(jobs: DataFrame, actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(job, did)`` of the actions that the jobs' states allow; a completed job with deferred paid tasks can resume."""
    waiting = tasks.where((F.col("source") == PAID_SOURCE) & (F.col("status") == "DEFERRED")).select(F.col("job_id").alias("w")).distinct()
    asked = jobs.select(F.col("id").alias("job"), F.col("status").alias("was")).join(actions.select(F.col("job_id").alias("j"), F.col("action").alias("did")), F.col("job") == F.col("j")).join(waiting, F.col("job") == F.col("w"), "left")
    allowed = (F.col("did") == "resume") & (F.col("was") == "COMPLETED") & F.col("w").isNotNull()
    for action, (states, _) in JOB_ACTIONS.items():
        allowed = allowed | ((F.col("did") == action) & F.col("was").isin(*states))
    return asked.where(allowed).select("job", "did")


def job_actions(jobs: DataFrame, actions: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and their tasks after one action each; an action that the state does not allow changes nothing (Q-7).

    ``jobs``: ``(id, status, …)``; ``actions``: ``(job_id, action)``; ``tasks``: ``(job_id, source, status,
    …)``. Starting and resuming put deferred and failed tasks back; ``continue-free`` defers the paid
    ones and puts the others back, and a job without an open task is then complete; cancelling skips
    what is open.
    """
    done = _accepted(jobs, actions, tasks)
    status, did, paid = F.col("status"), F.col("did"), F.col("source") == PAID_SOURCE
    again = F.when(status.isin("DEFERRED", "FAILED"), F.lit("PENDING"))
    moved = (
        F.when(did.isin("start", "resume"), again)
        .when((did == "continue-free") & paid, F.when(status.isin("PENDING", "DEFERRED", "FAILED"), F.lit("DEFERRED")))
        .when(did == "continue-free", again)
        .when(did == "cancel", F.when(status.isin("PENDING", "DEFERRED"), F.lit("SKIPPED")))
    )
    next_tasks = tasks.join(done, F.col("job_id") == F.col("job"), "left").select(*[F.coalesce(moved, status).alias(c) if c == "status" else F.col(c) for c in tasks.columns])
    open_ = next_tasks.where(F.col("status").isin("PENDING", "RUNNING")).select(F.col("job_id").alias("o")).distinct()
    after = F
    for action, (_, state) in JOB_ACTIONS.items():
        after = after.when(did == action, F.lit(state))
    over = (did == "continue-free") & F.col("o").isNull()
    state = F.when(over, F.lit("COMPLETED")).otherwise(F.coalesce(after.otherwise(F.lit(None).cast("string")), status))
    j = jobs.join(done, F.col("id") == F.col("job"), "left").join(open_, F.col("id") == F.col("o"), "left")
    return j.select(*[state.alias(c) if c == "status" else F.col(c) for c in jobs.columns]), next_tasks


def approve_budgets(jobs: DataFrame, approvals: DataFrame, price: float, monthly_cap: float) -> DataFrame:
    """Jobs paused by the quota run again with what they spent and the extra budget as their total (Q-7).

    ``jobs``: ``(id, status, paid_requests_used, extra_budget_eur, …)``; ``approvals``: ``(job_id,
    extra_eur)``. Without paid requests, above the monthly cap or in another state nothing changes.
    """
    given = approvals.select(F.col("job_id").alias("j"), "extra_eur")
    ok = F.col("extra_eur").isNotNull() & (F.col("status") == "PAUSED_QUOTA") & (F.col("extra_eur") <= monthly_cap) & F.lit(price > 0 and monthly_cap > 0)
    change = {"status": F.lit("RUNNING"), "extra_budget_eur": F.floor((F.col("paid_requests_used") * price + F.col("extra_eur")) * 100 + 0.5) / 100}
    return jobs.join(given, F.col("id") == F.col("j"), "left").select(*[F.when(ok, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in jobs.columns])


def complete_jobs(tasks: DataFrame) -> DataFrame:
    """Jobs of which no task is open (Q-6). ``tasks``: ``(job_id, status)``."""
    return tasks.groupBy("job_id").agg(F.bool_and(~F.col("status").isin("PENDING", "RUNNING")).alias("complete")).where("complete").select("job_id")


#: Keywords of a job; more are a mistake in the configuration.
MOST_KEYWORDS = 1000


def job_tasks(areas: DataFrame, keywords: DataFrame, done: DataFrame) -> DataFrame:
    """Every area with every keyword, and whether the search is in cooldown.

    The product of areas and keywords is what a job is: every area is asked for every keyword.
    ``areas``: ``(area_key)``; ``keywords``: ``(keyword, language)``, a configured list of which at most
    ``MOST_KEYWORDS`` are accepted; ``done``: ``(tile_key, keyword, language)`` of recent searches. Without
    keywords there are no tasks.
    """
    words = keywords.select("keyword", "language").take(MOST_KEYWORDS + 1)
    if len(words) > MOST_KEYWORDS:
        raise ValueError(f"a job has at most {MOST_KEYWORDS} keywords")
    listed = F.array(*[F.struct(F.lit(w["keyword"]).cast("string").alias("keyword"), F.lit(w["language"]).cast("string").alias("language")) for w in words])
    tasks = areas.select("area_key", F.explode(listed if words else listed.cast("array<struct<keyword:string,language:string>>")).alias("w")).select("area_key", "w.*")
    recent = done.select(F.col("tile_key").alias("__t"), F.col("keyword").alias("__k"), F.col("language").alias("__l")).distinct().withColumn("__hit", F.lit(True))
    j = tasks.join(recent, (F.concat("area_key", F.lit("/root")) == F.col("__t")) & (F.col("keyword") == F.col("__k")) & (F.col("language") == F.col("__l")), "left")
    return j.select("area_key", "keyword", "language", F.coalesce("__hit", F.lit(False)).alias("in_cooldown"))


def overlap(new: DataFrame, domains: DataFrame, emails: DataFrame) -> DataFrame:
    """How many new records have a known or unknown domain and address (J30). ``new``: ``(id, domain, email)``."""
    d = domains.select(F.col("domain").alias("__d")).distinct()
    e = emails.select(F.col("email").alias("__e")).distinct()
    j = new.join(d, F.col("domain") == F.col("__d"), "left").join(e, F.col("email") == F.col("__e"), "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("domain").isNotNull() & F.col("__d").isNull()).alias("new_domains"), F.count_if(F.col("email").isNotNull() & F.col("__e").isNull()).alias("new_emails"))


def merge_settings(old: Column, new: Column, removed: Column) -> Column:
    """A settings map with new values on top and some keys away."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k) & ~F.array_contains(removed, k))
    return F.map_concat(kept, new)
