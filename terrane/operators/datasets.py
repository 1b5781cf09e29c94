"""From staged rows to places: normalisation, addresses, the merge into the snapshot, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.email import email_domain, email_type, is_disposable, is_own_domain, normalize_email, reject_reason
from terrane.functions.phones import e164
from terrane.functions.text import like_escaped, matching_name
from terrane.functions.urls import clean_url, host_of, own_domain, platform_kind
from terrane.operators.joins import city_of_points, classify_places, first_of, not_suppressed
from terrane.operators.services import first_owner
from terrane.operators.state import insert_ignore, upsert


def normalize_places(raw: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Cleaned name, website, domain, phone and city of each place.

    ``raw``: ``(id, name, website, phone, country_code, lat, lng)`` and any further columns, which stay.
    """
    phone = F.nullif(F.trim("phone"), F.lit(""))
    out = raw.withColumns({"name_normalized": matching_name(F.col("name")), "website": clean_url(F.col("website")), "phone_raw": phone, "phone_e164": e164(F.col("phone"), F.col("country_code"))})
    out = out.withColumns({"website_domain": own_domain(F.col("website")), "platform": platform_kind(host_of(F.col("website"))), "phone_valid": F.col("phone_e164").isNotNull()}).drop("phone")
    if cities is None:
        return out
    towns = city_of_points(out.select(F.col("id").alias("point_id"), "lat", "lng"), cities).select(F.col("point_id").alias("__p"), "city_id", "city_name", F.col("method").alias("city_method"))
    return out.join(towns, F.col("id") == F.col("__p"), "left").drop("__p")


def prepare_emails(rows: DataFrame) -> DataFrame:
    """Each place's usable addresses, once, with their classes (E13). ``rows``: ``(id, website_domain, emails)``."""
    # Dealt out evenly and by a fixed number, as few bytes can list very many addresses; and cleaned in one expression,
    # where each is read once: a filter after the spread would have its normal form made anew for each test.
    dealt = rows.select("id", "website_domain", "emails").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = F.transform("emails", lambda raw, pos: F.struct(pos.alias("pos"), raw.alias("raw"), normalize_email(raw).alias("email")))
    usable = F.filter(read, lambda x: x["email"].isNotNull() & reject_reason(x["email"]).isNull())
    good = dealt.select("id", "website_domain", F.inline(usable))
    once = first_of(good, ["id", "email"], [F.col("pos")])
    domain = email_domain(F.col("email"))
    return once.select("id", "email", F.trim("raw").alias("original"), domain.alias("domain"), email_type(F.col("email")).alias("email_type"), is_own_domain(domain, F.col("website_domain")).alias("is_own_domain"), is_disposable(domain).alias("is_disposable"), "pos")


@dataclass
class Merged:
    """The next snapshots of places (``__inserted`` tells new ones) and of their addresses."""

    places: DataFrame
    emails: DataFrame


def merge_staged(places: DataFrame, emails: DataFrame, staged: DataFrame, rules: DataFrame, suppression: DataFrame, cities: DataFrame | None = None) -> Merged:
    """Staged rows of mapped categories merged into the places by their source id.

    ``places``: ``(id, overture_id, google_place_id, name, name_normalized, address, lat, lng, city_id,
    city_name, website, website_domain, phone_raw, phone_e164, phone_valid)``; ``emails``: ``(email,
    place_id, email_type, is_own_domain)``; ``staged``: ``(id, name, website, phone, country_code, lat,
    lng, address, emails, taxonomy_hierarchy, basic_category, taxonomy_primary)``. Places of the first
    source keep their name; other fields are filled. New ids follow the largest one in the order of the
    source ids. An address goes to its first place, a known or suppressed one nowhere.
    """
    kinds = classify_places(staged.select(F.col("id").alias("row_id"), "taxonomy_hierarchy", "basic_category", "taxonomy_primary"), rules).where("kind = 'mapped'").select("row_id")
    kept = staged.join(kinds, F.col("id") == F.col("row_id"), "left_semi")
    clean = normalize_places(kept, cities)
    for c in ("city_id", "city_name"):
        if c not in clean.columns:
            clean = clean.withColumn(c, F.lit(None).cast(dict(places.dtypes)[c]))
    new = clean.withColumnRenamed("id", "overture_id").select("overture_id", "name", "name_normalized", "address", "lat", "lng", "city_id", "city_name", "website", "website_domain", "phone_raw", "phone_e164", "phone_valid")
    theirs = F.col("o.google_place_id").isNull()
    follow = lambda c, lead: F.when(F.col(f"o.{lead}").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    name = lambda c: F.when(theirs, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    overrides = {"name": name("name"), "name_normalized": name("name_normalized"), "address": F.coalesce(F.when(theirs, F.col("n.address")), "o.address", "n.address"), "website_domain": follow("website_domain", "website"), "phone_e164": follow("phone_e164", "phone_raw"), "phone_valid": follow("phone_valid", "phone_raw")}
    with_id, without = places.where("overture_id IS NOT NULL"), places.where("overture_id IS NULL")
    state = upsert(with_id, new, "overture_id", fill_only=("lat", "lng", "city_id", "city_name", "website", "phone_raw"), overrides=overrides)
    top = places.agg(F.max("id")).first()[0] or 0
    fresh = state.where("__inserted")
    numbered = number_rows(fresh, "overture_id", top)
    every = state.where("NOT __inserted").unionByName(numbered).unionByName(without.withColumn("__inserted", F.lit(False)))
    found = prepare_emails(clean.select(F.col("id"), "website_domain", "emails"))
    owners = every.select(F.col("overture_id").alias("__o"), F.col("id").alias("place"))
    placed = found.join(owners, F.col("id") == F.col("__o"))
    first = first_owner(placed.select("email", F.col("place").alias("place_order"), F.col("pos").alias("email_order"), F.struct("place", "email_type", "is_own_domain").alias("place_id")))
    fresh_emails = not_suppressed(first.select("email", F.col("place_id.place").alias("place_id"), "place_id.email_type", "place_id.is_own_domain"), F.col("email"), suppression)
    return Merged(every, insert_ignore(emails, fresh_emails.select(emails.columns), ["email"]))


def number_rows(rows: DataFrame, order: str, after: int, column: str = "id") -> DataFrame:
    """Ids that follow ``after`` in the order of a key: ranks in ranges, plus the rows of the ranges before."""
    from terrane.operators.joins import small
    from terrane.session import checkpointed

    ranged = checkpointed(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    joined = ranged.withColumn("__n", rank).join(small(before), F.col("__range") == F.col("__r"))
    kind = dict(rows.dtypes)[column]
    return joined.withColumn(column, (F.col("__n") + F.col("__before") + after).cast(kind)).select(rows.columns)


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many places a cleaning changed, and their platforms (A23). Both ``(id, website, platform, …)``."""
    j = before.select("id", F.col("website").alias("old")).join(after.select(F.col("id").alias("i"), "website", "platform", "phone_valid"), F.col("id") == F.col("i"))
    return j.groupBy(F.coalesce("platform", F.lit("OWN")).alias("platform")).agg(F.count("*").alias("n"), F.count_if(~F.col("old").eqNullSafe(F.col("website"))).alias("changed"), F.count_if(F.col("phone_valid")).alias("valid_phones"))


def page_scope(status: str = "unpublished", types: tuple[str, ...] = (), chains: bool = False, min_completeness: int = 0) -> Column:
    """Which places are candidates for pages (F04): status, types, not closed, chains or not, completeness."""
    page = F.coalesce("page_status", F.lit("UNPUBLISHED"))
    test = (F.col("business_status") != "CLOSED_PERMANENTLY") & (page != "REMOVED") & (F.col("completeness") >= min_completeness)
    if status != "all":
        test = test & (page == status.upper())
    if types:
        test = test & F.col("taxonomy_primary").isin(*types)
    return test if chains else test & ~F.col("is_chain")


def suppression_search(reason: str | None = None, q: str | None = None) -> Column:
    """Entries of a reason and with a text in address or domain, or of exactly that address."""
    test = F.lit(True) if reason is None else F.col("reason") == reason
    if q:
        pattern = F.concat(F.lit("%"), like_escaped(F.lit(q)), F.lit("%"))
        like = lambda c: F.coalesce(F.ilike(F.col(c), pattern, F.lit("\\")), F.lit(False))
        exact = F.coalesce(F.col("email_hash") == F.sha2(normalize_email(F.lit(q)), 256), F.lit(False))
        test = test & (like("email_normalized") | like("domain") | exact)
    return test
