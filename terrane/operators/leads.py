"""Leads: filters, quality gate, score, chains, primary subcategory, export scope, pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.fixed import CLOSED_PLACES, REVIEW_REASONS
from terrane.functions.text import fold, is_real_city, keyword_hits, like_escaped
from terrane.operators.dedupe import DedupeRules, find_duplicates, merged_records, survivors
from terrane.operators.joins import first_of, not_suppressed, small, word_prefixes


@dataclass(frozen=True)
class QualityRules:
    email_syntax: bool = True
    email_mx: bool = True
    role_email: bool = True
    real_city: bool = True
    category: bool = True
    valid_phone: bool = True


@dataclass(frozen=True)
class ScoreRules:
    own_domain_email: int = 30
    has_website: int = 15
    valid_phone: int = 10
    good_rating: int = 10
    good_rating_min: float = 4.0
    good_rating_min_count: int = 5
    open: int = 10
    chain: int = -50
    sells_online: int = 20


@dataclass(frozen=True)
class LeadRules:
    dedupe: DedupeRules = field(default_factory=DedupeRules)
    min_places_per_domain: int = 3
    quality: QualityRules = field(default_factory=QualityRules)
    score: ScoreRules = field(default_factory=ScoreRules)


@dataclass(frozen=True)
class LeadFilters:
    """F01; None leaves a filter out. ``reasons`` keeps leads held for any of them."""

    country: str | None = None
    has_email: bool | None = None
    city: str | None = None
    category: str | None = None
    status: str | None = None
    email_type: str | None = None
    min_score: int | None = None
    needs_review: bool | None = None
    reasons: tuple[str, ...] = ()
    chain: bool | None = None
    sells_online: bool | None = None
    has_rating: bool | None = None
    exported: bool | None = None
    q: str | None = None


def lead_predicate(f: LeadFilters) -> Column:
    """The filter as one predicate over lead columns.

    ``q`` matches name, domain or email without regard to case; its ``%`` and ``_`` are literal.
    """
    tests: list[Column] = []

    def add(value: object, test: Column | None = None) -> None:
        if value is not None and test is not None:
            tests.append(test)

    add(f.country, F.col("country_code") == F.lit(f.country))
    add(f.has_email, F.col("email").isNotNull() == F.lit(f.has_email))
    add(f.city, F.lower("city_name") == F.lower(F.lit(f.city)))
    add(f.category, F.array_contains("categories", F.lit(f.category)) if f.category is not None else None)
    add(f.status, F.col("status") == F.lit(f.status))
    add(f.email_type, F.col("email_type") == F.lit(f.email_type))
    add(f.min_score, F.col("score") >= F.lit(f.min_score))
    add(f.needs_review, (F.size("review_reasons") > 0) == F.lit(f.needs_review))
    if f.reasons:
        tests.append(F.arrays_overlap("review_reasons", F.array(*[F.lit(r) for r in f.reasons])))
    add(f.chain, F.col("is_chain") == F.lit(f.chain))
    add(f.sells_online, F.coalesce("sells_online", F.lit(False)) == F.lit(f.sells_online))
    add(f.has_rating, F.col("rating").isNotNull() == F.lit(f.has_rating))
    add(f.exported, F.col("exported_at").isNotNull() == F.lit(f.exported))
    if f.q:
        pattern = F.concat(F.lit("%"), like_escaped(F.lit(f.q)), F.lit("%"))
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), pattern, F.lit("\\")), F.lit(False)) for c in ("name", "website_domain", "email")]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def lead_page(leads: DataFrame, filters: LeadFilters, page: int = 1, size: int = 50) -> DataFrame:
    """One page by score, name and id."""
    ordered = leads.where(lead_predicate(filters)).orderBy(F.col("score").desc(), "name", "id")
    return ordered.offset((page - 1) * size).limit(size)


def facet(leads: DataFrame, column: str, most: int | None = 10, unknown: str = "Unknown") -> DataFrame:
    """Leads of each value, most first, ties by name."""
    counted = leads.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")
    return counted if most is None else counted.limit(most)


def review_reasons(rules: QualityRules = QualityRules()) -> Column:
    """Reasons why a lead fails the gate, in fixed order; empty without a primary email.

    Over ``primary`` (struct of syntax_valid, mx_valid, is_own_domain, is_role; null if none),
    ``city_name``, ``country_code``, ``has_category`` and ``phone_valid``.
    """
    primary, mx = F.col("primary"), F.col("primary.mx_valid")
    tests = {
        "EMAIL_SYNTAX": F.lit(rules.email_syntax) & ~F.col("primary.syntax_valid"),
        "EMAIL_NO_MX": F.lit(rules.email_mx) & (mx == F.lit(False)),
        "EMAIL_MX_UNKNOWN": F.lit(rules.email_mx) & mx.isNull(),
        "EMAIL_ROLE": F.lit(rules.role_email) & F.coalesce("primary.is_role", F.lit(False)),
        "NO_REAL_CITY": F.lit(rules.real_city) & ~is_real_city(F.col("city_name"), F.col("country_code")),
        "NO_CATEGORY": F.lit(rules.category) & ~F.col("has_category"),
        "PHONE_INVALID": F.lit(rules.valid_phone) & ~F.col("phone_valid"),
    }
    found = F.array_compact(F.array(*[F.when(tests[r], F.lit(r)) for r in REVIEW_REASONS]))
    return F.when(primary.isNull(), F.array().cast("array<string>")).otherwise(found)


def lead_score(rules: ScoreRules = ScoreRules()) -> Column:
    """Additive score of a lead."""
    yes = lambda test, points: F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(F.lit(0))
    rated = (F.col("rating") >= rules.good_rating_min) & (F.coalesce("rating_count", F.lit(0)) >= rules.good_rating_min_count)
    return (
        yes(F.col("primary.is_own_domain"), rules.own_domain_email)
        + yes(F.col("website_domain") != "", rules.has_website)
        + yes(F.col("phone_valid"), rules.valid_phone)
        + yes(rated, rules.good_rating)
        + yes(F.col("business_status") == "OPERATIONAL", rules.open)
        + yes(F.col("is_chain"), rules.chain)
        + yes(F.col("sells_online"), rules.sells_online)
    )


def detect_chains(places: DataFrame, blocklist: DataFrame, min_places: int = 3) -> DataFrame:
    """``(id, chain_reason)``: BLOCKLIST by name or first words or domain, else SHARED_DOMAIN.

    ``places``: ``(id, name_normalized, website_domain)``; ``blocklist``: ``(name_normalized, domain)``.
    The blocklist counts over the shared domain. Free-mail domains are not left out here.
    """
    names = small(blocklist.where(F.coalesce("name_normalized", F.lit("")) != "").select(F.col("name_normalized").alias("__n")).distinct())
    domains = small(blocklist.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("__d")).where(F.coalesce("__d", F.lit("")) != "").distinct())
    site = places.where(F.coalesce("website_domain", F.lit("")) != "")
    by_name = places.select("id", F.explode(word_prefixes(F.col("name_normalized"))).alias("p")).join(names, F.col("p") == F.col("__n"), "left_semi").select("id")
    by_domain = site.join(domains, F.col("website_domain") == F.col("__d"), "left_semi").select("id")
    often = site.groupBy(F.col("website_domain").alias("__w")).count().where(F.col("count") >= min_places).select("__w")
    shared = site.join(often, F.col("website_domain") == F.col("__w"), "left_semi").select("id")
    marked = by_name.union(by_domain).select("id", F.lit("BLOCKLIST").alias("r")).union(shared.select("id", F.lit("SHARED_DOMAIN").alias("r")))
    return marked.groupBy("id").agg(F.min("r").alias("chain_reason"))


def primary_subcategory(candidates: DataFrame) -> DataFrame:
    """``(id, subcategory_id)``: the candidate whose keywords the name has most of, ties to the first found.

    ``candidates``: ``(id, name_normalized, position, subcategory_id, keywords)``.
    """
    scored = candidates.withColumn("hits", keyword_hits(F.col("name_normalized"), F.col("keywords")))
    return first_of(scored.select("id", "subcategory_id", "hits", "position"), ["id"], [-F.col("hits"), F.col("position")]).select("id", "subcategory_id")


def export_scope(scope: str = "new") -> Column:
    """Gate passed, no chain, not closed for good or for a time; new: never exported; all: new or exported.

    Over ``review_reasons``, ``is_chain``, ``business_status``, ``status`` and the primary address's
    ``email_status`` and ``exported_at``.
    """
    base = _open_leads()
    if scope == "new":
        return base & (F.col("status") == "NEW") & (F.col("email_status") == "NEW") & F.col("exported_at").isNull()
    return base & F.col("status").isin("NEW", "EXPORTED") & F.col("email_status").isin("NEW", "EXPORTED")


def _open_leads() -> Column:
    return (F.size("review_reasons") == 0) & ~F.col("is_chain") & ~F.col("business_status").isin(*CLOSED_PLACES)


def ready_leads(leads: DataFrame, suppression: DataFrame, status_of_email: bool = True) -> DataFrame:
    """Leads ready for export and not suppressed; ``status_of_email`` tells the two definitions apart."""
    scope = export_scope("new") if status_of_email else _open_leads() & (F.col("status") == "NEW") & F.col("exported_at").isNull()
    return not_suppressed(leads.where(F.col("email").isNotNull() & scope), F.col("email"), suppression)


def place_words(locations: DataFrame, min_population: int = 1000, most: int = 20_000) -> Column:
    """Words of at least three letters in names of countries, regions and towns, as one literal.

    Locations of one country are a few thousand rows; their distinct words are collected. More than ``most`` words are an error:
    those are the places of several countries, whose names are compared country by country.
    """
    named = locations.where(F.col("type").isin("COUNTRY", "REGION") | (F.col("population") >= min_population))
    words = named.select(F.explode(F.split(fold(F.col("name")), r"[^\p{L}\p{N}]+")).alias("w")).where(F.length("w") >= 3).distinct()
    found = [r["w"] for r in words.orderBy("w").take(most + 1)]
    if len(found) > most:
        raise ValueError(f"the locations have more than {most} words")
    return F.array(*[F.lit(w) for w in found]).cast("array<string>")


@dataclass
class Pipeline:
    """``places``: the next snapshot; ``mapping``: (loser_id, survivor_id); ``possible``: pairs to look at."""

    places: DataFrame
    mapping: DataFrame
    possible: DataFrame


def run_lead_pipeline(places: DataFrame, emails: DataFrame, blocklist: DataFrame, rules: LeadRules = LeadRules(), free_domains: DataFrame | None = None) -> Pipeline:
    """Duplicates merged, chains, review reasons and scores of one or more countries.

    ``emails``: ``(place_id, email, is_primary, is_own_domain, email_type, mx_valid)``. A second run over
    its own result changes nothing.
    """
    from terrane.functions.email import is_role_mailbox, primary_rank

    found = find_duplicates(places, rules.dedupe, free_domains)
    has_primary = emails.where("is_primary").select(F.col("place_id").alias("p")).distinct().withColumn("has_primary_email", F.lit(True))
    candidates = places.join(found.members.withColumnRenamed("id", "m"), F.col("id") == F.col("m")).join(has_primary, F.col("id") == F.col("p"), "left")
    chosen = survivors(candidates.select("group_id", "id", "status", F.coalesce("has_primary_email", F.lit(False)).alias("has_primary_email"))).withColumnRenamed("group_id", "g")
    mapping = found.members.join(chosen, F.col("group_id") == F.col("g")).select("id", "group_id", "survivor_id")
    merged = merged_records(places, mapping).drop("group_id", "n_merged")
    keep = [c for c in places.columns if c not in merged.columns]
    rest = places.select(F.col("id").alias("__id"), *keep)
    merged = merged.join(rest, F.col("id") == F.col("__id")).select(*places.columns)
    single = places.join(mapping.select(F.col("id").alias("__m")), F.col("id") == F.col("__m"), "left_anti")
    current = single.unionByName(merged)
    losers = mapping.where("id <> survivor_id").select(F.col("id").alias("loser_id"), "survivor_id")
    moved = emails.join(losers, F.col("place_id") == F.col("loser_id"), "left").withColumn("place_id", F.coalesce("survivor_id", "place_id"))
    order = [(~F.col("is_primary") | F.col("loser_id").isNotNull()).cast("int"), -primary_rank(F.col("is_own_domain"), F.col("email_type"), F.col("mx_valid")), F.col("email")]
    primary = first_of(moved.drop("survivor_id"), ["place_id"], order).select(F.col("place_id").alias("pp"), "email", F.struct(F.lit(True).alias("syntax_valid"), "mx_valid", "is_own_domain", is_role_mailbox(F.col("email")).alias("is_role")).alias("primary"))
    chains = detect_chains(current, blocklist, rules.min_places_per_domain).withColumnRenamed("id", "cc")
    facts = current.drop("email", "is_chain", "chain_reason", "review_reasons", "score").join(primary, F.col("id") == F.col("pp"), "left").join(chains, F.col("id") == F.col("cc"), "left").withColumn("is_chain", F.col("chain_reason").isNotNull())
    scored = facts.withColumn("review_reasons", review_reasons(rules.quality)).withColumn("score", lead_score(rules.score)).drop("pp", "cc", "primary")
    return Pipeline(scored, losers, found.possible)
