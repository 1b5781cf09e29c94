"""Locations, search areas and page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geo import city_box, local_name, quadrants, round_half_up
from terrane.functions.phones import e164
from terrane.functions.urls import clean_url, host_of, maps_url, platform_domain, platform_kind, social_key
from terrane.session import checkpointed


def location_tree(country: DataFrame, admin1: DataFrame, admin2: DataFrame | None, rows: DataFrame, radius: tuple[float, float, float], script: str | None = None, excluded_codes: tuple[str, ...] = ("PPLX", "PPLH")) -> DataFrame:
    """Country, regions and cities with parents and boxes.

    ``country``: ``(geonames_id, name, population)``, one row; ``admin1``, ``admin2``: ``(code, name,
    geonames_id)``; ``rows``: gazetteer rows. A city hangs on the deepest level known; boxes of
    regions and country are the unions of the cities below them.
    """
    country = country.select(F.col("geonames_id").alias("country_id"), "name", "population")
    facts = rows.select(F.col("geonames_id").alias("r_id"), "alternates", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("population").alias("r_population"))
    named = (lambda c: local_name(c, script)) if script else (lambda c: F.lit(None).cast("string"))
    blank = F.lit(None).cast("double")
    # A single row; without it regions and cities have no country above them.
    (top_row,) = country.take(1) or [{"country_id": None}]
    country_id = F.lit(top_row["country_id"]).cast("long")
    r1 = admin1.withColumn("country_id", country_id).select("code", "name", "geonames_id", F.col("country_id").alias("parent"), F.array("geonames_id", "country_id").alias("path"))
    regions = r1
    if admin2 is not None:
        above = r1.select(F.col("code").alias("a1"), F.col("geonames_id").alias("a1_id"))
        r2 = admin2.withColumn("country_id", country_id).join(above, F.substring_index("code", ".", 1) == F.col("a1"), "left")
        r2 = r2.select("code", "name", "geonames_id", F.coalesce("a1_id", "country_id").alias("parent"), F.array_compact(F.array("geonames_id", "a1_id", "country_id")).alias("path"))
        regions = r1.union(r2)
    deep = F.concat_ws(".", "admin1", "admin2")
    kept = rows.where((F.col("feature_class") == "P") & ~F.col("feature_code").isin(*excluded_codes) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    by_code = regions.select(F.col("code").alias("rc"), F.col("geonames_id").alias("region"), F.col("path").alias("region_path"))
    first = by_code.toDF("rc1", "region1", "path1")
    cities = kept.join(by_code if admin2 is not None else by_code.where("false"), deep == F.col("rc"), "left").join(first, F.col("admin1") == F.col("rc1"), "left").withColumn("country_id", country_id)
    box = city_box(F.col("lat"), F.col("lng"), F.col("population"), *radius)
    cities = cities.select("geonames_id", F.coalesce("region", "region1", "country_id").alias("parent"), "name", named(F.col("alternates")).alias("name_local"), "lat", "lng", F.nullif("population", F.lit(0)).alias("population"), box.alias("box"), F.coalesce("region_path", "path1", F.array("country_id")).alias("path"))
    rolled = cities.select(F.explode("path").alias("node"), "box.*").groupBy("node").agg(F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"))
    shape = ["geonames_id", "parent_id", "type", "name", "name_local", "lat", "lng", "population", "south", "west", "north", "east"]
    city_rows = cities.select("geonames_id", F.col("parent").alias("parent_id"), F.lit("CITY").alias("type"), "name", "name_local", "lat", "lng", "population", "box.*")
    region_rows = regions.join(facts, F.col("geonames_id") == F.col("r_id"), "left").join(rolled, F.col("geonames_id") == F.col("node"), "left")
    region_rows = region_rows.select("geonames_id", F.col("parent").alias("parent_id"), F.lit("REGION").alias("type"), "name", named(F.col("alternates")).alias("name_local"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"), F.nullif("r_population", F.lit(0)).alias("population"), "south", "west", "north", "east")
    top = country.join(facts, F.col("country_id") == F.col("r_id"), "left").join(rolled, F.col("country_id") == F.col("node"), "left")
    top = top.select(F.col("country_id").alias("geonames_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("COUNTRY").alias("type"), "name", named(F.col("alternates")).alias("name_local"), F.coalesce("r_lat", blank).alias("lat"), F.coalesce("r_lng", blank).alias("lng"), F.nullif("population", F.lit(0)).alias("population"), "south", "west", "north", "east")
    return city_rows.select(*shape).unionByName(region_rows.select(*shape)).unionByName(top.select(*shape))


#: Degrees of a grid cell in which boxes of cities meet places.
AREA_CELL = 0.25


def _inside(spots: DataFrame, big: DataFrame) -> DataFrame:
    """``(area, spot, first)``: spots inside the box of a big city of their country; ``first`` orders the cities."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / AREA_CELL), F.floor(F.col(high) / AREA_CELL)))
    boxes = big.select(F.col("country_code").alias("bc"), F.col("id").alias("area"), F.col("rank").alias("first"), "south", "west", "north", "east")
    boxes = boxes.withColumn("by", cells("south", "north")).withColumn("bx", cells("west", "east"))
    points = spots.select("country_code", "spot", "lat", "lng", F.floor(F.col("lat") / AREA_CELL).alias("cy"), F.floor(F.col("lng") / AREA_CELL).alias("cx"))
    met = points.join(boxes, F.col("country_code").eqNullSafe(F.col("bc")) & (F.col("cy") == F.col("by")) & (F.col("cx") == F.col("bx")))
    return met.where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east"))).select("area", "spot", "first")


def plan_search_areas(cities: DataFrame, min_population: int = 5000, include_rural: bool = True) -> DataFrame:
    """Search areas of each country: big cities first, the rest by district.

    In the order of population and id a big city is an area of its own unless it lies in the box of an area before it;
    every other place belongs to the first area whose box it lies in, or to the rural area of its
    district. Which cities are areas is found in rounds over the pairs of a grid join: a city that no undecided
    one before it contains is an area, and those in its box are not. There are as many rounds as
    boxes in a row that contain each other's cities, a few. Cities at one spot lie in the same boxes, so boxes meet
    spots instead of cities, and where the first big city of a spot holds the spot in its box, none after it can be
    an area. ``cities``: ``(country_code, id, name, lat,
    lng, population, parent_id, parent_name, south, west, north, east)``.
    """
    ranked = checkpointed(cities.withColumn("p", F.coalesce("population", F.lit(0))).withColumn("rank", F.struct((-F.col("p")).alias("p"), F.col("id").alias("id"))))
    ranked = ranked.withColumn("spot", F.struct("country_code", "lat", "lng"))
    spots = ranked.groupBy("spot").agg(F.min(F.when(F.col("p") >= min_population, F.struct("rank", "south", "west", "north", "east"))).alias("b"))
    holds = F.coalesce(F.col("spot.lat").between(F.col("b.south"), F.col("b.north")) & F.col("spot.lng").between(F.col("b.west"), F.col("b.east")), F.lit(False))
    spots = checkpointed(spots.select("spot", "spot.*", F.when(holds, F.col("b.rank")).alias("leader")))
    led = spots.where("leader IS NOT NULL").select(F.col("spot").alias("s"), "leader")
    big = checkpointed(ranked.where(F.col("p") >= min_population).join(led, F.col("spot") == F.col("s"), "left").where("leader IS NULL OR leader = rank").drop("s", "leader"))
    pairs = checkpointed(_inside(spots, big))
    waiting = big.select("id")
    own = big.select(F.col("id").alias("place"), F.col("rank").alias("own"), F.col("spot").alias("s"))
    among = checkpointed(pairs.join(own, (F.col("spot") == F.col("s")) & (F.col("first") < F.col("own"))).select("area", "place"))
    areas = None
    while not waiting.isEmpty():
        open_areas = among.join(waiting, F.col("area") == F.col("id"), "left_semi")
        taken = checkpointed(waiting.join(open_areas.select("place").distinct(), F.col("id") == F.col("place"), "left_anti"))
        lost = among.join(taken, F.col("area") == F.col("id"), "left_semi").select(F.col("place").alias("id")).distinct()
        waiting = checkpointed(waiting.join(taken, "id", "left_anti").join(lost, "id", "left_anti"))
        areas = taken if areas is None else checkpointed(areas.union(taken))
    areas = big.select("id").limit(0) if areas is None else areas
    home = pairs.join(areas, F.col("area") == F.col("id"), "left_semi").groupBy(F.col("spot").alias("s")).agg(F.min(F.struct("first", "area")).alias("h"))
    rest = ranked.join(areas.select(F.col("id").alias("a")), F.col("id") == F.col("a"), "left_anti").join(home, F.col("spot") == F.col("s"), "left")
    rest = rest.withColumn("home", F.when(F.col("h.first") < F.col("rank"), F.col("h.area"))).drop("s", "h")
    ids = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["id"])
    inner = rest.where("home IS NOT NULL").groupBy("home").agg(ids(F.col("rank")).alias("more"), ids(F.when(F.col("p") >= min_population, F.col("rank"))).alias("absorbed"))
    own = ranked.join(areas.select(F.col("id").alias("a")), F.col("id") == F.col("a"), "left_semi").join(inner, F.col("id") == F.col("home"), "left")
    empty = F.array().cast("array<bigint>")
    long = F.col("id").cast("long")
    planned = own.select(
        "country_code", F.concat(F.lit("city:"), F.col("id").cast("string")).alias("key"), F.lit("CITY").alias("kind"), long.alias("location_id"), "name",
        F.concat(F.array(long), F.coalesce(F.col("more").cast("array<bigint>"), empty)).alias("covered"), F.coalesce(F.col("absorbed").cast("array<bigint>"), empty).alias("absorbed"), "south", "west", "north", "east",
    )
    if not include_rural:
        return planned
    left = rest.where("home IS NULL").groupBy("country_code", "parent_id").agg(
        ids(F.col("rank")).alias("covered"), F.min_by("parent_name", "rank").alias("label"), F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"))
    parent = F.col("parent_id").cast("long")
    key = F.when(parent.isNotNull(), F.concat(F.lit("rural:"), parent.cast("string"))).otherwise(F.concat(F.lit("rural:place-"), F.col("covered")[0].cast("string")))
    rural = left.select(
        "country_code", key.alias("key"), F.lit("RURAL").alias("kind"), F.coalesce(parent, F.col("covered")[0].cast("long")).alias("location_id"), F.concat(F.coalesce("label", F.lit("Unassigned")), F.lit(" (rural)")).alias("name"),
        F.col("covered").cast("array<bigint>").alias("covered"), empty.alias("absorbed"), "south", "west", "north", "east",
    )
    return planned.unionByName(rural)


def split_saturated(tiles: DataFrame, saturated_at: int = 60, max_depth: int = 2) -> DataFrame:
    """The four children of each saturated tile above the greatest depth (Q-4).

    ``tiles``: ``(path, depth, found, south, west, north, east)``; a child's path adds its number.
    """
    full = tiles.where((F.col("found") >= saturated_at) & (F.col("depth") < max_depth))
    four = full.select("path", "depth", F.posexplode(quadrants(F.col("south"), F.col("west"), F.col("north"), F.col("east"))).alias("k", "box"))
    path = F.when(F.coalesce("path", F.lit("")) == "", F.col("k").cast("string")).otherwise(F.concat_ws(".", "path", "k"))
    return four.select(path.alias("path"), (F.col("depth") + 1).alias("depth"), "box.*")


def task_key(area: Column, path: Column, subcategory: Column, keyword: Column, language: Column) -> Column:
    """The deterministic key of a search (Q-5)."""
    root = F.when(F.coalesce(path, F.lit("")) == "", F.lit("root")).otherwise(path)
    return F.concat_ws("|", F.lit("discovery"), F.lit("GOOGLE_PLACES"), area, F.concat(F.lit("t:"), root), F.concat(F.lit("sub:"), subcategory), F.concat(F.lit("kw:"), keyword), language)


CHECKS = ("phone", "address", "website or social link", "email", "opening hours", "photos", "services and prices")


def page_records(rows: DataFrame) -> DataFrame:
    """Page records from open data: field precedence, links, sources, completeness.

    ``rows``: ``(id, country_code, city_name, primary_email, sells_online, google_place_id, a struct<id,
    name, address, postcode, locality, phones, websites, socials, emails, taxonomy_primary, lat, lng>,
    b struct<id, tel, website, instagram, facebook_id>)``; ``b`` may be null. Rows without a name in ``a``
    have no page.
    """
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.where(some(F.col("a.name")).isNotNull())
    phones = F.filter(F.transform("a.phones", lambda p: e164(p, F.col("country_code"))), lambda p: p.isNotNull())
    empty = F.array().cast("array<string>")
    link = lambda urls, src: F.transform(urls, lambda u: F.struct(u.alias("raw"), F.lit(src).alias("src")))
    from_b = F.array_compact(F.array(F.col("b.website"), F.concat(F.lit("https://instagram.com/"), F.regexp_replace("b.instagram", "^@", "")), F.concat(F.lit("https://www.facebook.com/"), F.col("b.facebook_id").cast("string"))))
    links = F.concat(link(F.coalesce("a.websites", empty), "a"), link(F.coalesce("a.socials", empty), "a"), link(F.coalesce(from_b, empty), "b"))
    seen = F.transform(links, lambda x: F.struct(clean_url(x["raw"]).alias("url"), x["src"].alias("src")))
    seen = F.filter(seen, lambda x: x["url"].isNotNull())
    typed = F.transform(seen, lambda x: F.struct(x["url"].alias("url"), x["src"].alias("src"), platform_kind(host_of(x["url"])).alias("kind"), social_key(host_of(x["url"])).alias("key"), platform_domain(host_of(x["url"])).alias("platform")))
    base = rows.withColumn("links", typed).withColumn("pa", F.get(phones, F.lit(0))).withColumn("pb", e164(F.col("b.tel"), F.col("country_code")))
    first = lambda test: F.get(F.filter("links", test), F.lit(0))
    site, booking = first(lambda x: x["kind"].isNull()), first(lambda x: x["kind"] == "BOOKING")
    base = base.withColumn("site", site).withColumn("booking", booking)
    social = F.filter("links", lambda x: (x["kind"] == "SOCIAL") & x["key"].isNotNull())
    keys = F.array_distinct(F.transform(social, lambda x: x["key"]))
    socials = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(social, lambda x: x["key"] == k), F.lit(0))["url"])))
    email = F.coalesce("primary_email", F.lower(F.trim(F.get("a.emails", F.lit(0)))))
    out = base.select(
        "id", F.trim("a.name").alias("name"), F.coalesce("a.taxonomy_primary", F.lit("")).alias("category"), F.coalesce(some(F.col("a.locality")), "city_name").alias("city"),
        some(F.col("a.address")).alias("address"), some(F.col("a.postcode")).alias("postcode"), "a.lat", "a.lng", F.coalesce("pa", "pb").alias("phone"), F.when(F.col("pa").isNull() & F.col("pb").isNotNull(), True).otherwise(False).alias("phone_b"),
        F.col("site.url").alias("website"), F.col("site.src").alias("site_src"), socials.alias("socials"), F.coalesce("booking.platform", F.regexp_replace(host_of(F.col("booking.url")), r"^www\.", "")).alias("booking_platform"), F.col("booking.src").alias("booking_src"),
        email.alias("email"), F.when(F.col("site.url").isNotNull(), F.col("sells_online")).alias("sells_online"), F.when(F.col("google_place_id").isNotNull(), maps_url(F.col("google_place_id"), F.trim("a.name"))).alias("maps_url"),
        F.exists("links", lambda x: (x["src"] == "b") & (x["kind"] == "SOCIAL") & x["key"].isNotNull()).alias("social_b"),
    )
    ok = F.array(F.col("phone").isNotNull(), F.col("address").isNotNull(), F.col("website").isNotNull() | (F.size("socials") > 0), F.col("email").isNotNull(), F.lit(False), F.lit(False), F.lit(False))
    n_ok = F.size(F.filter(ok, lambda x: x))
    missing = F.filter(F.array(*[F.lit(c) for c in CHECKS]), lambda c, i: ~F.get(ok, i))
    used_b = F.col("phone_b") | (F.coalesce("site_src", F.lit("a")) == "b") | (F.coalesce("booking_src", F.lit("a")) == "b") | F.col("social_b")
    score = round_half_up(100 * (2 + n_ok) / (2 + len(CHECKS)), 0).cast("int")
    return out.select("*", score.alias("completeness"), missing.alias("missing"), used_b.alias("uses_second_source")).drop("phone_b", "site_src", "booking_src", "social_b")
