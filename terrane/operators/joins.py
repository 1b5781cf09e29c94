"""Joins that an equality alone does not express, written so that the plan stays an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.fixed import BAND_DEGREES
from terrane.functions.geo import distance_km
from terrane.session import checkpointed

#: Rows of a side up to which it is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``most`` rows, else as it is. For narrow rows of numbers and short names."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(most + 1)) <= most else df


def anti_join_any(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of ``left`` that match no row of ``right`` by any of the keys: one anti-join a key.

    A null key matches nothing.
    """
    out = left
    for k, (mine, theirs) in enumerate(keys):
        name = f"__key_{k}"
        other = right.select(theirs.alias(name)).where(F.col(name).isNotNull()).distinct()
        out = out.join(other, mine == F.col(name), "left_anti")
    return out


def not_suppressed(rows: DataFrame, email: Column, suppression: DataFrame) -> DataFrame:
    """Rows whose address is blocked neither by hash nor, for rows without a hash, by domain."""
    hashes = suppression.select(F.col("email_hash").alias("__hash")).where("__hash IS NOT NULL").distinct()
    domains = suppression.where("email_hash IS NULL").select(F.col("domain").alias("__domain")).where("__domain IS NOT NULL").distinct()
    kept = rows.join(hashes, F.sha2(email, 256) == F.col("__hash"), "left_anti")
    return kept.join(domains, F.substring_index(email, "@", -1) == F.col("__domain"), "left_anti")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order.

    A minimum by a struct, summed up in the map tasks, so a key with many rows is no burden.
    ``order`` columns sort ascending, nulls first; ties go to the smaller row by its columns, but for
    maps, which have no order.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    ties = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return df.groupBy(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]).agg(F.min_by(row, F.struct(F.struct(*order), F.struct(*ties))).alias("__row")).select("__row.*")


#: Boxes left on a cell up to which points meet all of them, and how often cells are halved at most.
CELL_BOXES, CELL_HALVINGS = 16, 3


def _best_on_cells(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes with ``rank`` by the cells they lie on, but for those that rank below one which covers the cell whole."""
    spread = boxes.select("*", F.explode(F.sequence(F.floor(F.col("south") / size), F.floor(F.col("north") / size))).alias("cy")).select(
        "*", F.explode(F.sequence(F.floor(F.col("west") / size), F.floor(F.col("east") / size))).alias("cx")
    )
    # A little more than the cell, as a point's cell is rounded.
    over = lambda c, low, high: (F.col(low) <= (F.col(c) - 1e-6) * size) & (F.col(high) >= (F.col(c) + 1 + 1e-6) * size)
    whole = spread.where(over("cy", "south", "north") & over("cx", "west", "east")).groupBy(F.col("cy").alias("wy"), F.col("cx").alias("wx")).agg(F.max("rank").alias("first"))
    return spread.join(whole, (F.col("cy") == F.col("wy")) & (F.col("cx") == F.col("wx")), "left").where("first IS NULL OR rank >= first").drop("wy", "wx", "first")


def largest_box(points: DataFrame, boxes: DataFrame, size: float = 0.25) -> DataFrame:
    """Points with the most populous box that contains them, ties to the smaller id.

    ``points``: ``(point_id, lat, lng)``; ``boxes``: ``(box_id, name, population, south, west, north,
    east)``. Boxes are laid over grid cells of ``size`` degrees, so the join is on the cell. Of the boxes on a
    cell, those after the first that covers it whole can hold no point's best box and do not meet the points.
    Where many are left, the cells are halved, a few times at most.
    """
    rank = F.struct(F.coalesce("population", F.lit(0)).alias("p"), (-F.col("box_id")).alias("i"))
    bounds = ("south", "west", "north", "east")
    boxes = checkpointed(boxes.groupBy(*bounds).agg(F.max(F.struct(rank.alias("rank"), "box_id", "name")).alias("b")).select("b.*", *bounds))
    met = checkpointed(_best_on_cells(boxes, size))
    for _ in range(CELL_HALVINGS):
        if met.groupBy("cy", "cx").count().where(F.col("count") > CELL_BOXES).isEmpty():
            break
        size /= 2
        met = checkpointed(_best_on_cells(boxes, size))
    placed = points.select("point_id", "lat", "lng", F.floor(F.col("lat") / size).alias("py"), F.floor(F.col("lng") / size).alias("px"))
    inside = placed.join(small(met), (F.col("py") == F.col("cy")) & (F.col("px") == F.col("cx"))).where("lat BETWEEN south AND north AND lng BETWEEN west AND east")
    return inside.groupBy("point_id").agg(F.max_by(F.struct("box_id", "name"), "rank").alias("b")).select("point_id", "b.box_id", "b.name")


def in_any_box(points: DataFrame, boxes: DataFrame, size: float = 0.25) -> DataFrame:
    """Points inside at least one box, each once."""
    ids = largest_box(points, boxes.select("box_id", F.lit("").alias("name"), F.lit(0).alias("population"), "south", "west", "north", "east"), size)
    return points.join(ids.select(F.col("point_id").alias("__in")), F.col("point_id") == F.col("__in"), "left_semi")


def _nearest_within(points: DataFrame, centers: DataFrame, km: float, most_reach: int | None = None) -> DataFrame:
    """``nearest`` by cells as high as ``km``; with ``most_reach`` only points that look at so many columns each way."""
    size = km / 111.0
    columns = int(360 // size) or 1
    width = 360.0 / columns
    near = points.select(
        "point_id", "lat", "lng",
        F.floor((F.col("lng") + 180) / width).alias("px"),
        F.least(F.ceil(F.lit(size) / (F.greatest(F.cos(F.radians(F.least(F.abs("lat") + 2 * size, F.lit(90.0)))), F.lit(1e-6)) * width)), F.lit(columns // 2 + 1)).cast("int").alias("reach"),
    )
    near = near if most_reach is None else near.where(F.col("reach") <= most_reach)
    near = near.select("*", F.explode(F.sequence(F.floor(F.col("lat") / size) - 1, F.floor(F.col("lat") / size) + 1)).alias("py"))
    near = near.select("point_id", "lat", "lng", "py", F.explode(F.array_distinct(F.transform(F.sequence(-F.col("reach"), F.col("reach")), lambda d: F.pmod(F.col("px") + d, F.lit(columns))))).alias("px"))
    cells = _in_cells(centers, km)
    joined = near.join(small(cells), (F.col("py") == F.col("cy")) & (F.col("px") == F.col("cx"))).withColumn("km", distance_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
    best = F.min(F.struct("km", "center_id", "name"))
    return joined.where(F.col("km") <= km).groupBy("point_id").agg(best.alias("b")).select("point_id", "b.center_id", "b.name", "b.km")


def _in_cells(centers: DataFrame, km: float) -> DataFrame:
    size = km / 111.0
    columns = int(360 // size) or 1
    return centers.select("*", F.floor(F.col("c_lat") / size).alias("cy"), F.pmod(F.floor((F.col("c_lng") + 180) / (360.0 / columns)), F.lit(columns)).alias("cx"))


#: Centres in a cell up to which points meet all of them, and how often cells are halved at most.
CELL_CENTERS, HALVINGS = 8, 10


def nearest(points: DataFrame, centers: DataFrame, max_km: float) -> DataFrame:
    """Points with the nearest centre within ``max_km``, ties to the smaller id.

    ``points``: ``(point_id, lat, lng)`` with distinct ids; ``centers``: ``(center_id, name, c_lat, c_lng)``.
    Cells are as high as the distance; a point meets the centres of its row of cells and the two next to
    it, in as many columns as the distance spans at its latitude; at the poles and the date line columns wrap
    around. Where centres are crowded, the distance is first halved until no cell holds many: a
    point with a centre within the smaller distance is done, the others go on with the doubled one.
    """
    order = F.struct("center_id", "name")
    centers = checkpointed(centers.groupBy("c_lat", "c_lng").agg(F.min(order).alias("c")).select("c.*", "c_lat", "c_lng"))
    steps = [max_km]
    while len(steps) <= HALVINGS and not _in_cells(centers, steps[-1]).groupBy("cy", "cx").count().where(F.col("count") > CELL_CENTERS).isEmpty():
        steps.append(steps[-1] / 2)
    found, left = None, points.select("point_id", "lat", "lng")
    for km in reversed(steps):
        best = _nearest_within(left, centers, km, None if km == max_km else 3)
        if km != max_km:
            best = checkpointed(best)
            left = checkpointed(left.join(best.select(F.col("point_id").alias("__done")), F.col("point_id") == F.col("__done"), "left_anti"))
        found = best if found is None else found.union(best)
    return found


def city_of_points(points: DataFrame, cities: DataFrame, min_population: int = 5000, max_km: float = 8.0) -> DataFrame:
    """``(point_id, city_id, city_name, method)``: largest containing town, else nearest place, else fallback.

    ``points`` may have ``fallback_city_id``; ``cities``: ``(id, name, lat, lng, population, south, west,
    north, east)``. Points without any city are not returned.
    """
    towns = cities.where(F.col("south").isNotNull() & (F.coalesce("population", F.lit(0)) >= min_population)).select(F.col("id").alias("box_id"), "name", "population", "south", "west", "north", "east")
    located = points.where("lat IS NOT NULL AND lng IS NOT NULL")
    area = largest_box(located, towns).select("point_id", F.col("box_id").alias("city_id"), F.col("name").alias("city_name"), F.lit("CITY_AREA").alias("method"))
    centers = cities.select(F.col("id").alias("center_id"), "name", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    close = nearest(located, centers, max_km).select("point_id", F.col("center_id").alias("city_id"), F.col("name").alias("city_name"), F.lit("NEAREST").alias("method"))
    found = area.union(close)
    if "fallback_city_id" in points.columns:
        fall = points.join(cities.select(F.col("id").alias("__id"), F.col("name").alias("city_name")), F.col("fallback_city_id") == F.col("__id")).select("point_id", F.col("__id").alias("city_id"), "city_name", F.lit("FALLBACK").alias("method"))
        found = found.union(fall)
    order = F.array_position(F.array(F.lit("CITY_AREA"), F.lit("NEAREST"), F.lit("FALLBACK")), F.col("method"))
    return first_of(found, ["point_id"], [order])


def edges_of(rings: DataFrame) -> DataFrame:
    """Edges of polygon rings by feature and band.

    ``rings``: ``(feature_id, points array<struct<x, y>>)`` for every ring, holes included. Bands are as
    high as ``BAND_DEGREES``, counted from the feature's southern bound.
    """
    pairs = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    lines = rings.where(F.size("points") > 1).select("feature_id", F.explode(pairs).alias("e")).select("feature_id", "e.*")
    bounds = lines.groupBy(F.col("feature_id").alias("f")).agg(F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"))
    joined = lines.join(bounds, lines.feature_id == bounds.f).where("y1 <> y2")
    band = lambda y: F.floor((y - F.col("south")) / BAND_DEGREES)
    return joined.select("feature_id", "x1", "y1", "x2", "y2", "south", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("band"))


def inside_outline(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points inside at least one feature by the even-odd rule.

    ``points``: ``(point_id, x, y)``. Edges and points meet in bands of latitude that all features share,
    so the join is on the band; bands of a feature's own would ask which features a point may be in.
    """
    band = lambda y: F.floor(y / BAND_DEGREES)
    lines = edges.select("feature_id", "x1", "y1", "x2", "y2").distinct()
    spread = lines.withColumn("at", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    hit = points.withColumn("b", band(F.col("y"))).join(spread, F.col("b") == F.col("at")).where(((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")))
    return hit.groupBy("point_id", "feature_id").count().where("count % 2 = 1").select("point_id").distinct()


def longest_prefix(rows: DataFrame, path: Column, rules: DataFrame, separator: str = " > ") -> DataFrame:
    """Rows with the rule that is the longest prefix of their path in whole steps.

    ``rows`` has ``row_id``; ``rules`` ``(match, …)`` with distinct matches. Rows without a rule are kept
    with nulls.
    """
    steps = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), separator))
    spread = rows.select("row_id", F.explode(prefixes).alias("__prefix"))
    hit = spread.join(rules, spread["__prefix"] == rules["match"]).select("row_id", F.struct(F.length("match").alias("__n"), *rules.columns).alias("r"))
    best = hit.groupBy(F.col("row_id").alias("__row")).agg(F.max("r").alias("r"))
    return rows.join(best, rows.row_id == best["__row"], "left").select(*rows.columns, *[F.col(f"r.{c}").alias(c) for c in rules.columns])


def classify_places(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Kind (mapped, excluded, unmapped), subcategory, reason and rule of each place.

    Path rules apply to places with a taxonomy path; ``basic:`` rules only to those without, to
    the basic category first and then to the primary one. ``places``: ``(row_id, taxonomy_hierarchy,
    basic_category, taxonomy_primary)``; ``rules``: ``(match, subcategory_id, excluded_reason)``.
    """
    path = F.array_join(F.coalesce("taxonomy_hierarchy", F.array().cast("array<string>")), " > ")
    with_path = longest_prefix(places.where(path != ""), path, rules.where(~F.col("match").startswith("basic:")))
    none = places.where(path == "")
    basic = rules.where(F.col("match").startswith("basic:"))
    keys = none.select("row_id", F.posexplode(F.array("basic_category", "taxonomy_primary")).alias("pos", "k")).where(F.coalesce("k", F.lit("")) != "")
    hit = keys.join(basic, F.concat(F.lit("basic:"), "k") == basic["match"])
    best = hit.groupBy(F.col("row_id").alias("__row")).agg(F.min(F.struct("pos", "match", "subcategory_id", "excluded_reason")).alias("r"))
    without = none.join(best, none.row_id == best["__row"], "left").select(*places.columns, "r.match", "r.subcategory_id", "r.excluded_reason")
    kind = F.when(F.col("match").isNull(), F.lit("unmapped")).when(F.coalesce("excluded_reason", F.lit("")) != "", F.lit("excluded")).otherwise(F.lit("mapped"))
    return with_path.select(*without.columns).union(without).withColumn("kind", kind)


def word_prefixes(name: Column) -> Column:
    """The name's first word, first two words and so on, up to the whole name."""
    words = F.split(name, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))


def first_containing(names: Column, needles: list[tuple[str, str]]) -> Column:
    """The key of the first ``(needle, key)`` inside the first of the names that contains any.

    ``names`` is an array in order of preference; ``needles`` a short configured list in order.
    """
    clean = F.transform(names, lambda n: F.lower(F.trim(F.coalesce(n, F.lit("")))))

    def key(n: Column) -> Column:
        chain = F
        for needle, value in needles:
            chain = chain.when(F.contains(n, F.lit(needle)), F.lit(value))
        return chain.otherwise(F.lit(None).cast("string"))

    return F.get(F.filter(F.transform(clean, key), lambda k: k.isNotNull()), F.lit(0))


def tree_leaves(nodes: DataFrame, roots: DataFrame, leaf_type: str = "CITY", max_depth: int = 1000) -> DataFrame:
    """Ids of the leaves of a type below the roots, the roots included.

    ``nodes``: ``(id, parent_id, type)``; ``roots``: ``(id)``. One level a step, until none is left; a
    tree that goes on after ``max_depth`` levels (a cycle) is an error. Lineage is cut now and then.
    """
    level = nodes.join(roots.select(F.col("id").alias("__root")), F.col("id") == F.col("__root"), "left_semi").select("id", "type")
    found = level
    for depth in range(max_depth):
        level = nodes.join(level.select(F.col("id").alias("__parent")), F.col("parent_id") == F.col("__parent"), "left_semi").select("id", "type")
        if depth % 8 == 7:
            level, found = checkpointed(level), checkpointed(found)
        if level.isEmpty():
            break
        found = found.union(level)
    else:
        raise RuntimeError(f"the tree does not end within {max_depth} levels")
    return found.where(F.col("type") == leaf_type).select("id").distinct()


def snapshot_ago(moments: DataFrame, snapshots: DataFrame, hours: int, tolerance: int = 12, bucket_hours: int = 24) -> DataFrame:
    """For each ``(key, at)`` the newest snapshot aged from ``hours`` to ``hours + tolerance``.

    ``snapshots``: ``(key, taken_at, value)``. Times fall into buckets, so the range is an equi-join
    on key and bucket. Moments without such a snapshot are kept with nulls.
    """
    size = bucket_hours * 3600
    slot = lambda t: F.floor(F.unix_timestamp(t) / size)
    oldest, newest = F.col("at") - F.make_interval(hours=F.lit(hours + tolerance)), F.col("at") - F.make_interval(hours=F.lit(hours))
    spread = moments.select("key", "at", oldest.alias("oldest"), newest.alias("newest")).select("*", F.explode(F.sequence(slot(F.col("oldest")), slot(F.col("newest")))).alias("slot"))
    past = snapshots.select(F.col("key").alias("k"), "taken_at", "value", slot(F.col("taken_at")).alias("s"))
    hit = spread.join(past, (F.col("key") == F.col("k")) & (F.col("slot") == F.col("s"))).where("taken_at BETWEEN oldest AND newest")
    best = hit.groupBy("key", "at").agg(F.max(F.struct("taken_at", "value")).alias("b")).select(F.col("key").alias("k2"), F.col("at").alias("at2"), "b.taken_at", "b.value")
    return moments.join(best, (F.col("key") == F.col("k2")) & (F.col("at") == F.col("at2")), "left").drop("k2", "at2")


def calendar(start: str, end: str, spark) -> DataFrame:
    """One row a day."""
    return spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS day")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Row numbers within keys, for operators that need every rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
