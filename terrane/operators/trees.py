"""Trees: leaves below roots in one recursive plan, and ids of nodes that last over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.datasets import number_rows
from terrane.session import checkpointed

#: Nodes with the way from their root. A way that comes back to a node of its own is marked and not followed.
WALK = """
WITH RECURSIVE walk (id, type, way, turns) MAX RECURSION LEVEL {depth} AS (
  SELECT n.id, n.type, array(n.id), false FROM {nodes} n JOIN {roots} r ON n.id = r.id
  UNION ALL
  SELECT n.id, n.type, concat(w.way, array(n.id)), array_contains(w.way, n.id) FROM walk w JOIN {nodes} n ON n.parent_id = w.id WHERE NOT w.turns
)
SELECT id, type, way, turns FROM walk
"""


#: Lowest levels of a tree that are joined to the others instead of walked.
JOINED_LEVELS = 2


def walk(nodes: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``(id, type, way, turns)`` of every node below the roots, the roots included, in one recursive plan.

    ``nodes``: ``(id, parent_id, type)``; ``roots``: ``(id)``. ``way`` holds the ids from the root to the node.
    ``turns`` marks a node that its own way has already: a cycle, which ends there. A tree deeper than
    ``max_depth`` is an error of the plan. A node below several roots occurs once for each. The number of
    rows is not limited by the session's guard against endless recursion, as the way already rules it out.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    shape = nodes.select("id", "parent_id", "type")
    return spark.sql(WALK.replace("{depth}", str(max_depth)), nodes=shape, roots=roots.select("id").distinct())


def leaves_below(nodes: DataFrame, roots: DataFrame, leaf_type: str = "CITY", fail_on_cycle: bool = True, max_depth: int = 1000) -> DataFrame:
    """``(id)`` of the nodes of a type below the roots, each once.

    A cycle is an error that names its way, or is cut at the node that comes again. Most nodes of a tree are on its
    lowest levels: nodes without children, and those whose children have none, are no part of the recursion and are
    joined to what it reached. Nodes of a cycle always have children.
    """
    roots = roots.select(F.col("id").alias("root")).distinct()
    levels = [nodes.select("id", "parent_id", "type")]
    for _ in range(JOINED_LEVELS):
        parents = levels[-1].where("parent_id IS NOT NULL").select(F.col("parent_id").alias("p")).distinct()
        levels.append(checkpointed(levels[-1].join(parents, F.col("id") == F.col("p"), "left_semi")))
    found = walk(levels.pop(), roots.select(F.col("root").alias("id")), max_depth)
    if fail_on_cycle:
        error = F.raise_error(F.concat(F.lit("the tree has a cycle: "), F.array_join("way", " > "))).cast("boolean")
        found = found.where(F.when(F.col("turns"), error).otherwise(F.lit(True)))
    found = found.where(~F.col("turns")).select("id").distinct()
    for level in reversed(levels):
        up = checkpointed(found).select(F.col("id").alias("up"))
        level = level if level is not levels[0] else level.where(F.col("type") == leaf_type)
        below, own = level.join(up, F.col("parent_id") == F.col("up"), "left_semi"), level.join(roots, F.col("id") == F.col("root"), "left_semi")
        found = below.select("id").union(own.select("id")).distinct()
    return found


def upsert_tree(snapshot: DataFrame, drafts: DataFrame) -> DataFrame:
    """The next snapshot of a location tree with ids that stay, and ``change``.

    ``snapshot``: ``(id, geonames_id, parent_id, type, name, active, …)``; ``drafts``: the same without id and
    active, with ``parent_geonames_id`` instead of ``parent_id``. Nodes are matched by their natural key,
    ``geonames_id``: a known node keeps its id and ``active`` and takes all other fields of its draft. New
    nodes get the ids after the largest one, level by level and in each by key, so a parent's id is
    always smaller than its new children's, and a second run changes nothing. ``change`` is inserted, updated,
    same, or untouched for nodes without a draft. A draft whose parent is no draft nor known, or that is its
    own ancestor, is an error that names its key.
    """
    fields = [c for c in snapshot.columns if c not in ("id", "geonames_id", "parent_id", "active")]
    # Parents that are no drafts are known nodes: they are roots of what hangs on them.
    keys = drafts.select(F.col("geonames_id").alias("id"), F.col("parent_geonames_id").alias("parent_id"), F.lit("").alias("type"))
    own = drafts.select(F.col("geonames_id").alias("k"))
    roots = keys.join(own, F.col("parent_id") == F.col("k"), "left_anti")
    known = snapshot.select(F.col("geonames_id").alias("known_key"), F.col("id").alias("known_id"), F.col("active").alias("known_active"))
    lost = roots.where("parent_id IS NOT NULL").join(known, F.col("parent_id") == F.col("known_key"), "left_anti")
    levels = checkpointed(walk(keys, roots).where("NOT turns").groupBy("id").agg(F.max(F.size("way")).alias("level")))
    unreached = lost.select("id").union(keys.select("id").join(levels.select(F.col("id").alias("seen")), F.col("id") == F.col("seen"), "left_anti"))
    bad = [r[0] for r in unreached.orderBy("id").take(5)]
    if bad:
        raise ValueError(f"locations with a missing or circular parent: {bad}")
    kind = dict(snapshot.dtypes)["id"]
    joined = checkpointed(drafts.join(levels.select(F.col("id").alias("lk"), "level"), F.col("geonames_id") == F.col("lk")).join(known, F.col("geonames_id") == F.col("known_key"), "left"))
    top = snapshot.agg(F.max("id")).first()[0] or 0
    fresh = joined.where("known_id IS NULL").select(F.struct("level", "geonames_id").alias("place"), F.lit(None).cast(kind).alias("id"))
    ids = number_rows(fresh, "place", top).select(F.col("place.geonames_id").alias("key"), "id")
    ids = checkpointed(ids.union(joined.where("known_id IS NOT NULL").select("geonames_id", "known_id")))
    above = ids.toDF("parent_key", "parent_id").union(known.join(own, F.col("known_key") == F.col("k"), "left_anti").select("known_key", "known_id"))
    placed = joined.join(ids, F.col("geonames_id") == F.col("key")).join(above, F.col("parent_geonames_id") == F.col("parent_key"), "left")
    values = lambda prefix: F.struct(F.col(f"{prefix}parent_id").alias("parent_id"), *[F.col(f"{prefix}{c}").alias(c) for c in fields])
    before = snapshot.select(F.col("geonames_id").alias("old_key"), F.struct("parent_id", *fields).alias("old"))
    placed = placed.join(before, F.col("geonames_id") == F.col("old_key"), "left")
    change = F.when(F.col("known_id").isNull(), F.lit("inserted")).when(values("") == F.col("old"), F.lit("same")).otherwise(F.lit("updated"))
    change = F.when(F.col("known_id").isNotNull() & values("").eqNullSafe(F.col("old")), F.lit("same")).otherwise(change)
    shape = lambda c: F.coalesce("known_active", F.lit(True)).alias("active") if c == "active" else F.col(c)
    done = placed.select(*[shape(c) for c in snapshot.columns], change.alias("change"))
    rest = snapshot.join(own, F.col("geonames_id") == F.col("k"), "left_anti").withColumn("change", F.lit("untouched"))
    return done.unionByName(rest.select(done.columns))
