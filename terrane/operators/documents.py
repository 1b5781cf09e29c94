"""JSON documents as VARIANT: rows out of arrays, values by path, and differences between two documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every object and value of a document with its path; arrays count as values.
PATHS = """
WITH RECURSIVE part (key, path, v, inside) MAX RECURSION LEVEL {depth} AS (
  SELECT key, '', v, schema_of_variant(v) LIKE 'OBJECT<%' FROM {documents}
  UNION ALL
  SELECT p.key, IF(p.path = '', e.key, concat(p.path, '.', e.key)), e.value, schema_of_variant(e.value) LIKE 'OBJECT<%'
  FROM part p, LATERAL variant_explode(p.v) e WHERE p.inside
)
SELECT key, path, to_json(v) AS value FROM part WHERE NOT inside AND path <> '' OR inside AND to_json(v) = '{}' AND path <> ''
"""


def records(rows: DataFrame, column: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each element of a column of JSON arrays, with typed fields.

    ``fields``: name -> ``path type``, as ``"$.a.b int"``. A missing field, a JSON null and a value of another
    type are null; a text that is no JSON or no array has no rows.
    """
    spread = rows.select(*keep, F.explode(F.coalesce(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>"), F.array().cast("array<variant>"))).alias("__e"))
    return spread.select(*keep, *[F.try_variant_get("__e", *way.rsplit(" ", 1)).alias(name) for name, way in fields.items()])


def value_state(document: Column, path: str) -> Column:
    """``missing``, ``null`` or ``value``: what a document, as VARIANT, has at a path; a null document is missing."""
    at = F.variant_get(document, path, "variant")
    return F.when(document.isNull() | at.isNull(), F.lit("missing")).when(F.is_variant_null(at), F.lit("null")).otherwise(F.lit("value"))


def leaf_values(rows: DataFrame, key: str, column: str, max_depth: int = 100) -> DataFrame:
    """``(key, path, value)``: every value below the objects of a JSON text, as JSON; nested keys joined by dots.

    Arrays are one value, and so is an empty object. A text that is no JSON has no rows, a document that is no object one
    without a path and so none either.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    documents = rows.select(F.col(key).alias("key"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    return spark.sql(PATHS.replace("{depth}", str(max_depth)).replace("'{}'", "concat('{{', '}}')"), documents=documents)


def differences(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, path, change, old, new)`` where two snapshots of documents differ, down to single values.

    ``change`` is added, removed or changed; a value that is JSON null is a value (``null``), a missing one is none.
    Keys of a document compare as a set, elements of an array in order, numbers by their written value.
    """
    a = leaf_values(before, key, column).toDF("key", "path", "old")
    b = leaf_values(after, key, column).toDF("key", "path", "new")
    joined = a.join(b, ["key", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select("key", "path", change.alias("change"), "old", "new")


def section_changes(before: Column, after: Column) -> Column:
    """The keys of a settings section, as JSON objects, whose values differ: key -> ``(old, new)`` as JSON.

    Only keys of the new values count, in their order, as an update of a section reports them.
    """
    kind = "map<string,variant>"
    old, new = (F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", kind), F.map_from_arrays(F.array(), F.array()).cast(kind)) for x in (before, after))
    text = lambda m, k: F.to_json(F.try_element_at(m, k))
    names = F.array_sort(F.map_keys(new))
    pairs = F.transform(names, lambda k: F.struct(k.alias("key"), text(old, k).alias("old"), text(new, k).alias("new")))
    return F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
