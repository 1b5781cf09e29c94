"""Numbering plans read from a file: the longest known range decides country, kind and lengths of a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.joins import small

#: Columns of a plan's file, tab-separated with a header; one row a range.
PLAN = "country string, calling_code string, national_prefix string, range string, least int, most int, kind string"
#: Digits of the longest key: calling code and range.
LONGEST = 12


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan: ``range`` is the leading digits of national numbers (empty: all others of the country), ``least`` and
    ``most`` their lengths, ``national_prefix`` what is dialled before them at home (empty: nothing, as where a
    leading zero belongs to the number). A range that occurs twice below one calling code is an error."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=PLAN).na.fill("", ["national_prefix", "range", "kind"])
    twice = rows.groupBy("calling_code", "range").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ranges occur twice: {[(r['calling_code'], r['range']) for r in twice]}")
    return rows


def _digits(raw: Column) -> tuple[Column, Column]:
    """Digits of a number without its extension, null if it has other characters; whether it names its country."""
    value = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"(?i)\s*(?:ext\.?|x|#)\s*\d{1,6}$", "")
    value = F.when(value.rlike(r"^[+(]?[0-9\s().\-/+]+$"), F.regexp_replace(value, r"\(0\)", ""))
    digits = F.regexp_replace(value, r"\D", "")
    return digits, value.rlike(r"^\(?\+") | digits.startswith("00")


def numbers(rows: DataFrame, plan: DataFrame, phone: str = "phone", country: str = "country_code") -> DataFrame:
    """The rows with ``number`` (+ and digits), ``number_country`` and ``number_kind``, all null where a number is not valid.

    A number with + or 00 names its country itself, any other is one of its row's country. The range with the most leading
    digits in common decides, so countries that share a calling code are told apart by their ranges, and it
    decides alone: a number of a wrong length for it is not valid, though a shorter range would take it. Distinct
    numbers are looked up once; a plan beyond the size for sending it round is joined by a shuffle.
    """
    digits, abroad = _digits(F.col("raw"))
    asked = rows.select(F.col(phone).alias("raw"), F.upper(country).alias("home")).where("raw IS NOT NULL").distinct()
    homes = small(plan.groupBy(F.col("country").alias("c")).agg(F.min(F.struct("calling_code", "national_prefix")).alias("h")))
    asked = asked.withColumns({"digits": digits, "abroad": abroad}).where(F.col("digits") != "").join(homes, F.col("home") == F.col("c"), "left")
    prefix = F.coalesce("h.national_prefix", F.lit(""))
    national = F.when((prefix != "") & F.startswith("digits", prefix), F.substr("digits", F.length(prefix) + 1)).otherwise(F.col("digits"))
    full = F.when(F.col("abroad"), F.regexp_replace("digits", "^00", "")).otherwise(F.concat(F.col("h.calling_code"), national))
    keys = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.greatest(F.length("full"), F.lit(1)))), lambda n: F.substr("full", F.lit(1), n))
    spread = asked.withColumn("full", full).where("full IS NOT NULL").select("raw", "home", "full", F.explode(keys).alias("key"))
    ranges = small(plan.select(F.concat("calling_code", "range").alias("k"), F.struct(F.length(F.concat("calling_code", "range")).alias("n"), "country", "kind", "least", "most", F.length("calling_code").alias("c")).alias("range")))
    best = spread.join(ranges, F.col("key") == F.col("k")).groupBy("raw", "home", "full").agg(F.max("range").alias("r"))
    length = F.length("full") - F.col("r.c")
    good = best.where(length.between(F.col("r.least"), F.col("r.most"))).select(F.col("raw").alias("__raw"), F.col("home").alias("__home"), F.concat(F.lit("+"), F.col("full")).alias("number"), F.col("r.country").alias("number_country"), F.col("r.kind").alias("number_kind"))
    return rows.join(good, (F.col(phone) == F.col("__raw")) & F.upper(country).eqNullSafe(F.col("__home")), "left").drop("__raw", "__home")
