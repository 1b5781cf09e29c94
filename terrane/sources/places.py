"""Scans of places, outlines, gazetteers, rule files and CSV columns."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.email import normalize_email
from terrane.functions.fixed import BOX_PAD, CLOSED_STATUSES
from terrane.functions.urls import clean_url, own_domain


@dataclass(frozen=True)
class Box:
    south: float
    west: float
    north: float
    east: float


def any_case(column: Column, code: str) -> Column:
    """Whether a column is a code of letters in any case, as a list that Parquet's statistics, dictionaries and page indexes can test.

    So the key column decides which pages of the wide columns are read at all.
    """
    forms = [""]
    for char in code:
        forms = [f + c for f in forms for c in dict.fromkeys((char.upper(), char.lower()))]
    return column.isin(*forms)


def _some(c: Column) -> Column:
    """The text, null if blank."""
    return F.when(F.trim(c) != "", c)


def _strings(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def nested_places(raw: DataFrame, box: Box, country: str) -> DataFrame:
    """Flat places of a country out of nested rows.

    The box test is on the raw bounds too, so it reaches the Parquet scan and skips row groups;
    rows without statistics are read.
    """
    south, north, west, east = box.south - BOX_PAD, box.north + BOX_PAD, box.west - BOX_PAD, box.east + BOX_PAD
    near = (F.col("bbox.ymax") >= south) & (F.col("bbox.ymin") <= north) & (F.col("bbox.xmax") >= west) & (F.col("bbox.xmin") <= east)
    lat, lng = (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2, (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2
    address = F.get("addresses", F.lit(0))
    at = lambda name: _some(F.get("addresses", F.lit(0))[name])
    code = _some(address["country"])
    rows = raw.where(near).where(lat.between(south, north) & lng.between(west, east)).where(F.coalesce(F.upper(code) == country, F.lit(True))).where(_some(F.col("names.primary")).isNotNull())
    return rows.select(
        F.col("id").cast("string").alias("id"), F.trim("names.primary").alias("name"), lat.alias("lat"), lng.alias("lng"), _some(F.col("basic_category")).alias("basic_category"),
        _some(F.col("taxonomy.primary")).alias("taxonomy_primary"), _strings(F.col("taxonomy.hierarchy")).alias("taxonomy_hierarchy"), _strings(F.col("taxonomy.alternates")).alias("taxonomy_alternates"),
        F.col("confidence").cast("double").alias("confidence"), _some(F.col("operating_status")).alias("operating_status"), _strings(F.col("websites")).alias("websites"), _strings(F.col("phones")).alias("phones"),
        F.transform(_strings(F.col("emails")), lambda e: F.lower(F.trim(e))).alias("emails"), _strings(F.col("socials")).alias("socials"), _some(F.col("brand.names.primary")).alias("brand_name"),
        at("freeform").alias("address"), at("locality").alias("locality"), at("postcode").alias("postcode"), at("region").alias("region"), code.alias("address_country"),
        F.array_distinct(F.filter(F.transform("sources", lambda s: _some(s["dataset"])), lambda d: d.isNotNull())).alias("datasets"),
    )


def useful_contact(emails: Column, websites: Column) -> Column:
    """Has an email or an own website."""
    return (F.size(emails) > 0) | F.exists(websites, lambda w: own_domain(clean_url(w)).isNotNull())


def nested_outcome(min_confidence: float, only_with_contact: bool = False) -> Column:
    """Why a place is dropped, first reason first: closed, confidence, contact; else kept."""
    chain = F.when(F.coalesce(F.col("operating_status").isin(*CLOSED_STATUSES), F.lit(False)), F.lit("closed")).when(F.coalesce(F.col("confidence") < min_confidence, F.lit(False)), F.lit("low_confidence"))
    if only_with_contact:
        chain = chain.when(~useful_contact(F.col("emails"), F.col("websites")), F.lit("no_contact"))
    return chain.otherwise(F.lit("kept"))


def flat_places(raw: DataFrame, box: Box, country: str) -> DataFrame:
    """Places of a country out of flat rows."""
    day = lambda c: F.when(c.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c.cast("string"), 1, 10)).otherwise(_some(c.cast("string")))
    # The code as a list reaches the Parquet scan; upper() alone would not.
    ours = any_case(F.col("country"), country) & (F.upper(F.col("country")) == country)
    inside = F.col("latitude").between(box.south - BOX_PAD, box.north + BOX_PAD) & F.col("longitude").between(box.west - BOX_PAD, box.east + BOX_PAD)
    rows = raw.where(inside & ours & _some(F.col("name")).isNotNull() & _some(F.col("fsq_place_id")).isNotNull())
    plain = ["website", "tel", "address", "locality", "region", "postcode", "instagram", "twitter"]
    return rows.select(
        F.col("fsq_place_id").alias("id"), "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), _strings(F.col("fsq_category_ids")).alias("category_ids"), _strings(F.col("fsq_category_labels")).alias("category_labels"),
        *[_some(F.col(c)).alias(c) for c in plain], F.lower(_some(F.col("email"))).alias("email"), _some(F.col("facebook_id").cast("string")).alias("facebook_id"),
        day(F.col("date_created")).alias("date_created"), day(F.col("date_refreshed")).alias("date_refreshed"), day(F.col("date_closed")).alias("date_closed"),
    )


def flat_outcome(cutoff: str) -> Column:
    """Closed, or not refreshed since the cutoff, else kept."""
    return F.when(F.col("date_closed").isNotNull(), F.lit("closed")).when(F.coalesce(F.col("date_refreshed") < cutoff, F.lit(True)), F.lit("old")).otherwise(F.lit("kept"))


def latest_release(releases: DataFrame) -> DataFrame:
    """The newest release by date, then by number: .10 is after .9 (S04). ``releases``: ``(release)``."""
    order = F.struct(F.substring_index("release", ".", 1), F.coalesce(F.try_to_number(F.regexp_extract("release", r"\.(\d+)$", 1), F.lit("999999")).cast("int"), F.lit(0)))
    return releases.agg(F.max_by("release", order).alias("release"))


def rings_of_wkb(data: bytes | None) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or a collection of polygons in well-known binary."""
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        mark = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(mark + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:  # a reference system follows
            at += 4
        extra = (1 if kind & 0x80000000 else 0) + (1 if kind & 0x40000000 else 0)
        kind &= 0x0FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
        (n,) = struct.unpack_from(mark + "I", data, at)
        at += 4
        if kind % 1000 == 3:
            for _ in range(n):
                (m,) = struct.unpack_from(mark + "I", data, at)
                width = 2 + extra
                values = struct.unpack_from(f"{mark}{m * width}d", data, at + 4)
                out.append(list(zip(values[::width], values[1::width], strict=True)))
                at += 4 + 8 * m * width
        elif kind % 1000 in (6, 7):
            for _ in range(n):
                at = read(at)
        else:
            raise ValueError(f"geometry type {kind} is no area")
        return at

    if data:
        read(0)
    return out


def outline_rings(areas: DataFrame, country: str) -> DataFrame:
    """``(feature_id, points)`` of every ring of a country's areas (S10). ``areas``: ``(country, subtype, geometry)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, data in zip(batch["feature_id"], batch["geometry"], strict=True) for ring in rings_of_wkb(bytes(data) if data is not None else None)]
            yield pd.DataFrame(rows, columns=["feature_id", "points"])

    kept = areas.where((F.upper("country") == country) & (F.col("subtype") == "country")).select(F.xxhash64("geometry").alias("feature_id"), "geometry")
    return kept.mapInPandas(run, "feature_id long, points array<struct<x:double,y:double>>")


def in_country(places: DataFrame, inside: DataFrame) -> DataFrame:
    """Places with an address country, or inside the outline (Q10). ``inside``: ``(point_id)`` by place id."""
    joined = places.join(inside.select(F.col("point_id").alias("__in")).distinct(), F.col("id") == F.col("__in"), "left")
    return joined.where("address_country IS NOT NULL OR __in IS NOT NULL").drop("__in")


def gazetteer(lines: DataFrame) -> DataFrame:
    """Rows of a gazetteer dump with its 19 tab-separated columns; shorter lines do not count (S11). ``lines``: ``(value)``."""
    part = F.split(F.regexp_replace("value", "^﻿", ""), "\t")
    at = lambda k: F.get("p", F.lit(k))
    number = lambda k, kind: F.when(F.trim(at(k)) != "", at(k).try_cast(kind))
    rows = lines.select(part.alias("p")).where(F.size("p") >= 15)
    alternates = F.filter(F.transform(F.split(at(3), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(
        number(0, "long").alias("geonames_id"), at(1).alias("name"), at(2).alias("ascii_name"), alternates.alias("alternates"), number(4, "double").alias("lat"), number(5, "double").alias("lng"),
        at(6).alias("feature_class"), at(7).alias("feature_code"), at(8).alias("country_code"), at(10).alias("admin1"), at(11).alias("admin2"), F.coalesce(number(14, "long"), F.lit(0)).alias("population"),
    )


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return gazetteer(spark.read.text(path))


def admin_codes(lines: DataFrame, country: str) -> DataFrame:
    """``(code, name, geonames_id)`` of a country, the code without its country."""
    p = F.split("value", "\t")
    rows = lines.where(F.col("value").startswith(f"{country}."))
    return rows.select(F.substring(F.get(p, F.lit(0)), len(country) + 2, 100).alias("code"), F.get(p, F.lit(1)).alias("name"), F.get(p, F.lit(3)).try_cast("long").alias("geonames_id"))


def country_info(lines: DataFrame, country: str) -> DataFrame:
    """``(geonames_id, name, population)`` of a country."""
    p = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.get(p, F.lit(0)) == country))
    return rows.select(F.get(p, F.lit(16)).try_cast("long").alias("geonames_id"), F.get(p, F.lit(4)).alias("name"), F.coalesce(F.get(p, F.lit(7)).try_cast("long"), F.lit(0)).alias("population"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of rules as rows; a match that occurs twice is an error."""
    rules = spark.read.json(path, multiLine=True)
    if "rules" in rules.columns:
        rules = rules.select(F.explode("rules").alias("r")).select("r.*")
    twice = rules.groupBy("match").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"rules occur twice: {[r['match'] for r in twice]}")
    return rules


def sniff_delimiter(header: str) -> str:
    """The delimiter of a CSV header: comma, semicolon or tab, whichever it has most of."""
    return max([",", ";", "\t"], key=header.count)


def read_csv_lower(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with any of three delimiters, lower-case trimmed column names, ragged rows."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError("the CSV file is empty")
    header = first[0][0].lstrip("﻿")
    rows = spark.read.csv(path, header=True, sep=sniff_delimiter(header), mode="PERMISSIVE", multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.toDF(*[re.sub("^﻿", "", c).strip().lower() for c in rows.columns])


def email_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(value)`` of one column of a CSV file."""
    rows, wanted = read_csv_lower(spark, path), column.strip().lower()
    if wanted not in rows.columns:
        raise ValueError(f'column "{column}" not found; columns in this file: {", ".join(rows.columns)}')
    return rows.select(F.coalesce(F.col(wanted), F.lit("")).alias("value"))


def mailer_rows(rows: DataFrame) -> DataFrame:
    """``(email, status, at, valid)`` of a mailer's result file (S16). ``rows``: email, status and perhaps date."""
    status = F.regexp_replace(F.lower(F.trim(F.coalesce("status", F.lit("")))), r"[\s-]+", "_")
    at = F.coalesce(F.try_to_timestamp("date"), F.current_timestamp()) if "date" in rows.columns else F.current_timestamp()
    email = normalize_email(F.coalesce("email", F.lit("")))
    return rows.select(email.alias("email"), status.alias("status"), at.alias("at"), (email.isNotNull() & (status != "")).alias("valid"))
