"""CSV cells and files, export profiles, snapshots of a country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.fixed import E164

BOM = "﻿"
#: English names of countries by code; others keep their code.
COUNTRY_NAMES = {"CY": "Cyprus", "GR": "Greece", "BD": "Bangladesh", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "ES": "Spain", "IT": "Italy", "PT": "Portugal", "NL": "Netherlands", "BE": "Belgium", "AT": "Austria", "CH": "Switzerland", "IE": "Ireland", "PL": "Poland", "RO": "Romania", "BG": "Bulgaria", "TR": "Türkiye", "IL": "Israel", "US": "United States"}


def csv_cell(value: Column) -> Column:
    """One cell: no formulas, quoted where needed, empty for null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(E164), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def country_name(code: Column) -> Column:
    chain = F
    for key, name in COUNTRY_NAMES.items():
        chain = chain.when(F.upper(code) == key, F.lit(name))
    return chain.otherwise(code)


def _joined(name: str) -> Column:
    return F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), ";")


def _iso(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def mailer_notes() -> Column:
    extra = F.when(F.size(F.coalesce("extra_emails", F.array().cast("array<string>"))) > 0, F.concat(F.lit("extra_emails="), _joined("extra_emails")))
    return F.concat_ws(" | ", country_name(F.col("country_code")), _joined("subcategories"), _joined("sources"), extra)


def profile(name: str) -> list[Column]:
    """The columns of an export profile over lead columns."""
    col = lambda source, header: F.col(source).alias(header)
    profiles = {
        "mailer_v1": lambda: [F.col("business_name"), F.col("email"), F.col("phone"), F.col("website"), F.col("city"), F.col("category"), mailer_notes().alias("notes")],
        "legacy_9col": lambda: [col("business_name", "name"), F.col("email"), F.col("phone"), col("business_name", "businessName"), F.col("website"), F.col("category"), _joined("sources").alias("source"), F.lower("status").alias("status"), _iso("first_seen_at").alias("createdAt")],
        "full": lambda: [
            F.col("place_id"), F.col("business_name"), F.col("email"), _joined("extra_emails").alias("extra_emails"), F.lower("email_type").alias("email_type"), F.when(F.col("email_own_domain"), "yes").otherwise("no").alias("email_own_domain"),
            F.col("phone"), F.col("website"), F.col("address"), F.col("city"), country_name(F.col("country_code")).alias("country"), F.col("lat"), F.col("lng"), F.col("category"), _joined("subcategories").alias("subcategories"), _joined("sources").alias("source"),
            F.col("rating"), F.col("rating_count"), F.col("score"), F.lower("status").alias("status"), _iso("first_seen_at").alias("first_seen_at"),
        ],
    }
    return profiles[name]()


#: Rows of a file for people.
MOST_ROWS = 100_000


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a byte-order mark, header and CRLF line ends, in the order of ``rows``.

    An export is for people, so one file and one task are right for its at most 100,000 rows; more are an error.
    Lines are numbered, so that the file has them in order whatever the union does.
    """
    n = len(rows.select(F.lit(1)).head(MOST_ROWS + 1))
    if n > MOST_ROWS:
        raise ValueError(f"an export has at most {MOST_ROWS} rows")
    header = rows.sparkSession.createDataFrame([(-1, BOM + ",".join(rows.columns))], "line long, value string")
    body = rows.select(F.monotonically_increasing_id().alias("line"), csv_line(*[F.col(c) for c in rows.columns]).alias("value"))
    header.union(body).repartition(1).sortWithinPartitions("line").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_file_name(prefix: str, day: str, country: str, count: int) -> str:
    """S21."""
    return f"{prefix}_{day}_{country.upper()}_{count}.csv"


def replace_country(rows: DataFrame, path: str, key: str = "country_code") -> None:
    """Write the partitions of the countries in ``rows`` and leave all others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def page_csv(records: DataFrame) -> DataFrame:
    """Flat columns of page records."""
    plain = [c for c, t in records.dtypes if not t.startswith(("map", "array", "struct"))]
    social = [F.try_element_at("socials", F.lit(k)).alias(k) for k in ("instagram", "facebook", "tiktok", "linkedin", "youtube")]
    return records.select(*plain, *social, F.array_join("missing", ";").alias("missing"))


def page_json(records: DataFrame) -> DataFrame:
    """Each record as a JSON document."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))
