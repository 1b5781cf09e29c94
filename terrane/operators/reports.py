"""Reports: metric banks, histograms, calendars, coverage, alerts, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geo import round_half_up


def counts_by(df: DataFrame, column: str, most: int | None = None, none: str = "(none)") -> DataFrame:
    """Rows of each value, most first."""
    out = df.groupBy(F.coalesce(F.col(column), F.lit(none)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)
    return out if most is None else out.limit(most)


def histogram(df: DataFrame, array: str) -> DataFrame:
    """Rows of each element of an array column."""
    return df.select(F.explode(array).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def activity(days: DataFrame, events: DataFrame, zone: str = "Asia/Nicosia") -> DataFrame:
    """Events of each local calendar day, days without any included (J28). ``days``: (day); ``events``: (ts)."""
    local = events.groupBy(F.to_date(F.from_utc_timestamp("ts", zone)).alias("d")).agg(F.count("*").alias("n"))
    return days.join(local, F.col("day") == F.col("d"), "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def drop_reasons(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Counts of the first reason that drops a row, and of kept rows."""
    chain = F
    for name, test in tests:
        chain = chain.when(test, F.lit(name))
    return rows.groupBy(chain.otherwise(F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def order_statistics(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Highest, median (the entry at half the number, in descending order) and lowest value of a key.

    Values are counted first and ranked by running sums over distinct values, so a key with many rows
    is not collected.
    """
    from pyspark.sql import Window

    counted = df.groupBy(*keys, F.col(value).alias("v")).count()
    down = Window.partitionBy(*keys).orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("count").over(down)).withColumn("total", F.sum("count").over(Window.partitionBy(*keys)))
    at = F.floor(F.col("total") / 2)
    median = F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("count") <= at), F.col("v")))
    return ranked.groupBy(*keys).agg(F.max("v").alias("highest"), median.alias("median"), F.min("v").alias("lowest"))


def estimate_cost(jobs: DataFrame, max_pages: int = 3, default_pages: float = 2.0) -> DataFrame:
    """Least, estimated and largest number of requests and whether they fit.

    ``jobs``: ``(tasks_to_run, average_pages, free_remaining)``.
    """
    pages = F.least(F.greatest(F.coalesce("average_pages", F.lit(default_pages)), F.lit(1.0)), F.lit(float(max_pages)))
    estimated, most = F.ceil(F.col("tasks_to_run") * pages), F.col("tasks_to_run") * max_pages
    verdict = F.when(most <= F.col("free_remaining"), F.lit("FITS")).when(estimated <= F.col("free_remaining"), F.lit("MAY_NOT_FIT")).otherwise(F.lit("DOES_NOT_FIT"))
    return jobs.select("*", F.col("tasks_to_run").alias("minimum"), estimated.alias("estimated"), most.alias("maximum_without_splits"), round_half_up(pages, 2).alias("pages"), verdict.alias("verdict"))


def worker_state(beat: Column, now: Column, stale_seconds: int = 100) -> Column:
    """Whether a worker's last sign of life is less than so many seconds old (Q-9)."""
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.when(beat.isNull(), F.lit("unknown")).when(millis(now) - millis(beat) < 1000 * stale_seconds, F.lit("running")).otherwise(F.lit("stopped"))


def alerts(current: DataFrame, day_ago: DataFrame, six_hours_ago: DataFrame, loops: DataFrame, websites: DataFrame, now: Column) -> DataFrame:
    """``(country, level, code, amount)`` in order: errors first, then by rule (Q-11, O07).

    ``current``, ``day_ago``, ``six_hours_ago``: ``(country, ready, emails_total, exported_total, reasons
    map<string,int>)``; ``loops``: ``(country, name, errors)``; ``websites``: ``(country, waiting,
    last_crawl_at, crawling)``.
    """
    shape = lambda df, level, code, amount, rule: df.select("country", level.alias("level"), code.alias("code"), amount.cast("long").alias("amount"), F.lit(rule).alias("rule"))
    error, warning = F.lit("error"), F.lit("warning")
    failing = shape(loops.where("errors >= 3"), F.when(F.col("errors") >= 10, error).otherwise(warning), F.concat(F.lit("LOOP_FAILING_"), F.upper("name")), F.col("errors"), 1)
    idle = (F.unix_timestamp(now) - F.unix_timestamp("last_crawl_at")) / 3600
    stalled = shape(websites.where(F.col("crawling") & (F.col("waiting") > 0) & (idle >= 2)), warning, F.lit("CRAWL_STALLED"), F.col("waiting"), 2)
    old = day_ago.select(F.col("country").alias("c"), *[F.col(x).alias(f"old_{x}") for x in ("ready", "emails_total", "exported_total", "reasons")])
    both = current.join(old, F.col("country") == F.col("c"))
    new_emails = F.col("emails_total") - F.col("old_emails_total")
    became = F.col("ready") + F.col("exported_total") - F.col("old_exported_total") - F.col("old_ready")
    stuck = shape(both.where((new_emails >= 20) & (became <= 0)), error, F.lit("NOTHING_BECAME_READY"), new_emails, 3)
    grown = both.select("country", "old_reasons", F.explode("reasons").alias("reason", "n")).withColumn("before", F.coalesce(F.try_element_at("old_reasons", F.col("reason")), F.lit(0)))
    rise = F.col("n") - F.col("before")
    spike = shape(grown.where((rise >= 50) & ((F.col("before") == 0) | (rise / F.nullif(F.col("before"), F.lit(0)) >= 0.3))), warning, F.concat(F.lit("REASON_SPIKE_"), "reason"), rise, 4)
    six = six_hours_ago.select(F.col("country").alias("c"), F.col("reasons").alias("old_reasons"))
    unknown = lambda m: F.coalesce(F.try_element_at(m, F.lit("EMAIL_MX_UNKNOWN")), F.lit(0))
    waits = shape(current.join(six, F.col("country") == F.col("c")).where((unknown("reasons") >= 100) & (unknown("reasons") >= unknown("old_reasons"))), warning, F.lit("MX_CHECKS_STUCK"), unknown("reasons"), 5)
    every = failing.union(stalled).union(stuck).union(spike).union(waits)
    return every.orderBy("country", F.when(F.col("level") == "error", 0).otherwise(1), "rule", "code")
