"""State changes: the next snapshot of a table from the last one and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.fixed import STATUS_ORDER
from terrane.operators.joins import first_of


def _sides(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: tuple[str, ...] = (), fill_only: tuple[str, ...] = (), together: dict[str, str] | None = None, overrides: dict[str, Column] | None = None) -> DataFrame:
    """The next snapshot: new rows inserted, known ones updated; ``__inserted`` tells which.

    Columns take the new value, but ``keep_if_null`` ones keep the old value if the new one is null,
    ``fill_only`` ones are only filled where empty, a column in ``together`` follows the new row if
    the named other column is set there, and ``overrides`` give an expression over ``o.`` and ``n.``.
    """
    known, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    out = []
    for c in old.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == key:
            value = F.coalesce(o, n)
        elif c not in new.columns:
            value = o
        elif overrides and c in overrides:
            value = F.when(known & given, overrides[c]).when(given, n).otherwise(o)
        elif c in fill_only:
            value = F.coalesce(o, n)
        elif c in keep_if_null:
            value = F.coalesce(n, o)
        elif together and c in together:
            value = F.when(given & F.col(f"n.{together[c]}").isNotNull(), n).when(known, o).otherwise(n)
        else:
            value = F.when(given, n).otherwise(o)
        out.append(value.alias(c))
    return _sides(old, new, key).select(*out, (given & ~known).alias("__inserted"))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows and those new ones whose key is not there; one row a new key."""
    fresh = new.dropDuplicates(key).alias("n")
    theirs = old.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    condition = F.lit(True)
    for k in key:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    return old.unionByName(fresh.join(theirs, condition, "left_anti").select(*old.columns))


def insert_or_count(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Emails seen again count up, new ones are inserted with the lowest place.

    ``old``: ``(email, place_id, seen_count, last_seen)``; ``seen``: ``(email, place_id, seen_at)``. A known
    address never moves to another place.
    """
    new = seen.groupBy("email").agg(F.count("*").alias("n"), F.min("place_id").alias("p"), F.max("seen_at").alias("at"))
    joined = old.alias("o").join(new.alias("n"), F.col("o.email") == F.col("n.email"), "full_outer")
    return joined.select(
        F.coalesce("o.email", "n.email").alias("email"),
        F.coalesce("o.place_id", "n.p").alias("place_id"),
        (F.coalesce("o.seen_count", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("seen_count"),
        F.greatest("o.last_seen", "n.at").alias("last_seen"),
    )


def reason_rank(reason: Column) -> Column:
    return F.when(reason == "ERASED", 3).when(reason == "UNSUBSCRIBED", 2).when(reason == "BOUNCED", 1).otherwise(0)


def import_suppression(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next suppression list: stronger reasons replace weaker ones, else the first stays.

    ``(email_hash, email_normalized, domain, reason, source_file)``; ``new`` has distinct hashes.
    ``change`` is inserted, upgraded or kept.
    """
    joined = old.alias("o").join(new.alias("n"), F.col("o.email_hash") == F.col("n.email_hash"), "full_outer")
    insert = F.col("o.email_hash").isNull() & F.col("o.domain").isNull()
    stronger = ~insert & F.col("n.email_hash").isNotNull() & (reason_rank(F.col("n.reason")) > reason_rank(F.col("o.reason")))
    take = insert | stronger
    columns = [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in ("reason", "source_file") else F.when(insert, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return joined.select(*columns, F.when(insert, F.lit("inserted")).when(stronger, F.lit("upgraded")).otherwise(F.lit("kept")).alias("change"))


def status_rank(status: Column) -> Column:
    """Place of a status in the forward order, from 0; null for one outside of it (REJECTED)."""
    at = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    return F.when(at > 0, at - 1)


def move_forward(places: DataFrame, moves: DataFrame) -> DataFrame:
    """Places with their status moved forward by mailer results, never back.

    ``moves``: ``(id, status)`` with contacted, replied, onboarded or product_added in any case. Applied
    in that order, a place ends at the furthest of its moves; a rejected one stays.
    """
    best = moves.groupBy(F.col("id").alias("__id")).agg(F.max(status_rank(F.upper("status"))).alias("__to"))
    joined = places.join(best, F.col("id") == F.col("__id"), "left")
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    now = status_rank(F.col("status"))
    moved = F.when(F.col("__to") > now, F.get(names, F.col("__to"))).otherwise(F.col("status"))
    return joined.select(*[moved.alias(c) if c == "status" else F.col(c) for c in places.columns], (moved != F.col("status")).alias("moved"))


def sync_diff(file: DataFrame, table: DataFrame, key: str, active: str = "active") -> DataFrame:
    """What a synchronisation of a table with a file would do: create, reactivate, deactivate, none."""
    joined = file.select(F.col(key).alias("f")).distinct().join(table.select(F.col(key).alias("t"), F.col(active).alias("a")), F.col("f") == F.col("t"), "full_outer")
    action = F.when(F.col("t").isNull(), F.lit("create")).when(F.col("f").isNotNull() & ~F.col("a"), F.lit("reactivate")).when(F.col("f").isNull() & F.col("a"), F.lit("deactivate")).otherwise(F.lit("none"))
    return joined.select(F.coalesce("f", "t").alias(key), action.alias("action"))


def repair_primaries(emails: DataFrame) -> DataFrame:
    """Bad primaries replaced by the best other address of the place.

    ``emails``: ``(id, place_id, email, is_primary, is_own_domain, email_type, mx_valid, is_disposable,
    exported)``. A primary is bad without a mail server or as a role mailbox; a replacement needs a mail
    server, is neither role, disposable nor exported, and is the site's own or generic.
    """
    from terrane.functions.email import is_role_mailbox

    role = is_role_mailbox(F.col("email"))
    bad = emails.where(F.col("is_primary") & ((F.col("mx_valid") == F.lit(False)) | role)).select(F.col("place_id").alias("bad_place"), F.col("id").alias("bad_id"))
    able = emails.where(~F.col("is_primary") & F.col("mx_valid") & ~role & ~F.col("is_disposable") & ~F.col("exported") & (F.col("is_own_domain") | (F.col("email_type") == "GENERIC")))
    best = first_of(able, ["place_id"], [(~F.col("is_own_domain")).cast("int"), (F.col("email_type") != "PERSONAL").cast("int"), F.col("id")]).select(F.col("place_id").alias("p"), F.col("id").alias("new_id"))
    swap = bad.join(best, F.col("bad_place") == F.col("p")).select("bad_place", "bad_id", "new_id")
    joined = emails.join(swap, F.col("place_id") == F.col("bad_place"), "left")
    primary = F.when(F.col("id") == F.col("bad_id"), F.lit(False)).when(F.col("id") == F.col("new_id"), F.lit(True)).otherwise(F.col("is_primary"))
    return joined.select(*[primary.alias(c) if c == "is_primary" else F.col(c) for c in emails.columns])


def recover_stale(tasks: DataFrame, now: Column, lease_minutes: int) -> DataFrame:
    """Running tasks older than the lease are pending again (Q-3)."""
    stale = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.make_interval(mins=F.lit(lease_minutes)))
    return tasks.withColumn("status", F.when(stale, F.lit("PENDING")).otherwise(F.col("status")))


def reserve(requests: DataFrame, free_cap: int, budget: float = 0.0, price: float = 0.0, paid_cap: int | None = None) -> DataFrame:
    """Which requests, in order, are granted free, paid or denied (Q-8).

    ``requests``: ``(period, seq)`` with a total order inside a period. Ranks come from per-bucket counts
    and offsets, so a period with a third of all requests is not one task.
    """
    spread = requests.withColumn("bucket", F.floor(F.col("seq") / 100_000))
    sizes = spread.groupBy("period", "bucket").count()
    from pyspark.sql import Window

    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("period").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("period").alias("p"), F.col("bucket").alias("b"), "before")
    rank = F.row_number().over(Window.partitionBy("period", "bucket").orderBy("seq"))
    numbered = spread.withColumn("rank", rank).join(before, (F.col("period") == F.col("p")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("rank") + F.col("before"))
    paid_room = int(budget / price + 1e-9) if price > 0 else 0
    if paid_cap is not None:
        paid_room = min(paid_room, paid_cap)
    state = F.when(F.col("rank") <= free_cap, F.lit("free")).when(F.col("rank") <= free_cap + paid_room, F.lit("paid")).otherwise(F.lit("denied"))
    return numbered.select("period", "seq", "rank", state.alias("grant"))


def failure_streaks(log: DataFrame) -> DataFrame:
    """Failures in a row up to now for each loop (Q-10). ``log``: ``(name, at, ok)``."""
    last = log.groupBy(F.col("name").alias("n")).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("ok_at"))
    after = log.join(last, F.col("name") == F.col("n")).where(~F.col("ok") & (F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at"))))
    counted = after.groupBy(F.col("name").alias("m")).agg(F.count("*").alias("errors"), F.max("at").alias("error_at"))
    return last.join(counted, F.col("n") == F.col("m"), "left").select(F.col("n").alias("name"), "ok_at", "error_at", F.coalesce("errors", F.lit(0)).alias("errors"))
