"""Schedules and small states of repositories: alarms, unpacking, retries, tokens, purges, fetch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELAY_MS, BACKOFF_MS, IDLE_MS, MAINTENANCE_MS = 500, 1000, 1_800_000, 86_400_000
CHUNK = 100


def next_alarm(now: Column, unpacking: Column, stage: Column, retry_at: Column, queued: Column, access: Column, maintained: Column) -> Column:
    """struct(at, reason): unpacking first, then hydration (not after an error that ended it), then what is due sooner of idling
    and maintenance. Deadlines that have passed are put off by their interval."""
    due = lambda last, every: F.when(F.coalesce(last, now) + every <= now, now + every).otherwise(F.coalesce(last, now) + every)
    idle, care = due(access, IDLE_MS), due(maintained, MAINTENANCE_MS)
    pick = lambda at, reason: F.struct(at.cast("long").alias("at"), reason.alias("reason"))
    soon = now + DELAY_MS
    working = stage.isNotNull() & (stage != "error")
    rest = pick(F.least(idle, care), F.when(care <= idle, "maint").otherwise("idle"))
    return (
        F.when(unpacking, pick(soon, F.lit("unpack")))
        .when(working & (retry_at > now), pick(retry_at, F.lit("hydration")))
        .when(working | (stage.isNull() & queued), pick(soon, F.lit("hydration")))
        .otherwise(rest)
    )


def sooner(set_at: Column, wanted: Column, now: Column) -> Column:
    """The alarm after a wish for one: the earlier wins, and none is less than five milliseconds away."""
    wish = F.greatest(wanted, now + 5)
    return F.when(set_at.isNull() | (wish < set_at), wish).otherwise(set_at)


def chunks(members: DataFrame, size: int = CHUNK) -> DataFrame:
    """pack, oid, chunk, percent: the slice of each object, by oid, and how far its pack is when the slice is done."""
    at = F.row_number().over(Window.partitionBy("pack").orderBy("oid")) - 1
    rows = members.select("pack", "oid", F.floor(at / size).alias("chunk"), F.count(F.lit(1)).over(Window.partitionBy("pack")).alias("_n"))
    done = F.least((F.col("chunk") + 1) * size, F.col("_n"))
    return rows.select("pack", "oid", "chunk", F.floor(100 * done / F.col("_n") + 0.5).cast("long").alias("percent"))


def after_slice(total: Column, processed: Column, in_run: Column, next_total: Column) -> Column:
    """struct(action, delay): go on, begin the next pack, or go over to hydration. A next pack without objects is dropped."""
    pick = lambda action, delay: F.struct(F.lit(action).alias("action"), delay.cast("long").alias("delay"))
    return (
        F.when(processed < total, pick("continue", F.when(in_run == 0, BACKOFF_MS).otherwise(DELAY_MS)))
        .when(next_total > 0, pick("promote", F.lit(DELAY_MS)))
        .otherwise(pick("hydrate", F.lit(None)))
    )


def retries(events: DataFrame, key: str, order: list[str], failed: Column, at: Column, backoff: int) -> DataFrame:
    """``events`` with retries (failures since the last success, itself included) and retry_at, after a second at least."""
    line = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("_run", F.sum((~failed).cast("long")).over(line))
    count = F.sum(failed.cast("long")).over(Window.partitionBy(key, "_run").orderBy(*order))
    return rows.withColumn("retries", count).withColumn("retry_at", F.when(failed, at + max(1000, backoff))).drop("_run")


def token_sets(changes: DataFrame) -> DataFrame:
    """owner, tokens: after changes (owner, token, seq, added) in order; an owner without tokens is gone."""
    last = changes.groupBy("owner", "token").agg(F.max_by("added", "seq").alias("added")).where("added")
    return last.groupBy("owner").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def purged(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """``table`` without what is asked to be purged (key, confirm): the confirmation must be "purge-" and the key."""
    sure = requests.where(F.col("confirm") == F.concat(F.lit("purge-"), F.col(key).cast("string"))).select(key).distinct()
    return table.join(sure, key, "left_anti")


def fetch_plans(requests: DataFrame) -> DataFrame:
    """``requests`` (haves, packs, union_size, missing_roots, covering, closed) with plan.

    Without haves and with two packs or more, their union, widened if roots are missing from it. Otherwise one pack that covers the closure,
    or several; if the closure was cut off, the union again; nothing if there is no pack.
    """
    union = (F.col("haves") == 0) & (F.col("packs") >= 2) & (F.col("union_size") > 0)
    plan = (
        F.when(union & (F.col("missing_roots") > 0), "union of all")
        .when(union, "union")
        .when(F.col("packs") == 0, "not ready")
        .when(~F.col("closed"), F.when(F.col("packs") >= 2, "union").otherwise("not ready"))
        .when(F.col("covering") > 0, "one pack")
        .otherwise("several packs")
    )
    return requests.withColumn("plan", plan)


def missing_roots(wants: DataFrame, trees: DataFrame, held: DataFrame, most: int = 16) -> DataFrame:
    """request, missing: how many of the first ``most`` wanted commits have a root tree that is not ``held`` (request, oid); the limit is the feature."""
    first = wants.where(F.col("position") < most).join(trees.select(F.col("oid"), "tree"), "oid")
    lost = first.join(held.select("request", F.col("oid").alias("tree")).distinct().withColumn("_held", F.lit(True)), ["request", "tree"], "left")
    return lost.groupBy("request").agg(F.count_if(F.col("_held").isNull()).alias("missing"))
