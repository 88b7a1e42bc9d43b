"""Changes to stored sets: insert-ignore, deletion, key normalisation, pack lists, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the file names of hydration packs.
HYDRATION_KEY = r"pack-hydr-(e[0-9A-Za-z]+)-\d+\.pack$"


def insert_ignore(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``incoming`` whose keys are new; repeats in ``incoming`` count once."""
    return table.unionByName(incoming.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def backfill(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``incoming`` whose key it does not have at all."""
    return table.unionByName(incoming.join(table.select(key).distinct(), key, "left_anti"))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def normalized(table: DataFrame, key: str, others: list[str]) -> DataFrame:
    """``table`` with base names as keys; rows that become equal are one."""
    return table.withColumn(key, basename(F.col(key))).dropDuplicates([key, *others])


def epoch_of(key: Column) -> Column:
    """The epoch in a hydration pack's key; null for others."""
    return F.nullif(F.regexp_extract(key, HYDRATION_KEY, 1), F.lit(""))


def pushed_front(listed: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """repo, pack, ord: new packs (repo, pack) before those listed (repo, pack, ord), without repeats, ``most`` at most for each repository."""
    rows = new.select("repo", "pack", F.lit(-1).cast("long").alias("ord")).unionByName(listed.select("repo", "pack", "ord"))
    rows = rows.groupBy("repo", "pack").agg(F.min("ord").alias("ord"))
    line = Window.partitionBy("repo").orderBy("ord", F.desc("pack"))
    return rows.withColumn("ord", (F.row_number().over(line) - 1).cast("long")).where(F.col("ord") < most)


def registry_sync(asked: DataFrame, alive: DataFrame) -> DataFrame:
    """owner, repo, action: asked repositories with references are added, the others removed."""
    found = asked.join(alive.select("owner", "repo").distinct().withColumn("_alive", F.lit(True)), ["owner", "repo"], "left")
    return found.select("owner", "repo", F.when(F.col("_alive").isNotNull(), "added").otherwise("removed").alias("action"))


def presence(asked: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """``asked`` (oid) with a flag for each tier that holds the oid."""
    for name, tier in tiers.items():
        asked = asked.join(tier.select("oid").distinct().withColumn(name, F.lit(True)), "oid", "left")
    return asked.select("oid", *(F.coalesce(name, F.lit(False)).alias(name) for name in tiers))


def first_found(asked: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """oid, payload, tier: each object from the first tier (oid, payload) that has it; null payload if none has."""
    every = None
    for rank, tier in enumerate(tiers):
        rows = tier.select("oid", "payload", F.lit(rank).cast("long").alias("tier"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("oid").agg(F.min_by("payload", "tier").alias("payload"), F.min("tier").alias("tier"))
    return asked.select("oid").distinct().join(best, "oid", "left")
