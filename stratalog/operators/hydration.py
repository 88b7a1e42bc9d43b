"""Hydration: which packs make the window, what they cover, what is still to be packed; and changes to pack lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 128


def stable_window(kept: DataFrame, most: int) -> DataFrame:
    """repo, pack, position: the first ``most`` hydration packs, in list order, of packs (repo, pack, ord, epoch, kept)."""
    line = Window.partitionBy("repo").orderBy("ord")
    rows = kept.where("kept and epoch is not null").withColumn("position", (F.row_number().over(line) - 1).cast("long"))
    return rows.where(F.col("position") < most).select("repo", "pack", "position")


def recent_window(listed: DataFrame, most: int) -> DataFrame:
    """repo, pack, position: the latest pack and then the others in list order, ``most`` at most."""
    line = Window.partitionBy("repo").orderBy(F.desc("is_latest"), "ord")
    return listed.withColumn("position", (F.row_number().over(line) - 1).cast("long")).where(F.col("position") < most).select("repo", "pack", "position")


def cover(window: DataFrame, members: DataFrame) -> DataFrame:
    """repo, oid: what the packs of a window hold."""
    return window.join(members.select("pack", "oid"), "pack").select("repo", "oid").distinct()


def sampled(entries: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Every n-th entry of each pack by offset, about ``most`` of them, evenly: the sampling is the feature."""
    line = Window.partitionBy("pack").orderBy("offset")
    rows = entries.withColumn("_at", F.row_number().over(line) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("pack")))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return rows.where((F.col("_at") % stride == 0) & (F.floor(F.col("_at") / stride) < most)).drop("_at", "_n")


def bases_to_pack(entries: DataFrame, members: DataFrame, covered: DataFrame) -> DataFrame:
    """repo, oid: bases of entries (repo, pack, base) that their pack does not hold or that are not covered."""
    rows = entries.where("base is not null").select("repo", "pack", F.col("base").alias("oid")).distinct()
    inside = members.select("pack", "oid").distinct().withColumn("_inside", F.lit(True))
    rows = rows.join(inside, ["pack", "oid"], "left").join(covered.select("repo", "oid").withColumn("_covered", F.lit(True)), ["repo", "oid"], "left")
    return rows.where("_inside is null or _covered is null").select("repo", "oid").distinct()


def plan(bases: DataFrame, loose: DataFrame, segment_objects: int) -> DataFrame:
    """repo, delta_bases, loose_only, to_pack, segments: an estimate of the work."""
    rows = bases.select("repo", F.lit(1).alias("b"), F.lit(0).alias("l")).unionByName(loose.select("repo", F.lit(0).alias("b"), F.lit(1).alias("l")))
    sums = rows.groupBy("repo").agg(F.sum("b").alias("delta_bases"), F.sum("l").alias("loose_only"))
    total = F.col("delta_bases") + F.col("loose_only")
    return sums.select("repo", "delta_bases", "loose_only", total.alias("to_pack"), F.ceil(total / segment_objects).cast("long").alias("segments"))


def inserted_after_latest(listed: DataFrame, new: DataFrame) -> DataFrame:
    """repo, pack, ord: the list with each repository's new pack right behind the latest one, in front if there is none."""
    rows = listed.select("repo", "pack", F.col("ord").cast("double").alias("at"), "is_latest")
    last = rows.where("is_latest").groupBy("repo").agg(F.min("at").alias("_last"))
    fresh = new.join(last, "repo", "left").select("repo", "pack", (F.coalesce("_last", F.lit(-1.0)) + 0.5).alias("at"))
    line = Window.partitionBy("repo").orderBy("at")
    return rows.select("repo", "pack", "at").unionByName(fresh).select("repo", "pack", (F.row_number().over(line) - 1).cast("long").alias("ord"))


def latest_of(listed: DataFrame, gone: Column) -> DataFrame:
    """repo, packs, latest: lists without the packs that are ``gone``; a latest pack that went is replaced by the first that stays."""
    left = F.when(~gone, F.col("pack"))
    rows = listed.groupBy("repo").agg(F.count(left).alias("packs"), F.max(F.when(F.col("is_latest"), left)).alias("_own"), F.min_by("pack", F.when(~gone, F.col("ord"))).alias("_first"))
    return rows.select("repo", "packs", F.when(F.col("packs") > 0, F.coalesce("_own", "_first")).alias("latest"))


def maintained(kept: DataFrame) -> DataFrame:
    """repo, removed, stays, latest, follow_up of lists (repo, pack, ord, epoch, is_latest, kept).

    A list without hydration packs is left alone. A follow-up is due only if a hydration pack goes.
    """
    has = F.max(F.col("epoch").isNotNull()).over(Window.partitionBy("repo"))
    rows = kept.withColumn("_gone", ~F.col("kept") & has)
    counts = rows.groupBy("repo").agg(F.count_if("_gone").alias("removed"), F.coalesce(F.bool_or(F.col("_gone") & F.col("epoch").isNotNull()), F.lit(False)).alias("follow_up"))
    return counts.join(latest_of(rows, F.col("_gone")), "repo").select("repo", "removed", F.col("packs").alias("stays"), "latest", "follow_up")
