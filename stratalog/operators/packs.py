"""Packs: membership algebra, canonical copies, layout, ranges, coverage and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.sources.staging import written

HEADER_BYTES = 12
GAP, SPAN = 8 * 1024, 512 * 1024
SEGMENT_OBJECTS, SEGMENT_BYTES = 2000, 8 << 20


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def union_of(members: DataFrame, packs: DataFrame) -> DataFrame:
    """The distinct oids of the given packs."""
    return members.join(packs.select("pack"), "pack", "left_semi").select("oid").distinct()


def canonical(members: DataFrame, packs: DataFrame) -> DataFrame:
    """One row for each oid: its copy in the first pack by ``ord``, and the number of copies.

    A minimum per oid, not a window: copies are combined before the shuffle.
    """
    rows = members.join(packs.select("pack", "ord"), "pack")
    return rows.groupBy("oid").agg(F.min(F.struct("ord", "pack", "size")).alias("m"), F.count(F.lit(1)).alias("copies")).select("oid", "m.pack", "m.ord", "m.size", "copies")


def covering_packs(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """requests (request, oid): for each the packs that hold all of its oids; the request's size comes along."""
    need = wanted.distinct()
    sizes = need.groupBy("request").agg(F.count(F.lit(1)).alias("needed"))
    held = need.join(members.select("pack", "oid").distinct(), "oid").groupBy("request", "pack").agg(F.count(F.lit(1)).alias("held"))
    return held.join(sizes, "request").where("held = needed").select("request", "pack", "needed")


def layout(members: DataFrame) -> DataFrame:
    """pack, oid, size, offset, next_offset: objects in oid order after the header."""
    line = Window.partitionBy("pack").orderBy("oid")
    before = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = members.withColumn("offset", before + HEADER_BYTES)
    return rows.withColumn("next_offset", F.coalesce(F.lead("offset").over(line), F.col("offset") + F.col("size")))


def islands(ranges: DataFrame, gap: int) -> DataFrame:
    """pack, group, begin, end, n: ranges (pack, begin, end) joined while the gap between them is at most ``gap``."""
    line = Window.partitionBy("pack").orderBy("begin", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", F.coalesce((F.col("begin") - reach > gap).cast("long"), F.lit(0)))
    rows = rows.withColumn("group", F.sum("_new").over(line))
    return rows.groupBy("pack", "group").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def greedy_groups(ranges: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Like :func:`islands`, but a group also ends when it would span more than ``span`` bytes.

    The second rule depends on where the group began, so the ranges of a pack are folded in order.
    """
    points = F.sort_array(F.collect_list(F.struct("begin", "end")))
    one = "named_struct('begin', x.begin, 'end', x.end, 'n', 1L)"
    fold = f"""aggregate(p, cast(array() as array<struct<begin: bigint, end: bigint, n: bigint>>), (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.begin - element_at(acc, -1).end <= {gap} AND x.end - element_at(acc, -1).begin <= {span}
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, x.end), 'n', element_at(acc, -1).n + 1L)))
             ELSE concat(acc, array({one})) END)"""
    rows = ranges.groupBy("pack").agg(points.alias("p")).select("pack", F.posexplode(F.expr(fold)).alias("group", "g"))
    return rows.select("pack", F.col("group").cast("long"), "g.begin", "g.end", "g.n")


def delta_chains(entries: DataFrame) -> DataFrame:
    """pack, oid, depth, base: for entries (pack, oid, base) the steps to the first one without a base here.

    Every round doubles the steps that a row has gone, so a chain of any length costs the
    logarithm of its length. A chain that runs into a cycle has no such entry: its depth and base are null.
    """
    has = F.col("base").isNotNull()
    at = written(entries.select("pack", "oid", F.coalesce("base", "oid").alias("base"), has.cast("long").alias("depth")).distinct(), "delta-steps")
    longest = at.groupBy("pack").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    moving = True
    while moving:
        far = at.select("pack", F.col("oid").alias("base"), F.col("base").alias("_far"), F.col("depth").alias("_more"))
        more = F.coalesce("_more", F.lit(0))
        gone = at.join(far, ["pack", "base"], "left").select("pack", "oid", F.coalesce("_far", "base").alias("base"), (F.col("depth") + more).alias("depth"), (more > 0).alias("_moved"))
        at = written(gone, "delta-steps")
        moving = not at.where("_moved").where(F.col("depth") <= longest).isEmpty()  # more steps than entries: a cycle
        at = at.drop("_moved")
    ends = F.col("depth") <= longest
    return at.select("pack", "oid", F.when(ends, F.col("depth")).alias("depth"), F.when(ends, F.col("base")).alias("base"))


def uncovered(candidates: DataFrame, cover: DataFrame) -> DataFrame:
    """Candidates (work, oid) that no cover row holds; order and repeats of candidates are theirs."""
    return candidates.join(cover.select("work", "oid"), ["work", "oid"], "left_anti")


def estimated_bytes(length: Column) -> Column:
    """Stored size of a payload: ceil(0.6 * length) + 32, in integers."""
    return F.floor((length * 6 + 9) / 10).cast("long") + 32


def segments(objects: DataFrame, most_objects: int = SEGMENT_OBJECTS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """work, oid, segment: objects (work, oid, length) in oid order, packed into segments.

    A segment takes objects while it stays within both limits; one that is too large for
    the rest of it is passed over and waits for a later segment, and the first object
    of a segment is always taken. The fold is sequential for each work item.
    """

    def pack(rows):
        import numpy as np

        rows = rows.sort_values("oid", kind="stable").reset_index(drop=True)
        size = -(-rows["length"].to_numpy() * 6 // 10) + 32
        segment = np.full(len(rows), -1)
        left, number = list(range(len(rows))), 0
        while left:
            used, count, later = 0, 0, []
            for k, i in enumerate(left):
                if count >= most_objects:
                    later += left[k:]
                    break
                if count and used + size[i] > most_bytes:
                    later.append(i)
                    continue
                segment[i] = number
                used, count = used + size[i], count + 1
            left, number = later, number + 1
        return rows.assign(segment=segment)[["work", "oid", "segment"]]

    return objects.select("work", "oid", "length").groupBy("work").applyInPandas(pack, "work long, oid long, segment long")


def keep_set(packs: DataFrame, keep: int) -> DataFrame:
    """``packs`` (repo, pack, ord, epoch, is_latest) with kept: the weighted prefix that stays.

    Units are the latest pack, then epochs as wholes, then single packs, each in list order; a
    unit stays if the units before it weigh less than ``keep``.
    """
    unit = F.when(F.col("is_latest"), F.lit(-1)).when(F.col("epoch").isNotNull(), F.min("ord").over(Window.partitionBy("repo", "epoch"))).otherwise(F.col("ord"))
    kind = F.when(F.col("is_latest"), 0).when(F.col("epoch").isNotNull(), 1).otherwise(2)
    rows = packs.withColumn("_kind", kind).withColumn("_unit", unit)
    weights = rows.groupBy("repo", "_kind", "_unit").agg(F.count(F.lit(1)).alias("_w"))
    line = Window.partitionBy("repo").orderBy("_kind", "_unit").rowsBetween(Window.unboundedPreceding, -1)
    weights = weights.withColumn("kept", F.coalesce(F.sum("_w").over(line), F.lit(0)) < keep).drop("_w")
    return rows.join(weights, ["repo", "_kind", "_unit"]).drop("_kind", "_unit")


def orphans(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored files whose pack is not kept."""
    return files.join(kept.where("kept").select("pack"), "pack", "left_anti")


def candidate_order(packs: DataFrame) -> DataFrame:
    """pack, rank: the latest first, then hydration packs, then the rest, each in list order."""
    line = Window.partitionBy("repo").orderBy(F.desc("is_latest"), F.desc("is_hydration"), "ord")
    return packs.select("repo", "pack", F.row_number().over(line).cast("long").alias("rank"))
