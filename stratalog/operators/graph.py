"""Walks over commit graphs: closure, difference, first-parent pages, merge sides, levels.

Closures of repositories that fit in a task are walked there, one task for each repository; larger ones, and
graphs without repositories, by a frontier loop over written tables, one join a level. Linear
chains are jumped over by tables of 1, 2, 4, ... steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.sources.staging import written

#: Edges of a repository that one task walks (some 100 bytes each); beyond, its closure is a frontier loop.
TASK_EDGES = 4_000_000


def reach(src: np.ndarray, dst: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The nodes reachable from ``start``, itself included; those of ``stop`` are neither given nor passed."""
    nodes = np.unique(np.concatenate((src, dst, start)))
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    order = np.argsort(s, kind="stable")
    d, begin = d[order], np.searchsorted(s[order], np.arange(len(nodes) + 1))
    seen = np.isin(nodes, stop)
    found = np.zeros(len(nodes), bool)
    front = np.unique(np.searchsorted(nodes, start))
    front = front[~seen[front]]
    while len(front):
        seen[front] = found[front] = True
        size = begin[front + 1] - begin[front]
        at = np.repeat(begin[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        front = np.unique(d[at])
        front = front[~seen[front]]
    return nodes[found]


def closure(edges: DataFrame, roots: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(root, oid) reachable from roots (root, oid), roots included; nodes of ``stop`` (root, oid) are neither given nor passed.

    Edges are (src, dst), or (root, src, dst) if they lie in one root's repository each. Ids
    unknown to ``edges`` stay as leaves. Cycles end because a node is expanded once.
    """
    if "root" not in edges.columns:
        return _by_levels(edges, roots, stop)
    edges = written(edges.select("root", "src", "dst").distinct(), "edges")
    large = [r[0] for r in edges.groupBy("root").count().where(F.col("count") > TASK_EDGES).select("root").limit(1).collect()]
    if large:
        return _by_levels(edges, roots, stop)
    none = F.lit(None).cast("long")
    parts = edges.select("root", "src", "dst", F.lit(0).alias("kind")).unionByName(roots.select("root", F.col("oid").alias("src"), none.alias("dst"), F.lit(1).alias("kind")))
    if stop is not None:
        parts = parts.unionByName(stop.select("root", F.col("oid").alias("src"), none.alias("dst"), F.lit(2).alias("kind")))

    def walk(rows: pa.Table) -> pa.Table:
        kind, src = rows["kind"].to_numpy(), rows["src"].to_numpy()
        dst = rows["dst"].fill_null(0).to_numpy()
        found = reach(src[kind == 0], dst[kind == 0], src[kind == 1], src[kind == 2])
        return pa.table({"root": pa.array(np.full(len(found), rows["root"][0].as_py())), "oid": pa.array(found)})

    return parts.groupBy("root").applyInArrow(walk, "root long, oid long")


def _by_levels(edges: DataFrame, roots: DataFrame, stop: DataFrame | None) -> DataFrame:
    keys = ["root", "oid"]
    edges = written(edges.select(*(c for c in ("root", "src", "dst") if c in edges.columns)).distinct(), "edges").withColumnRenamed("src", "oid")
    on = ["root", "oid"] if "root" in edges.columns else ["oid"]
    front = roots.select(*keys).distinct()
    if stop is not None:
        stop = written(stop.select(*keys).distinct(), "stop")
        front = front.join(stop, keys, "left_anti")
    front = written(front, "front")
    seen = front
    while not front.isEmpty():
        step = front.join(edges, on).select("root", F.col("dst").alias("oid")).distinct()
        step = step.join(seen, keys, "left_anti")
        if stop is not None:
            step = step.join(stop, keys, "left_anti")
        front = written(step, "front")
        seen = seen.unionByName(front)
    return seen


def needed(edges: DataFrame, wants: DataFrame, haves: DataFrame) -> DataFrame:
    """The exact difference: closure of the wants less closure of the haves, for each root."""
    return closure(edges, wants).join(closure(edges, haves), ["root", "oid"], "left_anti")


def ancestors(commits: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(root, oid, depth) along first parents, at most ``depth`` steps from starts (root, oid); a cycle is gone round once.

    Every (start, number of steps) is one row, which takes the jumps of its number's bits.
    """
    rows = starts.select("root", "oid").distinct().select("root", "oid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth).cast("long"))).alias("depth"))
    known = commits.select("oid").distinct()
    jump = written(commits.where("p1 is not null").select("oid", F.col("p1").alias("_to")).distinct(), "jumps")
    rows = rows.join(known.withColumnRenamed("oid", "_known").withColumn("_in", F.lit(True)), F.col("oid") == F.col("_known"), "left").where("_in or depth = 0").select("root", "oid", "depth")
    for bit in range(max(depth, 1).bit_length()):
        goes = F.expr(f"(depth & {1 << bit}) > 0")
        rows = rows.join(jump, "oid", "left").withColumn("oid", F.when(goes, F.col("_to")).otherwise(F.col("oid"))).where("oid is not null").select("root", "oid", "depth")
        if 2 << bit <= depth:
            far = jump.select(F.col("oid").alias("_to"), F.col("_to").alias("_far"))
            jump = written(jump.join(far, "_to").select("oid", F.col("_far").alias("_to")), "jumps")
    return rows.groupBy("root", "oid").agg(F.min("depth").alias("depth"))


def first_parent_page(commits: DataFrame, starts: DataFrame, offset: int, limit: int) -> DataFrame:
    """The commits offset .. offset + limit - 1 of each start's first-parent history."""
    walk = ancestors(commits, starts, offset + limit - 1).where((F.col("depth") >= offset) & (F.col("depth") < offset + limit))
    return walk.join(commits.select("oid", "author", "when_s", "message", F.col("p2").isNotNull().alias("is_merge")), "oid")


def merge_side(commits: DataFrame, merges: DataFrame, limit: int, probe: int) -> DataFrame:
    """(merge, oid, rank): commits a merge brought in, newest first.

    The merged parent's first-parent chain, up to the mainline (the first-parent chain of the
    merge itself, ``probe`` long). A commit never comes before one that it is an ancestor of:
    the order is by the lowest time so far along the chain, then by id, latest first.
    """
    side = ancestors(commits, merges.select(F.col("oid").alias("root"), F.col("p2").alias("oid")), limit)
    main = ancestors(commits, merges.select(F.col("oid").alias("root"), F.col("p1").alias("oid")).where("oid is not null"), probe)
    hit = side.join(main.select("root", "oid"), ["root", "oid"]).groupBy("root").agg(F.min("depth").alias("stop"))
    side = side.join(hit, "root", "left").where("stop is null or depth < stop")
    chain = Window.partitionBy("root").orderBy("depth")
    timed = side.join(commits.select("oid", "when_s"), "oid").withColumn("key", F.min(F.struct("when_s", "oid")).over(chain))
    order = Window.partitionBy("root").orderBy(F.desc("key"), "depth")
    return timed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select(F.col("root").alias("merge"), "oid", "rank")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(oid, level): the longest path from a node down to one without parents; parents always have lower levels.

    Relaxes level by level until nothing moves; a graph with a cycle has no levels and raises ValueError.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    front = written(nodes.select("oid").distinct(), "front")
    count, level, seen = front.count(), 0, front.withColumn("level", F.lit(0).cast("long"))
    while not front.isEmpty():
        level += 1
        if level > count:
            raise ValueError("a cycle has no levels")
        front = written(front.join(edges, front["oid"] == edges["dst"]).select(F.col("src").alias("oid")).distinct(), "front")
        seen = seen.unionByName(front.withColumn("level", F.lit(level).cast("long")))
    return seen.groupBy("oid").agg(F.max("level").alias("level"))


def unwrap(tags: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """(name, oid, final, steps): follows tags of tags; a chain longer than ``most`` has no final object."""
    rows = starts.select("name", "oid", F.col("oid").alias("final"), F.lit(0).cast("long").alias("steps"))
    hop = tags.select(F.col("oid").alias("final"), F.col("target").alias("_next"))
    for _ in range(most):
        rows = rows.join(hop, "final", "left").select("name", "oid", F.coalesce("_next", "final").alias("final"), (F.col("steps") + F.col("_next").isNotNull().cast("long")).alias("steps"))
    rest = hop.select("final", F.lit(True).alias("_more"))
    return rows.join(rest, "final", "left").select("name", "oid", F.when(F.col("_more").isNull(), F.col("final")).alias("final"), "steps")


def integrity(targets: DataFrame, kinds: DataFrame, needs: DataFrame, tags: DataFrame) -> DataFrame:
    """request, oid, final, kind, status of targets (request, oid) of reference updates.

    Tags (oid, target) are followed three levels at most; ``kinds`` (oid, kind) are the objects that any store has; of a commit its
    tree and its parents must be there, as ``needs`` (src, dst, role) says. Anything unknown is refused.
    """
    rows = unwrap(tags, targets.select(F.col("request").alias("name"), "oid")).withColumnRenamed("name", "request")
    known = kinds.select("oid", "kind").distinct()
    rows = rows.join(known.withColumnRenamed("oid", "final"), "final", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    lost = rows.where("kind = 'commit'").select(F.col("final").alias("src")).distinct().join(needs, "src").join(known.select(F.col("oid").alias("dst")), "dst", "left_anti")
    lost = lost.groupBy(F.col("src").alias("final")).agg(F.max("role").alias("_lost"))
    status = F.when(F.col("kind") == "unknown", "unknown object").when(F.col("_lost").isNotNull(), F.concat(F.lit("missing "), "_lost")).otherwise("ok")
    return rows.join(lost, "final", "left").select("request", "oid", "final", "kind", status.alias("status"))
