"""Assembly of result packs: payload lengths, delta bases, order, header lengths and offsets."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import codec
from stratalog.sources.staging import written

TRAILER, START, ROUNDS = 20, 12, 16


def header_bytes(size: Column) -> Column:
    """Length of an entry's type and size: four bits, then seven a byte."""
    return F.when(size < 16, 1).otherwise(1 + F.ceil((F.length(F.bin(size)) - 4) / 7)).cast("long")


def distance_bytes(distance: Column) -> Column:
    """Length of the distance to a base; thresholds are where a byte more is needed."""
    found = F.lit(1)
    for least in (128, 16512, 2113664, 270549120):
        found = found + (distance >= least).cast("int")
    return found.cast("long")


def payloads(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """``entries`` (pack, oid, size, offset) with next_offset and payload: an entry ends where the next begins, the last one before the trailer of its pack (pack, pack_size)."""
    after = F.lead("offset").over(Window.partitionBy("pack").orderBy("offset"))
    rows = entries.withColumn("_next", after).join(packs.select("pack", "pack_size"), "pack")
    rows = rows.withColumn("next_offset", F.coalesce("_next", F.col("pack_size") - TRAILER)).drop("_next", "pack_size")
    return rows.withColumn("payload", F.col("next_offset") - F.col("offset") - header_bytes(F.col("size")))


def with_bases(selected: DataFrame, entries: DataFrame) -> DataFrame:
    """pack, oid, added, thin: the selected entries and, step by step, the bases of their deltas (pack, oid, base).

    ``thin`` marks an entry whose base its pack does not hold.
    """
    edges = entries.select("pack", "oid", "base").distinct()
    front = written(selected.select("pack", "oid").distinct(), "selected")
    found, step = front.withColumn("added", F.lit(False)), front
    while True:
        up = step.join(edges, ["pack", "oid"]).where("base is not null").select("pack", F.col("base").alias("oid")).distinct()
        step = written(up.join(edges.select("pack", "oid"), ["pack", "oid"], "left_semi").join(found, ["pack", "oid"], "left_anti"), "bases")
        if step.isEmpty():
            break
        found = found.unionByName(step.withColumn("added", F.lit(True)))
    held = edges.select("pack", F.col("oid").alias("base")).withColumn("_held", F.lit(True))
    rows = found.join(edges, ["pack", "oid"], "left").join(held, ["pack", "base"], "left")
    return rows.select("pack", "oid", "added", (F.col("base").isNotNull() & F.col("_held").isNull()).alias("thin"))


def topological(nodes: list[tuple], base: list[int | None]) -> list[int]:
    """Places of nodes, bases before their deltas, of those ready the smallest first; by size alone if there is a cycle."""
    after: dict[int, list[int]] = {}
    for i, b in enumerate(base):
        if b is not None:
            after.setdefault(b, []).append(i)
    ready = [(nodes[i], i) for i, b in enumerate(base) if b is None]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for j in after.get(i, ()):
            heapq.heappush(ready, (nodes[j], j))
    return out if len(out) == len(nodes) else sorted(range(len(nodes)), key=nodes.__getitem__)


def settled(sizes: list[int], payload: list[int], base: list[int | None], order: list[int]) -> list[tuple[int, int]]:
    """(offset, header length) of each node, written in ``order``: a delta's header holds the distance to its base, which depends on the headers between."""
    own = [len(codec.object_header(0, s)) for s in sizes]
    head = [h if b is None else h + 1 for h, b in zip(own, base, strict=True)]
    offset = [0] * len(sizes)
    for _ in range(ROUNDS + 1):
        at = START
        for i in order:
            offset[i], at = at, at + head[i] + payload[i]
        want = [h if b is None else h + len(codec.offset_distance(offset[i] - offset[b])) for i, (h, b) in enumerate(zip(own, base, strict=True))]
        if want == head:
            break
        head = want
    return list(zip(offset, head, strict=True))


def arranged(entries: DataFrame) -> DataFrame:
    """result, oid, position, offset, header of entries (result, oid, base, pack_ord, at, size, payload): the order and the places in each result pack.

    A result pack is one file, which one task writes; bases that are not in it count as none.
    """

    def arrange(rows: pa.Table) -> pa.Table:
        oid, base, size, payload = (rows[c].to_pylist() for c in ("oid", "base", "size", "payload"))
        place = {o: i for i, o in enumerate(oid)}
        bases = [place.get(b) if b is not None else None for b in base]
        order = topological(list(zip(rows["pack_ord"].to_pylist(), rows["at"].to_pylist(), oid, strict=True)), bases)
        position = [0] * len(oid)
        for k, i in enumerate(order):
            position[i] = k
        bases = [b if b is not None and position[b] < position[i] else None for i, b in enumerate(bases)]
        found = settled(size, payload, bases, order)
        columns = [position, [o for o, _ in found], [h for _, h in found]]
        return pa.table({"result": rows["result"], "oid": rows["oid"], **{n: pa.array(c, pa.int64()) for n, c in zip(("position", "offset", "header"), columns, strict=True)}})

    rows = entries.select(*(F.col(c).cast("long") for c in ("result", "oid", "base", "pack_ord", "at", "size", "payload")))
    return rows.groupBy("result").applyInArrow(arrange, "result long, oid long, position long, offset long, header long")


def pack_header(count: Column) -> Column:
    """The first twelve bytes of a pack: its mark, version 2 and the number of objects."""
    return F.concat(F.lit(b"PACK"), F.unhex(F.lit("00000002")), F.unhex(F.lpad(F.hex(count), 8, "0")))


def one_file(chosen: DataFrame) -> DataFrame:
    """oid, pack, offset of objects (oid, pack, ord, size) written pack after pack: the packs' sums are added up first, then each pack's own objects."""
    sums = chosen.groupBy("pack").agg(F.min("ord").alias("ord"), F.sum("size").alias("_bytes"))
    before = F.coalesce(F.sum("_bytes").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("pack").orderBy("oid").rowsBetween(Window.unboundedPreceding, -1)
    rows = chosen.select("oid", "pack", "size").join(sums.select("pack", before.alias("_before")), "pack")
    return rows.select("oid", "pack", (F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + START).alias("offset"))
