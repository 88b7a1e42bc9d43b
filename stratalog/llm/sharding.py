"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by (MD5 of the text, identifier), so that equal texts lie side
by side. A size-weighted sample of keys gives quantile boundaries; the rows are
range-partitioned by them, and a range that turns out overfull (many copies of
one text) is subdivided by more splitters drawn within it, on the identifier.
Exact totals of the ranges then place every row on the line of all bytes, and
each shard takes an equal stretch of that line: the splitters decide only how
the work is dealt, never how good the balance is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.scratch import written

RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 500_000
SAMPLES_PER_RANGE = 16
OVERFULL = 2.0
ROW_BYTES = 8


def _keyed(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """_md5, _size, _id and _key of each row, and ``columns`` as one, _row, so that no name of theirs can clash."""
    row = [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")] if columns else []
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + ROW_BYTES
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(*row, F.md5(text).alias("_md5"), size.alias("_size"), ident.alias("_id"))
    return rows.withColumn("_key", F.conv(F.substring("_md5", 1, 15), 16, 10).cast("long"))


def _with_range(rows: DataFrame, keys: np.ndarray, ids: np.ndarray) -> DataFrame:
    """Adds _range: the number of splitters (key, id) at or below the row's."""

    @F.pandas_udf("long")
    def range_of(key: pd.Series, ident: pd.Series) -> pd.Series:
        k, i = key.to_numpy(), ident.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.astype(np.int64)
        tied = np.flatnonzero(high > low)
        for at in np.unique(low[tied]):
            mine = tied[low[tied] == at]
            out[mine] += np.searchsorted(ids[at : high[mine[0]]], i[mine], "right")
        return pd.Series(out)

    return rows.withColumn("_range", range_of("_key", "_id"))


def _splitters(sample: list, width: float) -> list[tuple[int, int]]:
    """Boundaries after every ``width`` bytes of the weighted sample."""
    if not sample:
        return []
    points = sorted((r["_key"], r["_id"], r["_weight"]) for r in sample)
    reached = np.cumsum([w for *_, w in points])
    step = np.floor(reached / width)
    return [points[i][:2] for i in np.flatnonzero(np.diff(np.concatenate(([0.0], step))) > 0)]


def _sampled(rows: DataFrame, take: float) -> list:
    """About one key for each ``take`` bytes: a row is drawn with probability size / take, by hash, and stands for its share."""
    chance = F.least(F.lit(1.0), F.col("_size") / F.lit(take))
    draw = F.pmod(F.xxhash64("_md5", "_id", F.lit(29)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(draw < chance).select("_key", "_id", (F.col("_size") / chance).alias("_weight")).collect()


def with_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shard (0 .. shards - 1), slot (gapless from 0 in each shard) and size.

    Size is the UTF-8 length of the text (null: 0) plus 8. The shards' bytes differ
    by less than two of the largest rows. Equal texts lie side by side on the line of all bytes, but a group of
    them straddles a boundary that falls inside it: a group may hold a third of all bytes, so
    groups cannot be kept whole under this law. Rows that repeat text and identifier are
    interchangeable, and cannot be parted into ranges; null identifiers come first among equal texts. If ``docs`` has
    columns named shard, slot or size, they are replaced; all others stay as they are, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = written(_keyed(docs, id_col, text_col, []), "shard-keys")
    total, count = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    columns = [c for c in docs.columns if c not in ("shard", "slot", "size")]
    ranges = max(shards * RANGES_PER_SHARD, -(-count // ROWS_PER_RANGE))
    width = max(1.0, total / ranges)

    points = _splitters(_sampled(slim, width / SAMPLES_PER_RANGE), width)
    while True:
        keys, ids = np.array([p[0] for p in points], np.int64), np.array([p[1] for p in points], np.int64)
        ranged = _with_range(slim, keys, ids)
        sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_range_bytes"), F.count(F.lit(1)).alias("_range_rows"), F.max("_size").alias("_range_most"))
        found = sorted(sums.collect())  # one row for each range
        full = [r["_range"] for r in found if r["_range_bytes"] > max(OVERFULL * width, 2 * r["_range_most"])]
        if not full:
            break
        inside = ranged.where(F.col("_range").isin(full)) if len(full) <= 1000 else ranged
        more = _splitters(_sampled(inside, width / SAMPLES_PER_RANGE / 4), width / 2)
        if not set(more) - set(points):
            break
        points = sorted({*points, *more})

    offsets, bytes_before, rows_before = [], 0, 0
    for r in found:
        offsets.append((r["_range"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["_range_bytes"], rows_before + r["_range_rows"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "_range long, _bytes_before long, _rows_before long"))  # one row for each range

    def placed(rows: DataFrame) -> DataFrame:
        line = Window.partitionBy("_range").orderBy("_md5", "_id")
        rows = _with_range(rows, keys, ids).join(offsets, "_range")
        rows = rows.withColumn("_end", F.col("_bytes_before") + F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_at", F.col("_rows_before") + F.row_number().over(line) - 1)
        shard = F.expr(f"(2 * _end - _size) * {shards} div {2 * max(1, total)}")
        return rows.withColumn("_shard", F.least(shard, F.lit(shards - 1)).cast("int"))

    starts = F.broadcast(placed(slim).groupBy("_shard").agg(F.min("_at").alias("_start")))  # one row for each shard
    out = placed(_keyed(docs, id_col, text_col, columns)).join(starts, "_shard")
    return out.select(
        *(F.col("_row").getField(c).alias(c) for c in columns),
        F.col("_size").alias("size"),
        F.col("_shard").alias("shard"),
        (F.col("_at") - F.col("_start")).alias("slot"),
    )
