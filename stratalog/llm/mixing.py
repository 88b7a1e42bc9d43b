"""Mixing sources to target weights. DataFrame operations only.

The words of each source are counted, the targets and with them the repetition
rates derived, and each document is emitted floor(rate) times plus one copy
with probability equal to the fraction.

The copy is a hash-seeded Bernoulli draw, stratified: the documents of a source
are dealt by hash into cells of about ``CELL_ROWS``; in a cell, sorted by size, the
k-th document gets its copy when floor(f * k + u) steps up, u being a uniform
number hashed from the cell. The probability of each draw is exactly f, and the
sum stays near its expectation even in a source of a few dozen documents. A
cell is bounded, so a source that holds a third of all rows is sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 1024
MOST_REPEATS = 3
#: Up to so many sources the table of rates is broadcast (some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*parts):
    """A uniform number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(_source, _rows, _words, _target) for rows of (_source, _words).

    The weights repeat over the sources in code-point order, null last. Targets
    share all words by weight; one that exceeds MOST_REPEATS times its source's
    words stops there, and the excess is shared again by weight. Sources are few
    next to rows; their table is ordered in one task.
    """
    per = sizes.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_words").alias("_words"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("_weight", weight).withColumn("_cap", F.col("_words") * MOST_REPEATS)
    # Sources reach their cap in the order of cap / weight: find how many of them do.
    order = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*",
        (F.sum("_words").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
        (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))).alias("_share"),
        F.row_number().over(order).alias("_at"),
    )
    capped = F.col("_cap") * F.col("_share") <= F.col("_left") * F.col("_weight")
    first_free = F.min(F.when(~capped, F.col("_at"))).over(whole)
    is_free = F.coalesce(F.col("_at") >= first_free, F.lit(False))
    left = F.max(F.when(F.col("_at") == first_free, F.col("_left"))).over(whole)
    share = F.max(F.when(F.col("_at") == first_free, F.col("_share"))).over(whole)
    target = F.when(is_free, (left * F.col("_weight")).cast("double") / share.cast("double")).otherwise(F.col("_cap").cast("double"))
    return per.select("_source", "_rows", F.col("_words").alias("_source_words"), target.alias("_target"))


def mixed_rows(docs: DataFrame, columns: list[str], source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """_row (``columns`` of each row of ``docs``), _words, _source_words, _target and _copies, the times the row is to be emitted.

    A null text has no words, a null source is a source of its own, the last. A
    source without words has target 0 and no copies. The draws depend on
    identifier (without one, on the text), size and source alone, so reruns agree; rows that repeat an
    identifier are drawn one by one. Columns may have any names: they travel inside _row. An empty table gives no rows.
    """
    of = lambda c: F.col(f"`{c}`")
    name = F.coalesce(of(id_col).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(of(text_col), F.lit("")).cast("binary"))))
    rows = docs.select(F.struct(*(of(c) for c in columns)).alias("_row"), of(source_col).alias("_source"), word_count(of(text_col)).alias("_words"), name.alias("_name"))
    targets = source_targets(rows.select("_source", "_words"), weights).withColumnRenamed("_source", "_target_source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = rows.join(targets, rows["_source"].eqNullSafe(targets["_target_source"]))
    rate = F.when(F.col("_source_words") > 0, F.col("_target") / F.col("_source_words")).otherwise(F.lit(0.0))
    draw = unit_hash(F.lit(str(seed)), F.col("_name"), F.col("_words").cast("string"))
    rows = rows.withColumn("_rate", rate).withColumn("_draw", draw)
    cells = F.ceil(F.col("_rows") / CELL_ROWS)
    rows = rows.withColumn("_cell", F.floor(F.col("_draw") * cells).cast("long"))
    ladder = Window.partitionBy("_source", "_cell").orderBy("_words", "_draw")
    k = F.row_number().over(ladder)
    u = unit_hash(F.lit(str(seed + 1)), F.coalesce(F.col("_source").cast("string"), F.lit("")), F.col("_cell").cast("string"))
    rows = rows.withColumn("_k", k).withColumn("_u", u)
    part = F.col("_rate") - F.floor("_rate")
    extra = F.floor(part * F.col("_k") + F.col("_u")) - F.floor(part * (F.col("_k") - 1) + F.col("_u"))
    return rows.select("_row", "_words", "_source_words", "_target", (F.floor("_rate") + extra).cast("int").alias("_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source's rate asks, columns unchanged."""
    rows = mixed_rows(docs, docs.columns, **options).where(F.col("_copies") > 0)
    rows = rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row."""
    id_col = options.get("id_col", "doc_id")
    rows = mixed_rows(docs, [id_col], **options)
    return rows.select(
        F.col("_row").getField(id_col).alias("doc_id"),
        F.col("_words").alias("size"),
        F.col("_source_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_words") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
    )
