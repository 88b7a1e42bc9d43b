"""Batched lookups and pages: what point reads of stored tables become over many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``requests`` (key, offset, length, ...) with data: the bytes of the range, fewer at the end of the file, null without a file."""
    found = requests.join(files.select("key", "content"), "key", "left")
    return found.withColumn("data", F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))).drop("content")


def lists_of(requests: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """key, values: every requested key once, with its values in order, none for a key unknown to ``table``."""
    rows = requests.select(key).distinct().join(table.select(key, value).distinct(), key, "left")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def page(table: DataFrame, group: str, order: list, limit: int, offset: int = 0, after: Column | None = None) -> DataFrame:
    """A page of each group in ``order``, from ``offset`` rows after the cursor ``after``; a limit of 0 means all."""
    rows = table if after is None else table.where(after)
    line = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumn("position", F.row_number().over(line).cast("long"))
    bounds = F.col("position") > offset
    return rows.where(bounds & (F.col("position") <= offset + limit) if limit > 0 else bounds)


def first_tier(requests: DataFrame, key: str, tiers: list[tuple[DataFrame, str]]) -> DataFrame:
    """``requests`` with value: that of the first tier (table, column) which has the key."""
    rows, names = requests, []
    for i, (tier, column) in enumerate(tiers):
        names.append(f"_tier{i}")
        rows = rows.join(tier.groupBy(key).agg(F.first(column).alias(names[-1])), key, "left")
    return rows.withColumn("value", F.coalesce(*names)).drop(*names)


def merged_unique(lists: list[DataFrame], group: str, key: str) -> DataFrame:
    """group, key, ord: the keys of lists (group, key, ord) one after another, each at its first place."""
    rows = None
    for rank, one in enumerate(lists):
        one = one.select(group, key, F.struct(F.lit(rank).alias("list"), F.col("ord")).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.groupBy(group, key).agg(F.min("at").alias("at"))
    line = Window.partitionBy(group).orderBy("at", key)
    return rows.select(group, key, (F.row_number().over(line) - 1).cast("long").alias("ord"))


def arguments(lines: DataFrame, group: str, order: str) -> DataFrame:
    """group, command, arguments of requests in packets (group, order, kind, line): what follows "command=", and the lines after the delimiter."""
    line = Window.partitionBy(group).orderBy(order)
    rows = lines.withColumn("_after", F.coalesce(F.max(F.col("kind") == "delim").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    command = F.min(F.when(~F.col("_after") & F.col("line").startswith("command="), F.struct(F.col(order), F.substring("line", 9, 1 << 30).alias("name"))))
    taken = F.transform(F.array_sort(F.collect_list(F.when(F.col("_after") & (F.col("kind") == "line"), F.struct(F.col(order), F.col("line"))))), lambda x: x["line"])
    return rows.groupBy(group).agg(command["name"].alias("command"), taken.alias("arguments"))
