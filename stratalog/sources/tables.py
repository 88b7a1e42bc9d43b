"""Readers of the input tables, and the version-history relations derived from them.

The input is relational, so histories are derived by fixed rules: an order is a
commit of its customer's branch in the repository of the customer's nation; an urgent
order also merges the latest commit of its repository; a month of shipping is a pack, a
part a blob in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, oid, author, when_s, message, p1 (first parent), p2 (second parent of a merge)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("repo"))
    line = lambda *keys: Window.partitionBy(*keys).orderBy("o_orderdate", "o_orderkey")
    rows = orders.join(owner, "o_custkey").withColumn("p1", F.lag("o_orderkey").over(line("o_custkey"))).withColumn("_pn", F.lag("o_orderkey").over(line("repo")))
    merge = (F.col("o_orderpriority") == "1-URGENT") & ~F.col("_pn").eqNullSafe(F.col("p1"))
    return rows.select(
        "repo",
        F.col("o_orderkey").alias("oid"),
        F.col("o_custkey").alias("author"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("when_s"),
        F.col("o_orderpriority").alias("message"),
        "p1",
        F.when(merge, F.col("_pn")).alias("p2"),
    )


def parent_edges(rows: DataFrame) -> DataFrame:
    """repo, src, dst, ordinal (0 first parent, 1 merged parent)."""
    return rows.select("repo", "oid", F.posexplode(F.array("p1", "p2")).alias("ordinal", "dst")).where("dst is not null").select("repo", F.col("oid").alias("src"), "dst", "ordinal")


#: Derived ids: the root tree of a commit, and the blob of a part.
TREES, BLOBS = 4_000_000_000, 8_000_000_000


def object_edges(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """repo, src, dst, role: a commit needs its parents and its root tree, which holds the order's parts as blobs."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), (F.col("l_partkey") + BLOBS).alias("dst")).distinct()
    parents = parent_edges(rows).select("repo", "src", "dst", F.lit("parent").alias("role"))
    trees = rows.select("repo", F.col("oid").alias("src"), (F.col("oid") + TREES).alias("dst"), F.lit("tree").alias("role"))
    entries = lines.join(rows.select("repo", "oid"), "oid").select("repo", (F.col("oid") + TREES).alias("src"), "dst", F.lit("entry").alias("role"))
    return parents.unionByName(trees).unionByName(entries)


def branch_heads(rows: DataFrame) -> DataFrame:
    """repo, name, oid: the latest commit of each author."""
    latest = F.max_by("oid", F.struct("when_s", "oid")).alias("oid")
    return rows.groupBy("repo", "author").agg(latest).select("repo", F.concat(F.lit("refs/heads/c"), "author").alias("name"), "oid")


def tags(rows: DataFrame) -> DataFrame:
    """repo, name, oid, peeled: the tag of each repository is an object of its own that points to the latest commit."""
    latest = F.max_by("oid", F.struct("when_s", "oid")).alias("peeled")
    return rows.groupBy("repo").agg(latest).select("repo", F.concat(F.lit("refs/tags/n"), "repo").alias("name"), (-F.col("peeled")).alias("oid"), "peeled")


def heads(rows: DataFrame) -> DataFrame:
    """repo, target: HEAD points to the branch of the lowest author."""
    return rows.groupBy("repo").agg(F.concat(F.lit("refs/heads/c"), F.min("author")).alias("target"))


def pack_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack (yyyymm), oid, size: the distinct parts shipped in a month, with the quantity as stored length."""
    rows = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("pack"), F.col("l_partkey").alias("oid"), F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("pack", "oid").agg(F.sum("q").alias("size"))


def pack_list(members: DataFrame) -> DataFrame:
    """pack, ord (newest first), is_hydration, epoch, is_latest, n: a few rows for each month of data, ordered in one task."""
    packs = members.groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("pack"))
    month = F.col("pack") % 100
    return packs.select(
        "pack",
        (F.row_number().over(whole) - 1).cast("long").alias("ord"),
        (month % 3 == 0).alias("is_hydration"),
        F.when(month % 3 == 0, F.floor(F.col("pack") / 100)).cast("long").alias("epoch"),
        (F.row_number().over(whole) == 1).alias("is_latest"),
        "n",
        "bytes",
    )


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """push (ten minutes of events), seq, user_id, event_type, ts_s, event_id."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"))
