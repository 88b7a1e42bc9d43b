"""Exact deduplication by a tree-merge of digest runs. DataFrame operations only.

Each input partition holds a run of (digest, identifier) pairs. In binomial
rounds of ``FAN_IN`` the partitions exchange their runs: a round merges the runs
of FAN_IN neighbours, and for each digest keeps the extreme identifier and the
number of rows. No round sends more than FAN_IN rows of a digest to one task,
whatever its number of copies, and the verdicts go down the same tree, so
a text that fills a third of the table is never in one task either.

A digest is xxhash64; equality is verified by SHA-256 and byte length, which are
part of the merge key at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAN_IN_BITS = 3
KEY = ["_digest", "_sha", "_bytes"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as
    empty. ``keep`` names the identifier that stays, ``smallest`` or ``largest``;
    a null identifier stays only in a group that has no other. If rows repeat the
    identifier that stays, each of these rows is marked as kept. Columns of
    ``docs`` other than the two named are not read. An empty table gives no rows.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id",
        F.xxhash64("_text").alias("_digest"),
        F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.octet_length("_text").cast("long").alias("_bytes"),
        F.spark_partition_id().alias("_run0"),
    )
    base = written(base, "exact-runs")
    most = base.agg(F.max("_run0")).first()[0] or 0
    rounds = max(1, -(-int(most).bit_length() // FAN_IN_BITS))

    levels, below = [], base.select(*KEY, "_run0", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    for r in range(1, rounds + 1):
        run = F.shiftright(f"_run{r - 1}", FAN_IN_BITS).alias(f"_run{r}")
        below = below.groupBy(*KEY, run).agg(best("_keep").alias("_keep"), F.sum("_size").alias("_size"))
        below = written(below, f"exact-level{r}")
        levels.append(below)

    verdict = levels.pop()
    for r in range(rounds - 1, 0, -1):
        lower = levels.pop().select(*KEY, f"_run{r}", F.shiftright(f"_run{r}", FAN_IN_BITS).alias(f"_run{r + 1}"))
        verdict = lower.join(verdict, [*KEY, f"_run{r + 1}"]).select(*KEY, f"_run{r}", "_keep", "_size")
    rows = base.withColumn("_run1", F.shiftright("_run0", FAN_IN_BITS)).join(verdict, [*KEY, "_run1"])
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` whose identifier stays."""
    stays = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_kept_id"]), "left_semi")
