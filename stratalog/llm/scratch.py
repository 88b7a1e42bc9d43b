"""Written tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table there and reading it
back; a lost executor then costs no more than the tasks it was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from stratalog.sources.staging import shared_dir, written  # noqa: F401


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch: texts are long, and a worker holds whole batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
