"""The shared folder, and what the session's settings say about partitions and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import drop_folder, fresh_folder, stored

__all__ = ["drop_folder", "fresh_folder", "shuffle_partitions", "small_batches", "stored", "unused"]

#: Rows of text that go to a Python worker at once.
ARROW_ROWS = 1000


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: the session sends ``ARROW_ROWS`` rows at once, if it would send more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with so many underscores more that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
