"""Documents dealt to tasks in ascending ``doc_id`` order without sorting the whole table in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shuffle_partitions

#: Rows to a range at most, on average; there are as many ranges as shuffle partitions at least.
RANGE_ROWS = 50_000


def bucket_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending ids that cut the table into nearly equal ranges; reads ``doc_id`` alone."""
    if n < 2:
        return []
    parts = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = docs.agg(F.percentile_approx("doc_id", parts, max(10_000, 20 * n)).alias("b")).first()
    return sorted(set(row["b"] or []))


def bucket_of(doc_id, bounds: list[int]):
    """The number of bounds at or below the id, by a search in two levels; null goes first."""
    if not bounds:
        return F.lit(0)
    m = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    below = lambda a: F.size(F.filter(a, lambda b: b <= doc_id))
    coarse = below(F.array(*[F.lit(c[-1]) for c in chunks]))
    fine = F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), coarse)
    return F.when(doc_id.isNull(), 0).otherwise(coarse * m + F.coalesce(below(fine), F.lit(0)))


def in_order(docs: DataFrame, guests: bool = False) -> DataFrame:
    """Columns bucket, guest, doc_id, text: each bucket a range of ids, one bucket per task, rows ascending.

    With ``guests`` each bucket is followed by a copy of the first row of the next one that has rows (the last
    one by a copy of the table's first row), marked ``guest``, so that every row has its successor beside it.
    Ties of ``doc_id`` are ordered by the text's hash and the text.
    """
    n = max(shuffle_partitions(docs.sparkSession), -(-docs.count() // RANGE_ROWS))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = bucket_bounds(own, n)
    own = own.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    own = own.withColumn("tie", tie)
    if guests:
        # one row of two numbers per bucket comes to the driver: as many as there are tasks
        firsts = own.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("f")).collect()
        firsts = sorted((r["bucket"], r["f"]["doc_id"], r["f"]["tie"]) for r in firsts)
        rows = [(b, d, t, firsts[i - 1][0]) for i, (b, d, t) in enumerate(firsts)]
        table = docs.sparkSession.createDataFrame(rows, "bucket int, first_id long, first_tie long, to int")
        own = own.join(F.broadcast(table), "bucket")
        at = lambda bucket, guest: F.struct(F.col(bucket).alias("bucket"), F.lit(guest).alias("guest"))
        first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
        copies = F.when(first, F.array(at("bucket", False), at("to", True))).otherwise(F.array(at("bucket", False)))
        own = own.select(F.explode(copies).alias("at"), "doc_id", "tie", "text").select("at.bucket", "at.guest", "doc_id", "tie", "text")
    else:
        own = own.withColumn("guest", F.lit(False))
    return own.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", "doc_id", "tie", "text").drop("tie")
