"""Interval algebra on half-open [start, end) rows, all as windows and equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordered import WIDTH, carried, placed, stretched, within

#: Positions to a bucket of the joins.
BUCKET = 1 << 16


def merge_intervals(iv: DataFrame, keys: list[str] = ["chrom"], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """Union of overlapping and touching intervals per key: keys, start, end."""
    rows = stretched(iv.select(*keys, "start", "end"), keys, F.col("start"), {"reached": ("max", F.col("end"))}, width)
    w = within(keys, "start", "end")
    prior = F.greatest(F.col("reached"), F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = stored(rows.withColumn("opens", F.when(prior.isNull() | (F.col("start") > prior), 1).otherwise(0)).drop("reached", "_stretch"), "merge")
    # the number of the island: islands opened in this stretch so far, and in all before
    counted = stretched(rows, keys, F.col("start"), {"islands": ("sum", F.col("opens"))}, width)
    number = F.col("islands") + F.sum("opens").over(within(keys, "start", "end", F.col("opens").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_n", number).groupBy(*keys, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_n")


def state_runs(iv: DataFrame, classes: list[str], state: Callable[[dict[str, Column]], Column], width: int = WIDTH) -> DataFrame:
    """Runs of positions with one state, as long as they can be: class (the state), chrom, start, end.

    ``iv``: chrom, start, end, class; it is read twice. ``state``: from the numbers of intervals of each class over a
    position, a text, or null for none. Ends are shuffled once, to their stretch, and only changes of state leave it; what
    lies on the seams of stretches, two rows a stretch at most, is merged.
    """
    edge = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    edges = iv.filter("end > start").select("chrom", "class", edge.alias("e"))
    edges = edges.select("chrom", F.col("e.pos").alias("pos"), *[F.when(F.col("class") == c, F.col("e.d")).otherwise(0).alias(f"d_{c}") for c in classes])
    edges = placed(edges, ["chrom"], F.col("pos"), width)
    before = carried(edges, ["chrom"], {f"c_{c}": ("sum", F.col(f"d_{c}")) for c in classes} | {"after": ("next", F.col("pos"))})
    rows = edges.repartition("_stretch").groupBy("chrom", "_stretch", "pos").agg(*[F.sum(f"d_{c}").alias(f"d_{c}") for c in classes]).join(before, "_stretch")
    w = within(["chrom"], "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    over = {f"n_{c}": F.col(f"c_{c}") + F.sum(f"d_{c}").over(upto) for c in classes}
    rows = rows.withColumns(over | {"first": F.lag("pos").over(w).isNull()})
    now, was = state({c: F.col(f"n_{c}") for c in classes}), state({c: F.col(f"n_{c}") - F.col(f"d_{c}") for c in classes})
    rows = rows.select("chrom", "_stretch", "pos", "after", "first", now.alias("class"), now.eqNullSafe(was).alias("same")).filter("first or not same")
    follows = F.lead("pos").over(w)
    rows = rows.select("class", "chrom", F.col("pos").alias("start"), F.coalesce(follows, "after").alias("end"), (F.col("same") | follows.isNull()).alias("seam"))
    rows = stored(rows.filter("class is not null and end is not null"), "runs")
    return rows.filter("not seam").drop("seam").unionByName(merge_intervals(rows.filter("seam").drop("seam"), ["class", "chrom"], width))


def subtract_intervals(base: DataFrame, minus: DataFrame, width: int = WIDTH) -> DataFrame:
    """The parts of ``base`` that no interval of ``minus`` covers, merged."""
    both = base.select("chrom", "start", "end", F.lit("base").alias("class")).unionByName(minus.select("chrom", "start", "end", F.lit("minus").alias("class")))
    return state_runs(both, ["base", "minus"], lambda n: F.when((n["base"] > 0) & (n["minus"] == 0), "base"), width).drop("class")


def exclusive_partitions(iv: DataFrame, classes: list[str], width: int = WIDTH) -> DataFrame:
    """Per class, the parts that no other class covers: class, chrom, start, end."""
    alone = lambda n, c: (n[c] > 0) & (sum((n[o] for o in classes if o != c), F.lit(0)) == 0)
    return state_runs(iv, classes, lambda n: F.coalesce(*[F.when(alone(n, c), c) for c in classes]), width)


def clip(iv: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """Intersection with [low, high); empty ones go."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return iv.withColumns({"start": F.greatest("start", low), "end": F.least("end", high)}).filter("end > start")


def endpoints(iv: DataFrame) -> DataFrame:
    """Each interval as its first and its last position, one base each."""
    two = F.array(F.struct(F.col("start"), (F.col("start") + 1).alias("end")), F.struct((F.col("end") - 1).alias("start"), F.col("end")))
    rest = [c for c in iv.columns if c not in ("start", "end")]
    return iv.select(*rest, F.explode(two).alias("e")).select(*rest, F.col("e.start").alias("start"), F.col("e.end").alias("end"))


def rebuild_intervals(points: DataFrame) -> DataFrame:
    """Intervals from endpoint pairs: ids seen exactly twice, both times on one chromosome; the sample is kept."""
    g = points.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("chrom").alias("k"), F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("sample").alias("sample"))
    return g.filter("n = 2 and k = 1").select("chrom", "start", "end", "sample", "id")


def point_in_window(points: DataFrame, windows: DataFrame, pos: str = "mid", bucket: int = BUCKET) -> DataFrame:
    """Pairs with w_start <= pos < w_end on one chrom. A window goes to each bucket that it covers."""
    p = points.withColumn("_bucket", F.floor(F.col(pos) / F.lit(bucket)))
    first, last = F.floor(F.col("w_start") / F.lit(bucket)), F.floor((F.col("w_end") - 1) / F.lit(bucket))
    w = windows.filter("w_end > w_start").withColumn("_bucket", F.explode(F.sequence(first, last)))
    return w.join(p, ["chrom", "_bucket"]).filter((F.col(pos) >= F.col("w_start")) & (F.col(pos) < F.col("w_end"))).drop("_bucket")


def overlapping(intervals: DataFrame, windows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of [start, end) and [w_start, w_end) that overlap on one chrom, with ``overlap``; each pair once.

    Both go to each bucket they cover; a pair counts in the first bucket that both cover.
    """
    at = lambda x: F.floor(x / F.lit(bucket))
    i = intervals.filter("end > start").withColumns({"_i": at(F.col("start")), "_bucket": F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1)))})
    w = windows.filter("w_end > w_start").withColumns({"_w": at(F.col("w_start")), "_bucket": F.explode(F.sequence(at(F.col("w_start")), at(F.col("w_end") - 1)))})
    pairs = w.join(i, ["chrom", "_bucket"]).filter((F.col("start") < F.col("w_end")) & (F.col("end") > F.col("w_start")) & (F.col("_bucket") == F.greatest("_i", "_w")))
    return pairs.withColumn("overlap", F.least("end", "w_end") - F.greatest("start", "w_start")).drop("_bucket", "_i", "_w")
