"""Comparison regions drawn by counter-based hashes: the same index gives the same region in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SimulationParams
from ..sources.shared import stored
from .intervals import exclusive_partitions
from .ordered import WIDTH, stretched, within


def draw(index: Column, kind: Column, n: int, total: Column, seed: int = 25) -> Column:
    """A whole number below ``total`` from md5(index | kind | n | seed): seven hex digits twice, as 56 bits."""
    h = F.md5(F.concat_ws("|", index.cast("string"), kind, F.lit(str(n)), F.lit(str(seed))).cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 14), 16, 10).cast("bigint"), total)


def gene_classes(genes: DataFrame, lengths: DataFrame, flank: int = 5_000) -> DataFrame:
    """five_prime, three_prime and body spans: chrom, start, end, class. Any strand but + is minus."""
    g = genes.join(lengths.select("chrom", "length"), "chrom")
    before = F.struct(F.greatest(F.col("start") - flank, F.lit(0)).alias("start"), F.least("start", "length").alias("end"))
    behind = F.struct(F.greatest(F.col("end"), F.lit(0)).alias("start"), F.least(F.col("end") + flank, F.col("length")).alias("end"))
    plus = F.col("strand") == "+"
    span = lambda s, name: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("class"))
    five, three = F.when(plus, before).otherwise(behind), F.when(plus, behind).otherwise(before)
    core = F.struct((F.col("start") + flank).alias("start"), (F.col("end") - flank).alias("end"))
    rows = g.select("chrom", F.explode(F.array(span(five, "five_prime"), span(three, "three_prime"), span(core, "body"))).alias("s"))
    return rows.select("chrom", "s.start", "s.end", "s.class").filter("end > start")


def gene_partitions(genes: DataFrame, lengths: DataFrame, flank: int = 5_000) -> DataFrame:
    """The parts of each class that belong to no other one: class, chrom, start, end."""
    return exclusive_partitions(gene_classes(genes, lengths, flank), ["five_prime", "three_prime", "body"])


def cumulative(intervals: DataFrame, keys: list[str], weight: str, width: int = WIDTH) -> DataFrame:
    """lo and hi of each row's share of the running total of ``weight`` along ``keys``, by chromosome, start and end.

    Running sums are windows within stretches of ``width`` positions; the sums of the stretches and of the chromosomes
    before are carried in.
    """
    rows = stretched(intervals, [*keys, "chrom"], F.col("start"), {"_in": ("sum", F.col(weight))}, width)
    upto = within([*keys, "chrom"], "start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.col("_in") + F.sum(weight).over(upto)).drop("_stretch")
    per = intervals.groupBy(*keys, "chrom").agg(F.sum(weight).alias("_w"))
    along = Window.partitionBy(*keys).orderBy("chrom")
    per = per.withColumn("_before", F.coalesce(F.sum("_w").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_w")
    rows = rows.join(per, [*keys, "chrom"])
    return rows.withColumns({"hi": F.col("_before") + F.col("_in"), "lo": F.col("_before") + F.col("_in") - F.col(weight)}).drop("_in", "_before")


def look_up(picks: DataFrame, table: DataFrame, keys: list[str] = (), pick: str = "pick") -> DataFrame:
    """The row of the cumulative table with lo <= pick < hi along ``keys``, by equi-join on a bucket of the running total.

    Both sides have ``_total`` and ``_rows``, the end of the key's running total and its number of rows: there are as
    many buckets as rows.
    """
    at = lambda x: F.expr(f"{x} div (_total div greatest(_rows, 1L) + 1)")
    rows = table.filter("hi > lo").withColumn("_bucket", F.explode(F.sequence(at("lo"), at("(hi - 1)")))).drop("_total", "_rows")
    p = picks.withColumn("_bucket", at(pick))
    return p.join(rows, [*keys, "_bucket"]).filter((F.col(pick) >= F.col("lo")) & (F.col(pick) < F.col("hi"))).drop("_bucket", "_total", "_rows")


def _totals(table: DataFrame, key: str) -> list[tuple[str, int, int]]:
    """Per value of ``key`` (few: the classes of an annotation) the end of the running total and the number of rows."""
    rows = table.groupBy(key).agg(F.max("hi").alias("hi"), F.count("*").alias("n")).filter("hi > 0").collect()
    return sorted((r[0], r["hi"], r["n"]) for r in rows)


def length_distribution(intervals: DataFrame, width: int = WIDTH) -> DataFrame:
    """Empirical lengths with their share of the running count: length, lo, hi. One row per distinct length."""
    g = intervals.filter("end > start").groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n"))
    rows = stretched(g, [], F.col("length"), {"_before": ("sum", F.col("n"))}, width)
    hi = F.col("_before") + F.sum("n").over(within([], "length"))
    return rows.select("length", (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def drawn_lengths(lengths: DataFrame, n: int, seed: int = 25) -> DataFrame:
    """idx 1..n with a length from the distribution; all region sets share it. No lengths give no rows."""
    total, rows = lengths.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count("*")).first()
    totals = {"_total": F.lit(total).cast("bigint"), "_rows": F.lit(rows).cast("bigint")}
    idx = lengths.sparkSession.range(1, n + 1 if total else 1).withColumnRenamed("id", "idx").withColumns(totals)
    picks = idx.withColumn("pick", draw(F.col("idx"), F.lit("length"), 0, F.greatest("_total", F.lit(1)), seed))
    return look_up(picks, lengths.withColumns(totals)).select("idx", "length")


def uniform_regions(drawn: DataFrame, chroms: DataFrame, seed: int = 25) -> DataFrame:
    """A region of each drawn length anywhere: a chromosome by its number of valid starts, then a start.

    ``chroms``: chrom, length, one row a chromosome (ten, as ``read_lengths`` gives them); they become one array that
    each draw walks along.
    """
    known = sorted((r["chrom"], r["length"]) for r in chroms.select("chrom", "length").collect())
    names, sizes = F.array(*[F.lit(c) for c, _ in known]), F.array(*[F.lit(n).cast("bigint") for _, n in known])
    rows = drawn.withColumn("room", F.transform(sizes, lambda n: F.greatest(n - F.col("length") + 1, F.lit(0).cast("bigint"))))
    rows = rows.withColumn("total", F.aggregate("room", F.lit(0).cast("bigint"), lambda a, x: a + x)).filter("total > 0")
    rows = rows.withColumn("pick", draw(F.col("idx"), F.lit("uniform"), 1, F.col("total"), seed))
    state = lambda left, at, i: F.struct(left.alias("left"), at.alias("at"), i.alias("i"))
    step = lambda a, x: F.when(a["at"] >= 0, a).when(a["left"] < x, state(a["left"], a["i"], a["i"] + 1)).otherwise(state(a["left"] - x, a["at"], a["i"] + 1))
    rows = rows.withColumn("w", F.aggregate("room", state(F.col("pick"), F.lit(-1), F.lit(0)), step))
    return rows.select("idx", F.get(names, F.col("w.at")).alias("chrom"), F.col("w.left").alias("start"), (F.col("w.left") + F.col("length")).alias("end"))


def points(idx: DataFrame, annotation: DataFrame, seed: int = 25, width: int = WIDTH) -> DataFrame:
    """For each idx a point of each class of the annotation, every base of it alike: idx columns, class, chrom, point.

    ``annotation``: class, chrom, start, end. All classes are one table and one look-up. A class without bases has no rows.
    """
    annotation = stored(annotation.select("class", "chrom", "start", "end"), "annotation")  # read for sums and for rows
    table = cumulative(annotation.withColumn("span", F.col("end") - F.col("start")), ["class"], "span", width)
    table = stored(table.select("class", "chrom", "start", "lo", "hi"), "cumulative")  # read for its totals and for the look-up
    kinds = "class string, _total bigint, _rows bigint"
    found = _totals(table, "class")
    known = F.array(*[F.struct(*map(F.lit, k)) for k in found]).cast(f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")
    picks = idx.select(*idx.columns, F.inline(known))
    picks = picks.withColumn("pick", draw(F.col("idx"), F.col("class"), 1, F.col("_total"), seed))
    table = table.join(F.broadcast(idx.sparkSession.createDataFrame(found, kinds)), "class")  # one row a class
    return look_up(picks, table, ["class"]).select(*idx.columns, "class", "chrom", (F.col("start") + F.col("pick") - F.col("lo")).alias("point"))


def enriched_regions(drawn: DataFrame, annotation: DataFrame, chroms: DataFrame, seed: int = 25) -> DataFrame:
    """For each class of the annotation a region of each drawn length over a point of it, kept on its chromosome."""
    rows = points(drawn, annotation, seed).join(chroms.select("chrom", F.col("length").alias("size")), "chrom")
    start = F.col("point") - draw(F.col("idx"), F.col("class"), 2, F.col("length"), seed)
    start = F.greatest(F.least(F.greatest(start, F.lit(0)), F.col("size") - F.col("length")), F.lit(0))
    rows = rows.withColumn("start", start)
    return rows.select("idx", "class", "chrom", "start", F.least(F.col("start") + F.col("length"), F.col("size")).alias("end"))


def simulate(genes: DataFrame, chroms: DataFrame, intervals: DataFrame, p: SimulationParams = SimulationParams()) -> DataFrame:
    """The four sets: set, chrom, start, end, ident. At one index all share a length."""
    drawn = stored(drawn_lengths(stored(length_distribution(intervals), "lengths"), p.regions, p.seed), "drawn")
    parts = gene_partitions(genes, chroms, p.flank)
    over = enriched_regions(drawn, parts, chroms, p.seed).withColumnRenamed("class", "set")
    out = uniform_regions(drawn, chroms, p.seed).withColumn("set", F.lit("uniform")).unionByName(over)
    return out.select("set", "chrom", "start", "end", F.format_string("%s_%06d", "set", "idx").alias("ident"))
