"""Running values along a coordinate, without one task per chromosome.

Rows are grouped into stretches of ``WIDTH`` positions. A small table, one row per (key, stretch), carries what came
before into each stretch; the rest is a window within the stretch. The join with that table and the window share
one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 23


def stretched(df: DataFrame, keys: list[str], pos: Column, carry: dict[str, tuple[str, Column]], width: int = WIDTH) -> DataFrame:
    """``df`` with ``_stretch`` and, per entry of ``carry``, a value over all other stretches of the key.

    Kinds: ``max`` and ``sum`` over the stretches before, ``next`` the smallest value of the next stretch that has
    one, ``all`` the largest value of the key; ``last`` and ``first`` of neighbours are had from structs with ``max``
    and ``next``.
    """
    df = placed(df, keys, pos, width)
    return df.join(carried(df, keys, carry), "_stretch")


def placed(df: DataFrame, keys: list[str], pos: Column, width: int = WIDTH) -> DataFrame:
    """``df`` with ``_stretch``, null where ``pos`` is.

    It is a struct with the keys, null ones too: join and window then need one partitioning by this column alone.
    """
    number = F.floor(pos / F.lit(width))
    return df.withColumn("_stretch", F.when(number.isNotNull(), F.struct(number.alias("n"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])))


def carried(df: DataFrame, keys: list[str], carry: dict[str, tuple[str, Column]]) -> DataFrame:
    """``_stretch`` and the values of ``carry``, one row a stretch of placed rows (see ``stretched``)."""
    parts = []
    for name, (kind, value) in carry.items():
        agg = {"max": F.max, "sum": F.sum, "next": F.min, "all": F.max}[kind]
        parts.append(agg(value).alias(name))
    small = df.groupBy(*keys, "_stretch").agg(*parts)
    order = Window.partitionBy(*keys).orderBy("_stretch")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy(*keys)
    for name, (kind, _) in carry.items():
        value = {"max": lambda n: F.max(n).over(before), "sum": lambda n: F.coalesce(F.sum(n).over(before), F.lit(0)), "next": lambda n: F.min(n).over(after), "all": lambda n: F.max(n).over(every)}[kind](name)
        small = small.withColumn(f"_{name}", value)
    return small.select("_stretch", *[F.col(f"_{n}").alias(n) for n in carry])


def within(keys: list[str], *order) -> Window:
    """The window of a stretch."""
    return Window.partitionBy(*keys, "_stretch").orderBy(*order)


def numbered(df: DataFrame, keys: list[str], pos: str, order: list[str], width: int = WIDTH) -> DataFrame:
    """``df`` with ``_number`` from 0 along each key."""
    rows = stretched(df, keys, F.col(pos), {"_before": ("sum", F.lit(1))}, width)
    return rows.withColumn("_number", F.col("_before") + F.row_number().over(within(keys, *order)) - 1).drop("_before", "_stretch")


def haloed(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """Numbered rows in blocks (``_block``) of ``size``, with copies (not ``_own``) of ``halo`` rows of each neighbour.

    Every block but a key's last has ``size`` rows, so a halo is short only at the ends of a key.
    """
    block, place = F.expr(f"_number div {size}"), F.col("_number") % size
    at = lambda b, own: F.struct(b.alias("_block"), F.lit(own).alias("_own"))
    places = F.array_compact(F.array(at(block, True), F.when((place < halo) & (block > 0), at(block - 1, False)), F.when(place >= size - halo, at(block + 1, False))))
    return rows.withColumn("_at", F.explode(places)).withColumns({"_block": F.col("_at._block"), "_own": F.col("_at._own")}).drop("_at")
