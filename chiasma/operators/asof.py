"""As-of joins: the last event at or before a position, and the blocks that hold it.

Points and events are one sorted table, cut in stretches (``ordered``); the last event of earlier stretches is carried in
by a row a stretch, so points are shuffled once and no event is copied to the places it reaches.

Blocks that overlap form islands, which do not. A point finds its island as of its position; where the island is one
block, that is the answer. In the others a block lies in at most two cells of its own level (cells of 2^level positions,
the least that hold it), and a point in one cell of each level that its island has, so an equi-join on level and cell
lists few pairs beyond those that match, however long a block is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordered import WIDTH, stretched, within


def latest(points: DataFrame, events: DataFrame, keys: list[str], pos: str, width: int = WIDTH) -> DataFrame:
    """``point`` (a struct of the columns of ``points``) and ``event``: of the last event of the key at or before ``pos``, or null.

    ``events``: keys, ``at`` (one event a position) and ``event``, a struct.
    """
    kind = events.schema["event"].dataType
    rows = points.select(*keys, F.col(pos).alias("_pos"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point"), F.lit(None).cast(kind).alias("_event"))
    rows = events.select(*keys, F.col("at").alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_point"].dataType).alias("_point"), F.col("event").alias("_event")).unionByName(rows)
    known = F.when(F.col("_kind") == 0, F.struct("_pos", "_event"))
    rows = stretched(rows, keys, F.col("_pos"), {"_carried": ("max", known)}, width)
    here = F.last("_event", ignorenulls=True).over(within(keys, "_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("event", F.coalesce(here, F.col("_carried._event"))).filter("_kind = 1").select(F.col("_point").alias("point"), "event")


def islands(blocks: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``blocks`` with ``_island``, a number along the key: blocks of one island overlap, directly or through others."""
    rows = stretched(blocks.filter("w_end > w_start"), keys, F.col("w_start"), {"_reached": ("max", F.col("w_end"))}, width)
    w = within(keys, "w_start", "w_end")
    prior = F.greatest(F.col("_reached"), F.max("w_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = stored(rows.withColumn("_opens", F.when(prior.isNull() | (F.col("w_start") >= prior), 1).otherwise(0)).drop("_reached", "_stretch"), "islands")
    rows = stretched(rows, keys, F.col("w_start"), {"_before": ("sum", F.col("_opens"))}, width)
    number = F.col("_before") + F.sum("_opens").over(within(keys, "w_start", "w_end", F.col("_opens").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_island", number).drop("_opens", "_before", "_stretch")


def blocks_at(points: DataFrame, blocks: DataFrame, pos: str, keys: list[str] = ["chrom"], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """``point`` and ``block``, structs of all columns of ``points`` and ``blocks``, for each block with w_start <= ``pos`` < w_end."""
    whole = F.struct(*[F.col(f"`{c}`") for c in blocks.columns]).alias("block")
    # the least level whose cells are as long as the block
    rows = blocks.select(*keys, "w_start", "w_end", whole).withColumn("level", F.length(F.bin(F.col("w_end") - F.col("w_start") - 1)))
    rows = stored(islands(rows, keys, width), "blocks")
    event = F.struct(F.max("w_end").alias("until"), F.count("*").alias("n"), F.min("block").alias("block"), F.sort_array(F.collect_set("level")).alias("levels"), F.col("_island").alias("island"))
    found = rows.groupBy(*keys, "_island").agg(F.min("w_start").alias("at"), event.alias("event"))
    at = F.col(f"point.`{pos}`")
    met = latest(points, found.select(*keys, "at", "event"), keys, pos, width).filter(at < F.col("event.until"))
    alone = met.filter("event.n = 1").select("point", "event.block")
    many = met.filter("event.n > 1").select("point", *[F.col(f"point.`{k}`") for k in keys], at.alias("_pos"), F.col("event.island").alias("_island"), F.explode("event.levels").alias("level"))
    many = many.withColumn("_cell", F.expr("shiftright(_pos, level)"))
    cells = rows.select(*keys, "_island", "w_start", "w_end", "block", "level", F.explode(F.expr("sequence(shiftright(w_start, level), shiftright(w_end - 1, level))")).alias("_cell"))
    pairs = many.join(cells, [*keys, "_island", "level", "_cell"]).filter("w_start <= _pos and _pos < w_end")
    return alone.unionByName(pairs.select("point", "block"))
