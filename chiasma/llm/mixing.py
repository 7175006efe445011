"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sources in code point order (null last) get weights 3, 1, 2, repeating, and share ``share`` times all sizes; a
target stops at ``cap`` times its source's size and the excess is reshared by weight, which is one water level
found by running sums over the sources. A document of a source is to be taken target / size times: its whole
part always, its fraction by rounding. Rounding is pivotal: two documents exchange words (fraction times size)
in a random direction until one fraction is 0 or 1, so a source's taken words stay as they were, and the chance
of each document too. A block of about ``BLOCK`` documents of one source is settled in one row; the document
left in each block goes to the next level of a reduction tree of ``BLOCK`` blocks a node. Long documents come first
in a block, so that mostly a short one is left. At the root one document a source is rounded to the nearer side:
taken words differ from the target by half its size at most.

The chance is a hash of the ids and the level, so reruns agree whatever the partitioning. Defined results: a
null or empty text has size 0 and takes nothing; repeated rows are numbered and decided one by one; null source
is a source; a source of size 0 has target 0; an empty table gives no rows; other columns are kept by ``mix``
whatever their names (its own are prefixed by ``_mix``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Documents that a block holds on average, and blocks to a node of the tree.
BLOCK = 64
#: Sources up to which their table is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: A fraction this near to 0 or 1 is whole.
EPS = 1e-12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target. ``sizes``: source, size of each document. One row per source is ordered."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap))
    # water level: sources in the order in which they would be full
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("all_size", F.sum("source_size").over(every) * F.lit(share))
    level = (F.col("all_size") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the first source whose own level does not fill it sets the level of all that follow
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)
    target = F.least(F.col("most"), F.coalesce(settled["level"] * F.col("weight"), F.col("most")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _chance(*what) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _settle(level: int, seed: int) -> Column:
    """Of the sorted array ``units``: struct(rest, done) after all pivotal steps from left to right."""
    kind = "struct<doc_id:bigint,key:bigint,occ:int,size:bigint,base:int,q:double>"
    done = "array<struct<doc_id:bigint,key:bigint,occ:int,size:bigint,copies:int>>"

    def step(state: Column, b: Column) -> Column:
        a = state["rest"]
        own = lambda x, *names: [x[n].alias(n) for n in names]
        unit = lambda x, q: F.struct(*own(x, "doc_id", "key", "occ", "size", "base"), q.alias("q"))
        out = lambda x, up: F.struct(*own(x, "doc_id", "key", "occ", "size"), (x["base"] + F.lit(up)).alias("copies"))
        a_up, a_down = (1 - a["q"]) * a["size"], a["q"] * a["size"]
        b_up, b_down = (1 - b["q"]) * b["size"], b["q"] * b["size"]
        rise, fall = F.least(a_up, b_down), F.least(a_down, b_up)
        u = _chance(F.lit(seed), F.lit(level), a["key"], a["occ"], F.lit("-"), b["key"], b["occ"])
        up = u * (rise + fall) < fall
        pair = lambda rest, one: F.struct(rest.alias("rest"), F.concat(state["done"], F.array(one)).alias("done"))
        return (
            F.when(up & (a_up <= b_down), pair(unit(b, b["q"] - rise / b["size"]), out(a, 1)))
            .when(up, pair(unit(a, a["q"] + rise / a["size"]), out(b, 0)))
            .when(a_down <= b_up, pair(unit(b, b["q"] + fall / b["size"]), out(a, 0)))
            .otherwise(pair(unit(a, a["q"] - fall / a["size"]), out(b, 1)))
        )

    units = F.col("units")
    start = F.struct(F.get(units, F.lit(0)).cast(kind).alias("rest"), F.array().cast(done).alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def numbered(rows: DataFrame) -> DataFrame:
    """``_mix_key`` of (doc_id, source, size, text) and ``_mix_occ``, the number among rows that are equal in them."""
    flags = [F.isnull("doc_id"), F.col("doc_id"), F.isnull("source"), F.col("source"), F.col("_mix_size"), F.col("_mix_tie")]
    same = Window.partitionBy("_mix_key", "doc_id", "source", "_mix_size").orderBy("_mix_tie")
    rows = rows.withColumn("_mix_key", F.xxhash64(*flags)).repartition("_mix_key")
    return rows.withColumn("_mix_occ", F.row_number().over(same))


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 20) -> DataFrame:
    """Per document: doc_id, source, size, key and occ (see ``numbered``), source_size, target, copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_mix_tie"))
    rows = stored(rows, "mix-sizes")
    sources = stored(source_targets(rows, weights, share, cap), "mix-sources")
    n, largest = sources.agg(F.count("*"), F.max("n_docs")).first()
    small = F.broadcast(sources) if n <= BROADCAST_SOURCES else sources
    p = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    base = F.floor(p + F.lit(EPS)).cast("int")
    units = numbered(rows.withColumn("_mix_size", F.col("size"))).withColumnsRenamed({"_mix_key": "key", "_mix_occ": "occ"})
    units = units.join(small.withColumnsRenamed({"source": "_s"}), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_mix_tie", "_mix_size")
    units = units.withColumn("base", base).withColumn("q", p - F.col("base"))
    blocks = F.greatest(F.ceil(F.col("n_docs") / F.lit(BLOCK)), F.lit(1))
    units = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key", "occ"), blocks))
    whole = (F.col("size") == 0) | (F.col("q") < F.lit(EPS))
    facts = ["doc_id", "key", "occ", "source", "size"]
    settled = [units.filter(whole).select(*facts, F.when(F.col("size") == 0, 0).otherwise(F.col("base")).alias("copies"))]

    unit = F.struct("doc_id", "key", "occ", "size", "base", "q")
    ordered = F.struct((-F.col("size")).alias("less"), F.xxhash64(F.lit(seed + 1), "key", "occ").alias("h"), unit.alias("unit"))
    level = units.filter(~whole).select("source", "block", ordered.alias("u"))
    depth = max(1, math.ceil(math.log(max(2, -(-(largest or 1) // BLOCK)), BLOCK))) + 1 if (largest or 0) > BLOCK else 1
    for k in range(depth):
        node = level.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list("u")), lambda x: x["unit"]).alias("units"))
        node = stored(node.select("source", "block", _settle(k, seed).alias("s")), f"mix-level{k}")
        done = node.select("source", F.explode("s.done").alias("d"))
        settled.append(done.select("d.doc_id", "d.key", "d.occ", "source", "d.size", "d.copies"))
        rest = node.select("source", F.expr(f"block div {BLOCK}").alias("block"), "s.rest", F.col("block").alias("h"))
        level = rest.select("source", "block", F.struct((-F.col("rest.size")).alias("less"), "h", F.col("rest").alias("unit")).alias("u"))
    last = rest.select("source", "rest.*")
    settled.append(last.select(*facts, (F.col("base") + (F.col("q") >= 0.5).cast("int")).alias("copies")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.join(small.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as it is taken; documents without words stay once, as they take none.

    The texts are shuffled once: the numbering and the join share one partitioning. Rows that are equal share what
    they take together: of m rows with t copies row r has t * r / m less t * (r - 1) / m, both rounded down.
    """
    taken = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    chosen = decide(docs, **options).groupBy("key", "doc_id", "source", "size").agg(F.sum(taken).alias("_mix_copies"), F.count("*").alias("_mix_rows"))
    chosen = chosen.filter("_mix_copies > 0").withColumnsRenamed({"key": "_mix_key", "doc_id": "_mix_id", "source": "_mix_source", "size": "_mix_of"})
    rows = docs.withColumns({"_mix_size": word_count(F.col("text")), "_mix_tie": F.xxhash64("text"), "doc_id": F.col("doc_id").cast("long")})
    rows = numbered(rows)
    same = (F.col("_mix_id").eqNullSafe(F.col("doc_id"))) & (F.col("_mix_source").eqNullSafe(F.col("source")))
    # one row a key: the other equalities stay conditions, not join keys, so that the partitioning by _mix_key serves the join
    near = F.abs(F.col("_mix_of") - F.col("_mix_size")) < 1
    rows = rows.alias("l").join(chosen.alias("r"), F.col("l._mix_key") == F.col("r._mix_key")).filter(near & same)
    share = F.expr("_mix_copies * _mix_occ div _mix_rows - _mix_copies * (_mix_occ - 1) div _mix_rows").cast("int")
    rows = rows.withColumn("_mix_share", share).filter("_mix_share > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_share")))
    return rows.select(*[F.col(f"l.`{c}`") for c in docs.columns])


def digest(decided: DataFrame) -> DataFrame:
    return decided.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
