"""Shards by a Feistel permutation of global row numbers, in DataFrame operations only.

Rows are numbered from 0 in the order of ``doc_id`` (null first) and a hash of the row: they are dealt to ranges by that
order, a counter of the row within its input part among the last keys, so that any number of equal rows is split too;
each range is sorted and written, and one small table, a row per range, says how many rows lie before it. The number of
a row is then the count before its range plus its place in it.

The permutation acts on [0, n). With a about the root of n and b the least with a * b >= n, a number is a pair
(l, r) = (x div b, x mod b); rounds add a hash of one half to the other, modulo a and b in turn, which is one to one on
[0, a * b). Less than a numbers lie beyond n: a number that lands there walks the cycle on until it lands below n, at
most a steps, nearly always none. Shard and slot are the permuted number modulo and over the number of shards, so shards
differ by one row at most and slots have no gaps; both can be computed from the number alone, and back (``number_of``).
The round hash is a piece of md5, so that any engine can follow it.

The permutation depends on n, the seed and the row's number: a rerun over the same rows gives the same shards, whatever
the partitioning. Defined results: a null text counts as empty; null ids come first; rows that are equal in all columns
are told apart by the counter alone, which no result shows; a very long text is hashed where it is read and not moved by
the query (``assign`` moves the columns it is given); an empty table gives no rows; other columns may have any name but
those that ``assign`` adds, which take their place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh_folder, shuffle_partitions

SHARDS = 40
ROUNDS = 6
SEED = 12
#: Rows to a range on average, and to a file of ``write_shards``.
RANGE_ROWS = 1_000_000


def _hashed(seed: int, k: Column, x: Column) -> Column:
    """A number below 2^48."""
    text = F.concat_ws(":", F.lit(str(seed)), k.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def _round(seed: int, a: Column, b: Column, sign: int):
    """One round on a struct (l, r); even rounds change l, odd ones r. ``sign`` -1 takes it back."""

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.lit(sign) * _hashed(seed, k, s["r"]) % a, a)
        right = F.pmod(s["r"] + F.lit(sign) * _hashed(seed, k, s["l"]) % b, b)
        even = k % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    return step


def sides(n: Column) -> tuple[Column, Column]:
    """a and b: a * b >= n, and less than a too many."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return a, F.greatest(F.call_function("div", n + a - 1, a), F.lit(1).cast("long"))


def _once(x: Column, a: Column, b: Column, seed: int, back: bool) -> Column:
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    start = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.array(*map(F.lit, order)), start, _round(seed, a, b, -1 if back else 1), lambda s: s["l"] * b + s["r"])


def permuted(rows: DataFrame, x: str, n: str, out: str, seed: int = SEED, back: bool = False) -> DataFrame:
    """``rows`` with ``out``: the image of ``x`` in [0, ``n``), or with ``back`` what it is the image of."""
    a, b = sides(F.col(n))
    first = rows.withColumn(out, _once(F.col(x), a, b, seed, back))
    # as many steps as there are numbers beyond n, for the rows that need any
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(a * b - F.col(n), F.lit(1)))
    walk = F.aggregate(steps, F.col(out), lambda y, _: F.when(y < F.col(n), y).otherwise(_once(y, a, b, seed, back)))
    return first.withColumn(out, F.when(F.col(out) < F.col(n), F.col(out)).otherwise(walk))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``row_number`` from 0 in the order given and ``n_rows``; written once in the shared folder."""
    spark = rows.sparkSession
    parts = max(shuffle_partitions(spark), math.ceil(rows.count() / RANGE_ROWS))
    keys = [f"_key{i}" for i in range(len(order))]
    taken = [c for c in rows.columns if c not in ("row_number", "n_rows")]
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_row"), *[c.alias(k) for c, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("_input"))
    own = own.repartitionByRange(parts, *keys, "_input").sortWithinPartitions(*keys, "_input")
    low = F.monotonically_increasing_id()
    path = f"{fresh_folder(spark, 'numbered')}/table"
    own.select("_row", F.shiftright(low, 33).alias("_part"), low.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")).write.parquet(path)
    own = spark.read.parquet(path)
    # a row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    own = own.join(F.broadcast(sizes), F.col("_part") == F.col("_p"))
    return own.select("_row.*", (F.col("_before") + F.col("_place")).alias("row_number"), "n_rows")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``row_number``, ``n_rows``, ``shard`` and ``slot``."""
    order = [F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in sorted(docs.columns)])]
    rows = permuted(numbered(docs, order), "row_number", "n_rows", "_image", seed)
    shard, slot = (F.col("_image") % shards).cast("int"), F.call_function("div", F.col("_image"), F.lit(shards).cast("long"))
    return rows.withColumns({"shard": shard, "slot": slot}).drop("_image")


def number_of(places: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``places`` (shard, slot, n_rows) with ``row_number``: which row lies there, without reading the rows."""
    rows = places.withColumn("_image", F.col("slot").cast("long") * shards + F.col("shard"))
    return permuted(rows, "_image", "n_rows", "row_number", seed, back=True).drop("_image")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Parquet folders ``shard=K``, each file a stretch of slots in order; a large shard is many files."""
    rows = assign(docs, shards, seed).withColumn("stretch", F.call_function("div", F.col("slot"), F.lit(RANGE_ROWS).cast("long")))
    rows.repartition("shard", "stretch").sortWithinPartitions("shard", "slot").drop("stretch").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number. Only these columns are moved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = assign(rows, shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


#: Unsigned CRC-32 of the bytes of ``text`` as a fold over a table that its rule builds, then the rounds and the walk as a recursion.
ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 16 AS size,
    row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number, count(*) OVER () AS n FROM documents
), sized AS (
  SELECT doc_id, row_number, size, n, greatest(ceil(sqrt(n))::BIGINT, 1) AS a,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc_table
), s AS (
  SELECT doc_id, row_number, size, text_crc32, n, a, (n + a - 1) // a AS b, row_number // ((n + a - 1) // a) AS l, row_number % ((n + a - 1) // a) AS r, 0 AS k FROM sized
  UNION ALL
  SELECT doc_id, row_number, size, text_crc32, n, a, b,
    CASE WHEN k % 2 = 0 THEN (l + ('0x' || substr(md5('{SEED}:' || (k % {ROUNDS}) || ':' || r), 1, 12))::BIGINT % a) % a ELSE l END,
    CASE WHEN k % 2 = 1 THEN (r + ('0x' || substr(md5('{SEED}:' || (k % {ROUNDS}) || ':' || l), 1, 12))::BIGINT % b) % b ELSE r END, k + 1
  FROM s WHERE k = 0 OR k % {ROUNDS} <> 0 OR l * b + r >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((l * b + r) % {SHARDS})::INTEGER AS shard, (l * b + r) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard, row_number
FROM s WHERE k > 0 AND k % {ROUNDS} = 0 AND l * b + r < n
"""
