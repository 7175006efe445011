"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to the cells of a grid: a query to one of the query blocks, which hold about
``QUERY_BYTES`` each, a candidate to one of ``salts`` groups, and every pair of a block and a group is a cell. In a cell
the block comes first, then its candidates pass by, some hundred at a time. Each such tile is a product of matrices of
the unit vectors rounded to int8, which gives every cosine with a proven error (from the rounding residues of both
vectors). Only pairs whose upper bound reaches the k-th lower bound are computed again, in double precision on the
original vectors; each task keeps a heap of k per query over all its tiles, and the heaps of all tasks are merged. The
result is exact, and equal vectors, however many, keep k in a heap.

The query set is stated (ids divisible by ``every``). A candidate is sent once for each query block, a query once for
each group: candidates stay where they are few blocks, and blocks grow before there are more of them. Defined
results: vectors that are null, zero, or hold null or non-finite components take no part, as do null ids; vectors
meet those of their own length only; rows that repeat an id are candidates each, the smallest of their vectors asks, and an id never meets itself;
ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shuffle_partitions, small_batches

#: Bytes of a query block's vectors, and queries to a tile.
QUERY_BYTES, QUERIES = 16 << 20, 1024
#: Pairs computed again at once.
PAIRS = 200_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


class Block:
    """Vectors with their int8 form, its scale and the length of what rounding left."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.norm = np.sqrt((v * v).sum(axis=1))
        odd = (self.norm == 0) | ~np.isfinite(self.norm)
        if odd.any():  # squares that under- or overflow
            top = np.abs(v[odd]).max(axis=1, keepdims=True)
            self.v = v = v.copy()
            v[odd] /= top
            self.norm[odd] = np.sqrt((v[odd] * v[odd]).sum(axis=1))
        unit = v / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.left = np.sqrt(((unit - self.q * self.scale[:, None]) ** 2).sum(axis=1))

    def parts(self, n: int) -> Iterator[Block]:
        """The block cut to ``n`` vectors each."""
        for at in range(0, len(self.ids), n):
            own = Block.__new__(Block)
            for name, x in vars(self).items():
                setattr(own, name, x[at : at + n])
            yield own


def tile(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all pairs from int8 products, and what they are off by at most."""
    exact = np.float32 if a.q.shape[1] <= 1000 else np.float64  # sums of int8 products are whole numbers below 2**24
    near = (a.q.astype(exact) @ b.q.astype(exact).T).astype(np.float64)
    near *= a.scale[:, None] * b.scale[None, :]
    return near, a.left[:, None] + (1 + a.left)[:, None] * b.left[None, :] + 1e-9


def search(queries: Block, candidates: Block, heaps: dict[int, list], k: int) -> None:
    """Push the tile's nearest into the heaps of (score, -id), which hold k at most."""
    near, off = tile(queries, candidates)
    own = queries.ids[:, None] == candidates.ids[None, :]
    near[own] = -np.inf
    low = near - off
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
    held = np.array([h[0][0] if len(h := heaps.setdefault(i, [])) == k else -np.inf for i in queries.ids.tolist()])
    rows, cols = np.nonzero((near + off >= np.maximum(kth, held - 1e-9)[:, None]) & ~own)
    for at in range(0, len(rows), PAIRS):
        r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
        score = (queries.v[r] * candidates.v[c]).sum(axis=1) / (queries.norm[r] * candidates.norm[c])
        # of equal scores the smallest ids matter: k of each query's best in this run suffice
        order = np.lexsort((candidates.ids[c], -score, r))
        first = np.searchsorted(r[order], np.arange(len(queries.ids)))
        place = np.arange(len(order)) - first[r[order]]
        for i in order[place < k].tolist():
            heap = heaps[int(queries.ids[r[i]])]
            item = (float(score[i]), -int(candidates.ids[c[i]]))
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)


def _block(batch: pa.RecordBatch) -> Block:
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return Block(ids, np.asarray(v, "<f8").reshape(len(ids), -1))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by cosine."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    size = queries.agg(F.sum(8 * F.col("dim").cast("long"))).first()[0] or 0
    blocks, salts = -(-size // QUERY_BYTES) or 1, max(8, shuffle_partitions(spark))
    deal = lambda n, *what: F.pmod(F.xxhash64(*what), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = ["dim", "block", "salt"]
    q = queries.withColumn("block", deal(blocks, "vec_id")).withColumn("salt", spread(salts))
    c = rows.withColumn("salt", deal(salts, "vec_id", "v")).withColumn("block", spread(blocks))
    shape = lambda t, kind: t.select(*cells, F.lit(kind).alias("kind"), "vec_id", "v")
    tiles = shape(q, 0).unionByName(shape(c, 1)).repartition(*cells).sortWithinPartitions(*cells, "kind")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        cell, asking, ready = None, [], []
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)) for i in range(4)])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b == a:
                    continue
                *where, kind = key[:, a].tolist()
                if where != cell:
                    cell, asking, ready = where, [], []
                own = batch.slice(a, b - a)
                if kind == 0:
                    asking.append(_block(own))
                    continue
                if asking:
                    whole = Block(np.concatenate([x.ids for x in asking]), np.concatenate([x.v for x in asking]))
                    asking, ready = [], list(whole.parts(QUERIES))
                if ready:
                    candidates = _block(own)
                    for part in ready:
                        search(part, candidates, heaps, k)
        yield from _heap_rows(heaps)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                heap = heaps.setdefault(query, [])
                item = (score, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        yield from _heap_rows(heaps)

    part = tiles.mapInArrow(multiply, "query_id long, vec_id long, score double, rank int")
    found = part.select("query_id", "vec_id", "score").repartition("query_id").mapInArrow(merge, "query_id long, vec_id long, score double, rank int")
    return found.select("query_id", "rank", "vec_id", "score")


def _heap_rows(heaps: dict[int, list]) -> Iterator[pa.RecordBatch]:
    out = [(q, -i, s, rank) for q, h in heaps.items() for rank, (s, i) in enumerate(sorted(h, reverse=True), 1)]
    for at in range(0, len(out), 10_000):
        columns = list(zip(*out[at : at + 10_000], strict=True))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["query_id", "vec_id", "score", "rank"])
