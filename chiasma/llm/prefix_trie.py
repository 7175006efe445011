"""The trie of conversation prefixes, by an external mergesort that carries LCPs, and an open-path stack.

A turn is a record of fixed width (16 bytes of its hash, 8 of its length), a conversation the bytes of its records, so
bytes compare as turns do and a common prefix of records is one of turns (LCP below). Equal conversations become one
row first: their ids are streamed in order through SHA-256, the rest of the work sees each sequence once.

- Runs: each task sorts what it reads in runs of ``RUN_ROWS``, cuts them at the bounds of the ranges (quantiles of a
  sample of bounded size) and writes them in blocks, a path as its LCP with the one before and the rest.
- Merge: Spark deals the blocks to ranges and sorts them by the last path of the block before in their run. That is the
  order in which a merge of the runs asks for them, so one pass over the sorted stream feeds all runs with one block of
  each in memory. A loser tree picks the next path; it compares LCPs with the last path put out, and turns only from
  where these are equal, so shared turns are never compared again.
- Stack: the merged stream's LCPs close the nodes of the open path. A node's row waits for its parent's, whose smallest
  member is its ``parent_conv_id``; at most as many rows wait as the range has sequences.
- Borders: a node lies in several ranges only if its path is a prefix of a bound. Such nodes leave their range as
  partial sums, are summed by key, and their own small tree (at most ``BOUND_TURNS`` nodes a bound) is closed in one task.

Defined results: turns are in order of turn (null first), then role, then the hash of the text; a null role or text is
empty; repeated rows are turns of their own; rows with a null ``conv_id`` belong to no conversation and are left out; an
empty table gives no rows, not even a root; other columns are ignored; a very long text is hashed where it is read; a
conversation is 24 bytes a turn in one row. Sequences that share more than ``BOUND_TURNS`` turns are not split between
ranges and are streamed in one.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shuffle_partitions, small_batches, stored

#: Bytes of a turn's record.
WIDTH = 24
#: Turns of its base that a conversation may begin with at most, less 1; a base every so many ids.
HEADS, BASE = 6, 100
#: Sequences to a run and to a range; sequences and bytes to a block; turns of a bound; sampled sequences to a range.
RUN_ROWS, RANGE_ROWS, BLOCK, BLOCK_BYTES, BOUND_TURNS, SAMPLED = 50_000, 50_000, 64, 1 << 16, 256, 32

EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its own turns as hex records, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    record = F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 16, "0"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), record.alias("record")).alias("t")).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["record"]).alias("own"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ``path`` (the records of the rebuilt conversation) and ``sig``, its hash."""
    rows = stored(conversations(turns), "trie-turns")
    heads = rows.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = rows.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BASE, "h": taken}).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    rows = rows.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))
    return rows.withColumn("sig", F.unhex(F.sha2("path", 256)))


def _ends(batches: Iterable) -> Iterator:
    """Of each signature, in sorted order: its count, its smallest id, and the hash of its ids."""
    import pyarrow as pa

    sig, n, least, state = None, 0, None, None
    for batch in batches:
        out: list[tuple] = []
        sigs, ids = batch.column("sig").to_pylist(), batch.column("conv_id").to_pylist()
        i = 0
        while i < len(ids):
            j = bisect.bisect_right(sigs, sigs[i], i)
            text = ",".join(map(str, ids[i:j])).encode()
            if sigs[i] == sig:
                state.update(b"," + text)
            else:
                if sig is not None:
                    out.append((n, least, state.hexdigest()))
                sig, n, least, state = sigs[i], 0, ids[i], hashlib.sha256(text)
            n, i = n + j - i, j
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["n", "conv_id", "ends"])
    if sig is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([least], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["n", "conv_id", "ends"])


def distinct_paths(rows: DataFrame) -> DataFrame:
    """path, sig, n, conv_id (the smallest) and ends (hash of the ids) of each different sequence."""
    own = rows.select("sig", "conv_id").repartition("sig").sortWithinPartitions("sig", "conv_id").mapInArrow(_ends, "n bigint, conv_id bigint, ends string")
    return own.join(rows, "conv_id").select("path", "sig", "n", "conv_id", "ends")


def bounds_of(paths: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 ascending paths of at most ``BOUND_TURNS`` turns, from the sequences with the least hashes."""
    some = paths.orderBy("sig").limit(SAMPLED * ranges).select(F.substring("path", 1, WIDTH * BOUND_TURNS).alias("p"))
    found = sorted(bytes(r["p"]) for r in some.collect())
    cuts = {found[len(found) * i // ranges] for i in range(1, ranges)} if found else set()
    return sorted(cuts - {b""})


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two paths share from the first on; the first ``start`` are known to be shared."""
    i, end = start * WIDTH, min(len(a), len(b))
    while i < end and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


RUN_SCHEMA = "range int, forecast binary, run string, more boolean, lcp array<int>, rest array<binary>, n array<bigint>, conv_id array<bigint>, ends array<string>"


def blocks_of(run: str, rows: list[tuple], bounds: list[bytes], most: int = BLOCK) -> Iterator[tuple]:
    """Rows of ``RUN_SCHEMA``: the run's rows (path, n, conv_id, ends) in order, cut at the bounds and every ``most``."""
    rows.sort()
    cut = 0
    while cut < len(rows):
        at = bisect.bisect_right(bounds, rows[cut][0])
        end = bisect.bisect_left(rows, (bounds[at],), cut) if at < len(bounds) else len(rows)
        forecast, last, i = None, b"", cut
        while i < end:
            lcp, rest, size, j = [], [], 0, i
            while j < end and j - i < most and size < BLOCK_BYTES:
                path = rows[j][0]
                lcp.append(common(last, path) if j > cut else 0)
                rest.append(path[lcp[-1] * WIDTH :])
                size, last, j = size + len(rest[-1]), path, j + 1
            part = rows[i:j]
            yield (at, forecast, run, j < end, lcp, rest, [x[1] for x in part], [x[2] for x in part], [x[3] for x in part])
            forecast, i = last, j
        cut = end


def sorted_runs(bounds: list[bytes]):
    """A function over batches of (path, n, conv_id, ends): the blocks of sorted runs."""

    def batched(blocks: Iterable[tuple]) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        names = ["range", "forecast", "run", "more", "lcp", "rest", "n", "conv_id", "ends"]
        held: list[tuple] = []
        for block in blocks:
            held.append(block)
            if len(held) == 100:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)

    def runs(batches: Iterable) -> Iterator:
        from pyspark import TaskContext

        task, number, rows = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("path", "n", "conv_id", "ends")), strict=True)
            if len(rows) >= RUN_ROWS:
                yield from batched(blocks_of(f"{task}-{number}", rows, bounds))
                number, rows = number + 1, []
        yield from batched(blocks_of(f"{task}-{number}", rows, bounds))

    return runs


class Run:
    """A run's place in its blocks: the path there, and the LCP with what was put out last (-1 at the end)."""

    def __init__(self, block: dict):
        self.name, self.path, self.i = block["run"], b"", -1
        self.block = block
        self.step(None)

    def step(self, stream: Iterator[dict] | None) -> None:
        self.i += 1
        if self.i == len(self.block["lcp"]):
            if not self.block["more"]:
                self.lcp = -1
                return
            self.block, self.i = next(stream), 0
            assert self.block["run"] == self.name, "blocks come in the order in which the merge asks for them"
        self.lcp = self.block["lcp"][self.i]
        self.path = self.path[: self.lcp * WIDTH] + self.block["rest"][self.i]


def merged(stream: Iterator[dict]) -> Iterator[tuple[bytes, int, int, int, str]]:
    """(path, LCP with the path before, n, conv_id, ends) in order, from blocks sorted by forecast (null first)."""
    runs, first = [], None
    for block in stream:
        if block["forecast"] is not None:
            first = block
            break
        runs.append(Run(block))
    if not runs:
        return
    rest = (b for part in ([first] if first else [], stream) for b in part)
    for r in runs:
        r.lcp = 0
    k = len(runs)
    losers = [0] * k  # inner nodes from 1; a leaf i is node k + i

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser keeps its LCP with the winner."""
        x, y = runs[a], runs[b]
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        if x.lcp < 0:
            return a, b
        same = common(x.path, y.path, x.lcp)
        at = same * WIDTH
        a_wins = x.path[at : at + WIDTH] < y.path[at : at + WIDTH]
        (y if a_wins else x).lcp = same
        return (a, b) if a_wins else (b, a)

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while runs[top].lcp >= 0:
        r = runs[top]
        yield r.path, r.lcp, r.block["n"][r.i], r.block["conv_id"][r.i], r.block["ends"][r.i]
        r.step(rest)
        node = (k + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


class Node:
    __slots__ = ("border", "children", "conv_id", "ends", "leaves", "length", "n", "path", "saved", "waiting")

    def __init__(self, path: bytes, border: bool):
        self.path, self.border = path, border
        self.length = struct.unpack(">q", path[-8:])[0] if path else 0
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id, self.ends, self.waiting = None, EMPTY, []


NODE_SCHEMA = "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, length bigint, key binary, parent_key binary"
#: Of a node: all known; all but its parent's member; partial sums of one range.
WHOLE, BELOW_BORDER, PARTIAL = 0, 1, 2


def key_of(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


def closed(rows: Iterable[tuple], low: bytes, high: bytes | None) -> Iterator[tuple]:
    """Rows of ``NODE_SCHEMA`` from the merged paths in [low, high)."""
    open_path: list[Node] = []

    def close() -> Iterator[tuple]:
        node = open_path.pop()
        parent = open_path[-1] if open_path else None
        depth = len(open_path)
        if parent:
            parent.n += node.n
            parent.conv_id = node.conv_id if parent.conv_id is None else min(parent.conv_id, node.conv_id)
        above = key_of(node.path[:-WIDTH]) if parent and parent.border else None
        if node.border:
            yield (PARTIAL, node.conv_id, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.length, key_of(node.path), above)
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.length
        for d, row in node.waiting:
            yield (WHOLE, row[0], d, node.conv_id, *row[1:], None, None, None)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        row = (node.conv_id, node.n, node.children, leaves, saved, node.ends)
        if parent.border:
            yield (BELOW_BORDER, row[0], depth, None, *row[1:], None, None, above)
        else:
            parent.waiting.append((depth, row))

    for path, lcp, n, conv_id, ends in rows:
        while len(open_path) > lcp + 1:
            yield from close()
        before = min(common(path, low), max(0, len(low) // WIDTH - 1))
        border = max(before, common(path, high) if high is not None else 0)
        for d in range(len(open_path), len(path) // WIDTH + 1):
            open_path.append(Node(path[: d * WIDTH], d <= border))
        top = open_path[-1]
        top.n, top.ends = top.n + n, ends
        top.conv_id = conv_id if top.conv_id is None else min(top.conv_id, conv_id)
    while open_path:
        yield from close()


def _node_batches(rows: Iterable[tuple]) -> Iterator:
    import pyarrow as pa

    kinds = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield batch()
            held = []
    if held:
        yield batch()


def merged_nodes(bounds: list[bytes]):
    """A function over batches of blocks, sorted by range and forecast: rows of ``NODE_SCHEMA``."""

    def merge(batches: Iterable) -> Iterator:
        from itertools import groupby

        blocks = (row for batch in batches for row in batch.to_pylist())
        for at, stream in groupby(blocks, key=lambda b: b["range"]):
            low, high = bounds[at - 1] if at else b"", bounds[at] if at < len(bounds) else None
            yield from _node_batches(closed(merged(stream), low, high))

    return merge


def _border_tree(batches: Iterable) -> Iterator:
    """The border's nodes from their summed parts: subtree sums from the deepest up, and parents' members."""
    nodes = {bytes(r["key"]): r for batch in batches for r in batch.to_pylist()}

    def whole() -> Iterator[tuple]:
        for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
            above = nodes.get(bytes(r["parent_key"])) if r["parent_key"] is not None else None
            r["n_leaves"] = r["n_leaves"] or 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["length"]
            if above:
                above["n_children"] += 1
                above["n_leaves"] += r["n_leaves"]
                above["saved_tokens"] += r["saved_tokens"]
            yield (WHOLE, r["conv_id"], r["depth"], above and above["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], None, bytes(r["key"]), None)

    return _node_batches(whole())


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    small_batches(spark)
    paths = stored(distinct_paths(stored(rebuilt(turns), "trie-rebuilt")), "trie-paths")
    ranges = max(shuffle_partitions(spark), -(-paths.count() // RANGE_ROWS))
    bounds = bounds_of(paths, ranges)
    runs = paths.select("path", "n", "conv_id", "ends").mapInArrow(sorted_runs(bounds), RUN_SCHEMA)
    dealt = runs.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", F.col("forecast").asc_nulls_first(), "run")
    nodes = stored(dealt.mapInArrow(merged_nodes(bounds), NODE_SCHEMA), "trie-nodes")

    least = lambda c: F.min(c).alias(c)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ended = F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256")
    border = nodes.filter(F.col("kind") == PARTIAL).groupBy("key").agg(least("conv_id"), least("depth"), *sums, ended, least("length"), least("parent_key"))
    border = stored(border.coalesce(1).mapInArrow(_border_tree, NODE_SCHEMA), "trie-border")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    below = nodes.filter(F.col("kind") == BELOW_BORDER).drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("_above", "parent_conv_id")
    whole = nodes.filter(F.col("kind") == WHOLE)
    return whole.select(columns).unionByName(below.select(columns)).unionByName(border.select(columns))


ORACLE = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
), own AS (
  SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || length(coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {HEADS} AS h FROM own, crc_table
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM taken c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {BASE}
), member AS (
  SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)
), node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * coalesce(split_part(path[d], ':', 2)::BIGINT, 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY path, d
), child AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), part AS (
  SELECT path[1:a] AS path, saved, leaf FROM (
    SELECT n.path, n.saved, c.n IS NULL AS leaf, unnest(range(0, n.d + 1)) AS a FROM node n LEFT JOIN child c ON c.path = n.path)
), tree AS (
  SELECT path, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM part GROUP BY path
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN tree t ON t.path = n.path LEFT JOIN child c ON c.path = n.path LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
