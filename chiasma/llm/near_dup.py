"""Near-duplicate classes by Order MinHash.

A text is the sequence of its words, lower-cased; its k-mers are five-word shingles (fewer than five words are one).
Each of ``BANDS`` hash functions takes the ``ORDERED`` smallest of the occurrence-labelled shingles and keeps them in
text order; their hash is the band's key, so texts share a key when they share shingles in the same order. Candidates
are verified by an alignment of their words, banded to the diagonals that a passing pair can reach:
aligned / (n + m - aligned) has to be ``SIMILARITY`` at least. So an edited word costs one word, not five shingles.
Classes are the connected components of all verified pairs that share a key. A pair that shares none of the keys is
not compared: of pairs with a share s of their shingles in common (in all that either has) a key agrees with chance
s ** 2 or somewhat less, so at s = 0.6 all but 0.01 % are found, at 0.5 all but 0.3 %, at 0.4 all but 3 %, at 0.3 all
but 15 %. One word in 20 edited leaves s = 0.6, one in ten s = 0.4.

Equal texts are one node from the start, and different texts with one ``doc_id`` are different nodes. Every member of a
key is compared with the key's centre, the text with the smallest hash. What is left is compared in full: of a key whose other
members still are in several classes every pair from two classes is looked at, in blocks of ``BLOCK`` by ``BLOCK`` members dealt
over tasks. Their counts of words in ``COUNTS`` cells bound from above how many words both have, so a pair that the bound rules
out cannot pass; all others are aligned, but for those that the block's own links have brought into one class before. So of the
pairs that share a key none that passes is left in two classes, and pairs are rows nowhere: a block gives the links that join
classes, fewer than it has members. A centre is sent to one task for each ``PART`` of its members, so a hot one is dealt over
many tasks.

Defined results: null text counts as empty; texts without words are equal only if they are the same; a very long text
is sketched alone, in memory in proportion to it; rows with a null ``doc_id`` take the class of their text if it has
one, else null; repeated rows share a class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import joined, mixed, span_hashes, word_chars_lowered
from ._encode import in_batches
from ._store import drop_folder, fresh_folder, small_batches, stored, unused

WORDS = 5
BANDS = 20
ORDERED = 2
SIMILARITY = 0.8
#: Members of a centre that go to one task together.
PART = 256
#: Members to a side of a block of pairs, bytes of their texts or so, and cells of the word counts that rule pairs out.
BLOCK = 512
BLOCK_BYTES = 1 << 24
COUNTS = 128
#: Slots of a sieve's bitmap, which is 8 MB at most.
SLOTS = 1 << 26
_CHARS, _TEXTS, _CELLS = 500_000, 500, 500_000
_STEPS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xAAF54A3D5A1B1C61, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SALTS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEPS[1])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and where each text's begin (one more entry at the end)."""
    raw, starts = joined(texts)
    c = word_chars_lowered()[raw]
    edge = np.diff(np.concatenate([[0], (c != 0x20).view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(c)(begin, end), np.searchsorted(begin, starts)


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in order, and where each text's begin (one more entry at the end)."""
    n = np.diff(first)
    window = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        window[: len(words) - k] += words[k:] * _STEPS[k]
    window = mixed(window)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    ends = np.cumsum(count)
    at = np.repeat(first[:-1] - np.concatenate([[0], ends[:-1]]), count) + np.arange(ends[-1] if len(ends) else 0)
    out = window[at]
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        own = words[first[i] : first[i + 1]]
        out[ends[i] - 1] = mixed(np.array([(own * np.array(_STEPS[: len(own)])).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, np.concatenate([[0], ends])


def labelled(sh: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence in the text mixed in."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
    key = sh ^ mixed(doc + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    rank = np.arange(len(s)) - np.repeat(run, np.diff(np.concatenate([run, [len(s)]])))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = rank.astype(np.uint64)
    return mixed(sh + occurrence * _STEPS[0])


def keys(sh: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each text, the key of each band; none for a text without words."""
    lab = labelled(sh, starts)
    out: list[np.ndarray] = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = lab[a:b]
        m = min(ORDERED, len(own))
        found = np.zeros(BANDS if m else 0, np.uint64)
        step = max(1, _CELLS // max(1, len(own)))
        for k in range(0, len(found), step):
            h = (own ^ _SALTS[k : k + step, None]) * _STEPS[2]
            h ^= h >> np.uint64(32)
            at = np.argpartition(h, m - 1, axis=1)[:, :m]
            at.sort(axis=1)
            total = np.zeros(len(h), np.uint64)
            for j in range(m):
                total = mixed(total + own[at[:, j]])
            found[k : k + step] = mixed(total ^ _SALTS[k : k + step])
        out.append((found >> np.uint64(1)).astype(np.int64))
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, common: int | None = None) -> float:
    """aligned / (n + m - aligned) of two sequences of words; 0 once it is known to be below ``least``.

    ``common``: how many words both have, whatever their order, if that is known. The alignment is a longest
    common subsequence by bit-parallel columns. A pair at or above ``least`` has at most
    (1 - least) / (1 + least) * (n + m) unaligned words, so it stays within that many diagonals.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    if common is None:
        common = len(np.intersect1d(alone(a), alone(b), assume_unique=True))
    if common < least * (n + m - common):
        return 0.0
    band = int((1 - least) / (1 + least) * (n + m) + 1e-9)
    same = a[: min(n, m)] == b[: min(n, m)]
    head = len(same) if same.all() else int(same.argmin())
    rest = min(n, m) - head
    same = a[n - rest :][::-1] == b[m - rest :][::-1]
    tail = rest if same.all() else int(same.argmin())
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    place: dict[int, int] = {}
    for i, s in enumerate(x):
        place[s] = place.get(s, 0) | (1 << i)
    # bits of v are 0 where the column's length grows
    full = (1 << len(x)) - 1
    v = full
    width = (1 << (2 * band + 1)) - 1
    narrow = len(x) > band or len(y) > band
    for j, s in enumerate(y):
        hit = place.get(s, 0)
        if hit:
            if narrow:
                hit &= width << (j - band) if j >= band else width >> (band - j)
            u = v & hit
            v = ((v + u) | (v - u)) & full
    aligned = head + tail + len(x) - v.bit_count()
    found = aligned / (n + m - aligned)
    return found if found >= least else 0.0


def alone(sh: np.ndarray) -> np.ndarray:
    """The occurrence-labelled words (or shingles) of one text, ascending."""
    return np.sort(labelled(sh, np.array([0, len(sh)])))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (md5 of the text, null as empty), size (its bytes) and band_keys."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), F.octet_length("text").cast("long").alias("size"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_batches(batch.column(3).to_pylist(), _CHARS, _TEXTS):
                own = batch.slice(first, len(texts))
                found = pa.array(keys(*shingles(*words(texts))), pa.list_(pa.int64()))
                yield pa.record_batch([*own.columns[:3], found], ["doc_id", "text_key", "size", "band_keys"])

    return rows.mapInArrow(run, "doc_id long, text_key binary, size long, band_keys array<long>")


def _sieved(rows: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """``rows`` without most of those whose ``names`` are not in ``wanted``: a bitmap of hashes goes to every task, so what
    a join would drop is not shuffled for it. That join has to be an inner one: Spark moves a semi-join below the sieve."""
    slot = F.pmod(F.xxhash64(*names), F.lit(SLOTS))
    bits = wanted.select(slot.alias("_slot")).select("_slot", F.bitmap_bucket_number("_slot").alias("_bucket")).repartition("_bucket")
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("_bucket"))
    return met.filter(F.get(F.array(*[byte.bitwiseAND(1 << k) for k in range(8)]), (at % 8).cast("int")) > 0).select(*rows.columns)


def _sequences(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id (the text's key) and sh, the words (binary, 64-bit little-endian), of the texts in ``ids``; one row per text.

    ``ids`` has the doc_id of one document of each text, so the others' texts are not shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.unhex(F.md5("text")).alias("id"), "doc_id", "text")
    rows = _sieved(rows, ids, "id", "doc_id").join(ids, ["id", "doc_id"]).dropDuplicates(["id", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_batches(batch.column(1).to_pylist(), _CHARS, _TEXTS):
                w, starts = words(texts)
                parts = [w[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                own = batch.slice(first, len(texts))
                yield pa.record_batch([own.column(0), pa.array(parts, pa.binary())], ["id", "sh"])

    return rows.select("id", "text").mapInArrow(run, "id binary, sh binary")


def _beside(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows a, b, sh: a's own sequence, with b null, and after it those of some of its partners, ``PART`` or so."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    of = lambda name: sequences.select(F.col("id").alias(name), "sh")
    members = pairs.join(parts, "a").join(of("b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "sh")
    heads = parts.join(of("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "sh")
    rows = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "sh")


def verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sequences align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for batch in batches:
            ok = []
            for b, sh in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(sh.as_py(), "<u8")
                ok.append(b is not None and similarity(c, x, least) > 0)
                if b is None:
                    c = x
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _beside(pairs, sequences).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """id and root (the smallest id of its component) of all ids in the links, by alternating stars.

    Each round links a node's larger neighbours to its smallest one, then its smaller ones; paths shorten by
    halves, stars settle at once. It ends when every edge leads from a root. Rounds are written to the shared
    folder, so lineage stays short.
    """
    spark = links.sparkSession
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    path = None
    for _ in range(rounds):
        # large star: of each u, every larger neighbour goes to the smallest of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        # small star: of each u, its smaller neighbours and itself go to the smallest
        small = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        near = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(small, "u")
        edges = near.select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select("m", "u")).filter("a < b").distinct()
        folder = fresh_folder(spark, "near-dup-edges")
        edges.write.parquet(f"{folder}/table")
        edges = spark.read.schema(edges.schema).parquet(f"{folder}/table")
        if path:
            drop_folder(spark, path)
        path = folder
        # a node with a parent that is a parent itself, or with two parents: the stars are not done
        ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
        if open_.isEmpty():
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
    raise RuntimeError("components did not settle")


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and text_key of each document, and of each text that has a doc_id: text_key, id (its smallest doc_id),
    class_id (the smallest doc_id of its class) and ``first`` (the text of its class that stays).

    Texts are the nodes, so two texts with one doc_id are two.
    """
    base = stored(sketches(docs), "near-dup-sketches")
    texts = base.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.any_value("band_keys").alias("band_keys"), F.any_value("size").alias("size")).filter("doc_id is not null")
    texts = stored(texts.withColumnRenamed("text_key", "id"), "near-dup-texts")
    members = texts.select("id", "doc_id", "size", F.explode(F.array_distinct("band_keys")).alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "near-dup-keys")
    members = stored(_sieved(members, shared, "key").join(shared, "key"), "near-dup-members")
    # keys with the same members are one group
    groups = members.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
    groups = groups.select("key", "a", F.xxhash64("a", "n", "x").alias("group"))
    members = stored(members.join(groups, "key").select("group", "a", "id", "doc_id", "size").distinct(), "near-dup-groups")
    sequences = stored(_sequences(docs, members.select("id", "doc_id").distinct()), "near-dup-sequences")
    pairs = stored(members.filter("a <> id").select("a", F.col("id").alias("b")).distinct(), "near-dup-pairs")
    roots = stored(components(stored(verified(pairs, sequences, least), "near-dup-stars")), "near-dup-roots")
    more = stored(_rest(stored(_apart(members, roots), "near-dup-apart"), sequences, least), "near-dup-rest")
    if not more.isEmpty():
        roots = stored(components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more)), "near-dup-roots")
    own = stored(texts.select("id", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "near-dup-rooted")
    least_of = own.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("m"))
    of = own.join(least_of, "root").select(F.col("id").alias("text_key"), F.col("doc_id").alias("id"), F.col("m.doc_id").alias("class_id"), (F.col("m.id") == F.col("id")).alias("first"))
    return base.select("doc_id", "text_key"), of


def near_dup_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id and class_id, the smallest doc_id of its class."""
    base, of = _classes(docs, least)
    return base.join(of.select("text_key", "class_id"), "text_key", "left").select("doc_id", "class_id")


def _rooted(rows: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
    """``rows`` with the root of the ids in ``name``; an id without links is its own."""
    own = roots.select(F.col("id").alias(name), F.col("root").alias(root))
    return rows.join(own, name, "left").withColumn(root, F.coalesce(root, name))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root and groups (each with its number of parts) of the members that are no centre, of groups whose such members
    are in several classes. Parts have ``BLOCK`` members and ``BLOCK_BYTES`` of text or so."""
    rows = _rooted(members.filter("a <> id").select("group", "id", "size"), roots, "id", "root")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_BYTES))).cast("long")
    several = rows.groupBy("group").agg(parts.alias("parts"), F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x <> _y")
    rows = rows.join(several.select("group", "parts"), "group")
    return rows.groupBy("id").agg(F.any_value("root").alias("root"), F.collect_list(F.struct("group", "parts")).alias("groups"))


def cells(words: np.ndarray) -> np.ndarray:
    """How many of a text's words fall into each of ``COUNTS`` cells."""
    return np.bincount((mixed(words) % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS).clip(0, 0xFFFF).astype(np.uint16)


def may_pass(words: np.ndarray, cells: np.ndarray, n: int, own: np.ndarray, least: float) -> np.ndarray:
    """Which texts, of so many ``words`` and of such ``cells``, the bound does not rule out beside one of ``n`` and ``own``."""
    ok = np.minimum(words, n) >= least * np.maximum(words, n) - 1e-9
    at = np.flatnonzero(ok & (np.maximum(words, n) <= 0xFFFF))  # longer ones may have cells that are not counted to the end
    common = np.minimum(cells[at], own).sum(axis=1, dtype=np.int64)
    ok[at] = common >= least * (words[at] + n - common) - 1e-9
    return ok


def block_links(group: int, block: list[dict], least: float) -> list[tuple[bytes, bytes]]:
    """Links that join all classes of a block between which some pair aligns: of members of one part, or of two parts each.

    A pair that shares several groups is left to the smallest of them.
    """
    classes: dict[bytes, int] = {}
    of = np.array([classes.setdefault(r["root"], len(classes)) for r in block])
    if len(classes) == 1:
        return []
    part = np.array([r["part"] for r in block])
    cross = block[0]["i"] != block[0]["j"]
    own = [np.frombuffer(r["sh"], "<u8") for r in block]
    groups = [set(r["groups"]) for r in block]
    many = len(block) > 16
    size = np.array([len(w) for w in own])
    counts = np.array([cells(w) for w in own]) if many else None
    sorted_: list[np.ndarray | None] = [None] * len(block)
    out = []
    for x in range(len(block)):
        # within a part each pair once; between two the second part's members only
        at = np.flatnonzero((of != of[x]) & (part > part[x] if cross else np.arange(len(block)) > x))
        if many:
            at = at[may_pass(size[at], counts[at], size[x], counts[x], least)]
        for y in at.tolist():
            if of[y] == of[x] or min(size[x], size[y]) < least * max(size[x], size[y]):
                continue
            if min(groups[x] & groups[y]) != group:
                continue
            for k in (x, y):
                if sorted_[k] is None:
                    sorted_[k] = alone(own[k])
            common = len(np.intersect1d(sorted_[x], sorted_[y], assume_unique=True))
            if similarity(own[x], own[y], least, common) > 0:
                out.append((block[x]["id"], block[y]["id"]))
                of[of == of[y]] = of[x]
    return out


def _rest(apart: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the classes of members of one group, by all pairs of members from two classes."""
    rows = apart.join(_sieved(sequences, apart, "id"), "id").select("id", "root", "sh", F.col("groups.group").alias("groups"), F.explode("groups").alias("g"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("g.parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g.parts") - 1)))
    rows = rows.select(F.col("g.group").alias("group"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "root", "groups", "sh")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        at = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (row["group"], row["i"], row["j"]):
                    if block:
                        out += block_links(at[0], block, least)
                    block, at = [], (row["group"], row["i"], row["j"])
                block.append(row)
            if out:
                yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])
        if block and (out := block_links(at[0], block, least)):
            yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class: of the smallest id, and of texts that share it the one of the smallest hash; repeated
    rows go. Of equal texts without any id one stays. Columns may have any names."""
    inner, kept_key, kept_id = (unused(docs, n) for n in ("_text_key", "_kept_key", "_kept_id"))
    rows = docs.withColumn(inner, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    base, of = _classes(docs, least)
    same = F.col(inner) == F.col(kept_key)
    kept = of.filter("first").select(F.col("text_key").alias(kept_key), F.col("class_id").alias(kept_id))
    first = rows.join(kept, same & (F.col("doc_id") == F.col(kept_id)), "left_semi").dropDuplicates([inner])
    known = of.select(F.col("text_key").alias(kept_key))
    rest = rows.filter(F.col("doc_id").isNull()).join(known, same, "left_anti").dropDuplicates([inner])
    return first.unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
