"""Document fingerprints from improbable features.

Every 64-byte window of a text's UTF-8 has an entropy, quantised to 0..1000 in whole-number arithmetic. A window's
rank is how common its entropy is over all documents (rarest first; nearly constant windows are left out). In each
run of 64 windows the leftmost of the lowest rank is chosen; windows chosen at least 16 times are the features.
They enter Bloom filters of 256 bytes by five hashes, 160 features to a filter, then the next filter of the chain.
Every text, of whatever length, has one more filter: of its windows of 8 bytes those of the 160 lowest hashes.
Likeness compares set bits: per filter the best overlap with a filter of the other chain, less what chance gives,
normalised, weighted by set bits. It is the mean of the chains' and the last filters' likeness, the chains' weighing as
much as they have features (half of both texts' together) and the last filter's ``SHORT_WEIGHT``. So a text of a few
hundred bytes, most of whose popular windows one changed byte removes, stays near its copy, and in long texts the
improbable features decide; nothing changes abruptly with length.

Two passes: the entropy counts of all documents (one row of counts per task, summed before 1,001 rows reach the
driver), then the fingerprints, for which the texts are dealt once in ascending ``doc_id`` order so that each has
its successor beside it. Fingerprints depend on the ranks: pass the ``counts`` of one table (``level_counts``, 1,001
numbers) to compare those of several. A very long text is handled alone and takes about 100 bytes of memory for each
of its own. Defined results: null text counts as empty; a text of under 8 bytes is one window of 8 bytes, an empty text
none; two texts without features are alike (1), one with and one without are not (0); rows with equal
``doc_id`` are ordered by text, null ids first; a single row follows itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import mixed, span_hashes
from ._encode import in_batches
from ._order import in_order
from ._store import small_batches

WINDOW = 64
RUN = 64
POPULAR = 16
FILTER_BYTES, FILTER_FEATURES, HASHES = 256, 160, 5
LEVELS = 1001
#: Bytes of a short window, how many of them a text keeps, and what their likeness weighs, in popular windows.
SHORT, SHORT_FEATURES, SHORT_WEIGHT = 8, FILTER_FEATURES, 8
#: Entropies below this level are nearly constant windows.
LEAST_LEVEL = 100
_CHARS = 700_000
_ONE = 1 << 20
_NONE = np.int64(0x7FFFFFFFFFFFFFFF)
_SHIFTS = np.arange(HASHES, dtype=np.uint64)[:, None] * np.uint64(12)


@cache
def _gain() -> np.ndarray:
    """c log2 c - (c - 1) log2 (c - 1) for counts up to the window's length, as whole numbers."""
    c = np.arange(WINDOW + 1, dtype=float)
    total = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0)
    return np.rint(np.diff(total, prepend=0) * _ONE).astype(np.int64)


def levels(x: np.ndarray) -> np.ndarray:
    """Entropy level of every window of the bytes, exactly the same wherever the window stands."""
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(x, kind="stable")
    kind = np.int32 if 256 * (n + WINDOW) < 1 << 31 else np.int64
    place = x[order].astype(kind) * kind(n + WINDOW) + order.astype(kind)
    behind, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)  # equal bytes in the window that ends, or begins, here
    gap, close = np.empty(n, kind), np.empty(n, bool)
    for k in range(1, WINDOW):
        near = np.less(np.subtract(place[k:], place[:-k], out=gap[k:]), WINDOW, out=close[k:])
        if not near.any():
            break
        behind[k:] += near
        ahead[:-k] += near
    ends, begins = np.empty(n, np.uint8), np.empty(n, np.uint8)
    ends[order], begins[order] = behind, ahead
    gain = _gain()
    total = np.cumsum(gain[ends])
    total[WINDOW:] -= np.cumsum(gain[begins])[: n - WINDOW]
    bits = 6 * _ONE - total[WINDOW - 1 :] // WINDOW
    return np.clip(bits * (LEVELS - 1) // (6 * _ONE), 0, LEVELS - 1)


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether the window from each position stays within one text."""
    ok = np.ones(max(0, n - WINDOW + 1), bool)
    for s in starts[1:-1].tolist():
        ok[max(0, s - WINDOW + 1) : s] = False
    return ok


def level_counts(docs: DataFrame) -> np.ndarray:
    """How often each level occurs in all windows of all documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, texts in in_batches(batch.column(0).to_pylist(), _CHARS):
                x, starts = joined_bytes(texts)
                total += np.bincount(levels(x)[_inside(starts, len(x))], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["level", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS, np.int64)
    for r in rows:
        out[r["level"]] = r["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: rarest first, ties by level; nearly constant windows have none (-1)."""
    order = np.lexsort((np.arange(LEVELS), counts))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    out[:LEAST_LEVEL] = -1
    return out


def short_hashes(x: np.ndarray) -> np.ndarray:
    """Of every 8 bytes, as one number, the hash."""
    out = np.empty(max(0, len(x) - SHORT + 1), np.uint64)
    for k in range(min(SHORT, len(out))):
        own = out[k::SHORT]
        own[:] = np.frombuffer(x[k : k + len(own) * SHORT].tobytes(), "<u8")
    return mixed(out)


def _once(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def lowest(h: np.ndarray) -> np.ndarray:
    """The distinct hashes of the lowest ``SHORT_FEATURES``, ascending."""
    if len(h) > 4 * SHORT_FEATURES:  # most often these are among those below a bound, which are few to sort
        few = _once(h[h < np.uint64((1 << 64) // len(h) * 2 * SHORT_FEATURES)])
        if len(few) >= SHORT_FEATURES:
            return few[:SHORT_FEATURES]
    return _once(h)[:SHORT_FEATURES]


def features(texts: list[str], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the 64-bit hashes of its popular windows in order of first occurrence, and of its lowest short ones."""
    x, starts = joined_bytes(texts)
    return _features(x, starts, levels(x), short_hashes(x), rank)


def features_of_run(texts: list[str], changed: list[tuple[str, str]], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of ``texts`` and then of the changed ones, each of which is a beginning of the text of its number and
    one of the next text. What windows within either come to is taken from those texts; the windows over the joint are computed.
    """
    x, starts = joined_bytes(texts)
    y, joints = joined_bytes([t for pair in changed for t in pair])
    level, short = levels(x), short_hashes(x)
    found = _features(x, starts, level, short, rank)
    carried = (_carried(f, own, width, starts, y, joints) for f, own, width in ((levels, level, WINDOW), (short_hashes, short, SHORT)))
    return found + _features(y, joints[::2], *carried, rank)


def _carried(f: Callable[[np.ndarray], np.ndarray], own: np.ndarray, width: int, starts: np.ndarray, y: np.ndarray, joints: np.ndarray) -> np.ndarray:
    """``f`` of the windows of ``y`` that lie within one changed text, from ``own``, which it is of the texts' windows; 0 for others."""
    out = np.zeros(max(0, len(y) - width + 1), own.dtype)
    over, n = [], width - 1
    begins, at = starts.tolist(), joints.tolist()
    for i in range(len(at) // 2):
        a, joint, b = at[2 * i : 2 * i + 3]
        for where, length, source in ((a, joint - a, begins[i]), (joint, b - joint, begins[i + 1])):
            if length > n:
                out[where : where + length - n] = own[source : source + length - n]
        if min(joint + n, b) - max(a, joint - n) > n:
            over.append((max(a, joint - n), min(joint + n, b)))
    if over:
        got = f(np.concatenate([y[a:b] for a, b in over]))
        k = 0
        for a, b in over:
            out[a : b - n] = got[k : k + b - a - n]
            k += b - a
    return out


def _features(x: np.ndarray, starts: np.ndarray, level: np.ndarray, short: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of texts' bytes and what their windows come to."""
    n = len(x)
    none = np.zeros(0, np.uint64)
    own = [(none, none)] * (len(starts) - 1)
    if not n:
        return own
    hashed = span_hashes(x)
    key = np.full(max(0, n - WINDOW + 1), _NONE)
    if len(key):
        r = rank[level]
        ok = _inside(starts, n) & (r >= 0)
        key[ok] = (r[ok] << 32) | np.flatnonzero(ok)
    low, span = key, 1
    while span < RUN:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    # runs that stay within one text's windows
    for_run = np.ones(len(low), bool)
    for s in starts[1:-1].tolist():
        for_run[max(0, s - WINDOW - RUN + 2) : s] = False
    best = low[for_run & (low != _NONE)] & np.int64(0xFFFFFFFF)
    chosen = np.flatnonzero(np.bincount(best, minlength=1) >= POPULAR)
    cut = np.searchsorted(chosen, starts)
    for i in range(len(own)):
        a, b = int(starts[i]), int(starts[i + 1])
        at = chosen[cut[i] : cut[i + 1]]
        h = hashed(at, at + WINDOW) if len(at) else none
        if len(h):
            h = h[np.sort(np.unique(h, return_index=True)[1])]
        if b - a >= SHORT:
            own[i] = h, lowest(short[a : b - SHORT + 1])
        elif b > a:
            own[i] = h, hashed(np.array([a]), np.array([b]))
    return own


def chain(feature: np.ndarray) -> np.ndarray:
    """Bloom filters of a text's features, one row each."""
    n = -(-len(feature) // FILTER_FEATURES)
    bits = np.zeros((n, FILTER_BYTES * 8), np.uint8)
    width = FILTER_BYTES * 8
    row = np.arange(len(feature)) // FILTER_FEATURES * width
    bits.ravel()[row + ((feature >> _SHIFTS) & np.uint64(width - 1)).view(np.int64)] = 1
    return np.packbits(bits, axis=1)


@dataclass(frozen=True)
class Print:
    """A text's fingerprint: numbers of features, the chain of its popular windows, the filter of its short ones."""

    n: tuple[int, int]
    popular: np.ndarray
    short: np.ndarray

    @classmethod
    def of(cls, feature: tuple[np.ndarray, np.ndarray]) -> Print:
        return cls((len(feature[0]), len(feature[1])), chain(feature[0]), chain(feature[1]))

    def __str__(self) -> str:
        return ":".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.n, (self.popular, self.short), strict=True))


def likeness(a: Print, b: Print) -> float:
    """0 to 1; the same from either side."""
    n = (a.n[0] + b.n[0]) / 2
    near = overlap(a.short, b.short)
    return near if not n else (n * overlap(a.popular, b.popular) + SHORT_WEIGHT * near) / (n + SHORT_WEIGHT)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) == 1:  # the same in whole numbers
        return _overlap_of_one(int.from_bytes(a.tobytes()), int.from_bytes(b.tobytes()))
    a, b = a.view(np.uint64), b.view(np.uint64)
    na, nb = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    both = np.array([np.bitwise_count(a[i] & b).sum(axis=1) for i in range(len(a))], float)
    most = np.minimum(na[:, None], nb[None, :])
    chance = na[:, None] * nb[None, :] / (FILTER_BYTES * 8)
    room = most - chance
    score = np.clip((both - chance) / np.maximum(room, 1e-9), 0, 1)
    one = (score.max(axis=1) * na).sum() / na.sum()
    other = (score.max(axis=0) * nb).sum() / nb.sum()
    return float(one if len(a) < len(b) else other if len(b) < len(a) else (one + other) / 2)


def _overlap_of_one(a: int, b: int) -> float:
    na, nb, both = float(a.bit_count()), float(b.bit_count()), float((a & b).bit_count())
    chance = na * nb / (FILTER_BYTES * 8)
    score = min(1.0, max(0.0, (both - chance) / max(min(na, nb) - chance, 1e-9)))
    return (score * na / na + score * nb / nb) / 2


def halves(text: str, after: str) -> tuple[str, str]:
    """What stays of the text, and as much of the next one's beginning as its last half (rounded down) was."""
    n = len(text)
    return text[: n - n // 2], after[: n // 2]


def edited(text: str, after: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the next one's beginning."""
    return "".join(halves(text, after))


SCHEMA = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, counts: np.ndarray | None = None, with_text: bool = True) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and how near they and the next one's are."""
    rank = ranks(level_counts(docs) if counts is None else counts)
    third = "edited_text" if with_text else "edited_sha256"

    def rows_of(run: list[tuple]) -> list[tuple]:
        """Of (doc_id, text) rows in order, all but the last."""
        texts = [t for _, t in run]
        parts = [halves(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        made = [Print.of(f) for f in features_of_run(texts, parts, rank)]
        changed = ["".join(p) for p in parts]
        out = []
        for i, (doc_id, text) in enumerate(run[:-1]):
            own, after, other = made[i], made[i + 1], made[len(run) + i]
            what = changed[i] if with_text else hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), what, str(own), str(other), likeness(own, other), likeness(own, after)))
        return out

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = SCHEMA.replace("edited_text", third)
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, bucket, ended = 0, None, True
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for b, guest, doc_id, text in zip(*columns, strict=True):
                if ended or b != bucket:
                    if guest:
                        continue  # a bucket's other copies of the same guest
                    held, size, bucket, ended = [], 0, b, False
                held.append((doc_id, text or ""))
                size += len(text or "")
                if guest or size > _CHARS and len(held) > 1:
                    if rows := rows_of(held):
                        yield batch_of(rows)
                    held, size, ended = held[-1:], len(held[-1][1]), guest

    return in_order(docs, guests=True).select("bucket", "guest", "doc_id", "text").mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return fingerprints(docs, with_text=False)
