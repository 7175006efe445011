"""Harmonic packing of token ids into fixed-length sequences.

A piece whose length lies in (C/(k+1), C/k] belongs to class k, and a bin of class k holds exactly k pieces.
Documents may be cut, so each is cut to lengths at the top of a class (C, C/2, C/3, ...): a full bin of such
pieces loses at most k - 1 ids. Only the last piece of a document, shorter than ``tail`` ids, is off the top
of its class. Every worker fills its own bins; what stays in open bins at its end is laid end to end and cut
at C, so a worker pads one sequence at most.

No row is shuffled: the plan is one scan and one pass. Defined results: a null or empty text is the end id
alone; repeated rows are packed like any other rows; a null ``doc_id`` is carried; an empty table gives no
pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._encode import encoder, in_batches
from ._store import small_batches

CAPACITY = 1024
TAIL = 32
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SCHEMA.split(", ")])


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the largest capacity // k that fit, then a tail."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= tail:
        k = capacity // n
        k += capacity // k != n
        out.append(capacity // k)
        n -= out[-1]
    return out + [n] * (n > 0)


class _Worker:
    """Open bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next, self.open = capacity, worker << 40, {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, doc_tokens, self.next, at))
            at += n
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // (len(piece[2]) // 4)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.close(self.open.pop(k))

    def finish(self) -> None:
        room, full = [], 0
        for k in sorted(self.open):
            for doc_id, start, ids, doc_tokens in self.open[k]:
                while ids:
                    part = ids[: 4 * (self.capacity - full)]
                    room.append((doc_id, start, part, doc_tokens))
                    full, start, ids = full + len(part) // 4, start + len(part) // 4, ids[len(part) :]
                    if full == self.capacity:
                        self.close(room)
                        room, full = [], 0
        self.open = {}
        if room:
            self.close(room)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """One row per piece of each document, with its ids as little-endian unsigned 32-bit bytes.

    ``sequence_id`` is the worker's number in the high bits and a count in the low ones; ``offset`` is gapless
    from 0 in each sequence. Rerunning over the same splits gives the same rows.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, worker = encoder(tokenizer), _Worker(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in in_batches(batch.column(1).to_pylist()):
                for i, ids in enumerate(enc.encode(texts), first):
                    ids += end
                    total, at = len(ids) // 4, 0
                    for n in cuts(total, capacity, tail):
                        worker.add((doc_ids[i], at, ids[4 * at : 4 * (at + n)], total))
                        at += n
                if len(worker.rows) > 5000:
                    yield worker.batch()
        worker.finish()
        if worker.rows:
            yield worker.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
