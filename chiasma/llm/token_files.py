"""Token ids in bit-plane files.

A file holds whole documents in ascending ``doc_id`` order. Their ids are laid end to end and cut into blocks
of ``BLOCK`` ids. A block is transposed into as many byte planes as its largest id has bytes (or into bit planes, which
take more room and time with these vocabularies), each plane is compressed by zstandard on its own, and the index at the file's end says where each plane lies,
so a reader can fetch one block, or the documents of one block, alone.

    magic | planes ... | index (zstandard) | index length, 8 bytes | magic
    index: counts (blocks, documents, planes, first id of the file within its bucket, unit), then per block its
    ids and planes, per plane its length, per document its id, whether it has one, and its number of ids

Files are named by bucket, number and the attempt that writes them. The manifest has one row a bucket, from the attempt
that ended well, and says which attempt's files count; what a lost executor left is never read and no file is moved or
replaced. Defined results: a null or empty text is the
end id alone; rows with equal or null ``doc_id`` are kept (null first, ties by text); an empty table writes no
file; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import encoder, in_batches
from ._order import in_order
from ._store import small_batches

MAGIC = b"CHIBPL01"
#: Ids in a block, and ids after which a file is closed.
BLOCK = 1 << 16
FILE_IDS = 1 << 21


def split_planes(ids: np.ndarray, unit: str = "bit") -> list[bytes]:
    """Planes from the lowest up; ids of a block are below 2 ** (number of planes, or 8 times it for bytes)."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [raw[:, k].tobytes() for k in range(-(-top // 8))]
    out = []
    for k in range(-(-top // 8)):
        bits = np.unpackbits(np.ascontiguousarray(raw[:, k])[:, None], axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out += [planes[j].tobytes() for j in range(min(8, top - 8 * k))]
    return out


def join_planes(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k in range(-(-len(planes) // 8)):
            own = np.frombuffer(b"".join(planes[8 * k : 8 * k + 8]), np.uint8).reshape(-1, -(-n // 8))
            bits = np.zeros((8, n), np.uint8)
            bits[: len(own)] = np.unpackbits(own, axis=1, count=n, bitorder="little")
            raw[:, k] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")[:, 0]
    return raw.reshape(-1).view("<u4").astype(np.uint32)


def encode_file(doc_ids: list[int | None], ids: list[bytes], first: int = 0, unit: str = "byte", level: int = 3) -> bytes:
    """A file's bytes. ``ids``: of each document, as little-endian unsigned 32-bit."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level)
    every = np.frombuffer(b"".join(ids), "<u4")
    out, blocks, lengths = io.BytesIO(), [], []
    out.write(MAGIC)
    for at in range(0, len(every), BLOCK):
        planes = [pack.compress(p) for p in split_planes(every[at : at + BLOCK], unit)]
        blocks += [min(BLOCK, len(every) - at), len(planes)]
        lengths += [len(p) for p in planes]
        out.write(b"".join(planes))
    head = [len(blocks) // 2, len(ids), len(lengths), first, int(unit == "byte")]
    docs = [x or 0 for x in doc_ids] + [int(x is not None) for x in doc_ids] + [len(x) // 4 for x in ids]
    index = pack.compress(np.array(head + blocks + lengths + docs, "<i8").tobytes())
    out.write(index + len(index).to_bytes(8, "little") + MAGIC)
    return out.getvalue()


def decode_file(content: bytes) -> tuple[list[int | None], list[bytes], int]:
    """Document ids, each document's ids, and the number of ids before the file in its bucket."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a bit-plane file")
    size = int.from_bytes(content[-16:-8], "little")
    index = np.frombuffer(unpack.decompress(content[-16 - size : -16]), "<i8")
    n_blocks, n_docs, n_planes, first, as_bytes = index[:5].tolist()
    blocks = index[5 : 5 + 2 * n_blocks].reshape(-1, 2).tolist()
    lengths = index[5 + 2 * n_blocks : 5 + 2 * n_blocks + n_planes].tolist()
    docs, known, counts = index[5 + 2 * n_blocks + n_planes :].reshape(3, n_docs).tolist()
    at, k, every = 8, 0, []
    for n, planes in blocks:
        own = []
        for length in lengths[k : k + planes]:
            own.append(unpack.decompress(content[at : at + length]))
            at += length
        k += planes
        every.append(join_planes(own, n, "byte" if as_bytes else "bit"))
    flat = b"".join(x.astype("<u4").tobytes() for x in every)
    ends = np.cumsum([0, *counts]) * 4
    parts = [flat[ends[i] : ends[i + 1]] for i in range(n_docs)]
    return [d if ok else None for d, ok in zip(docs, known, strict=True)], parts, first


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, unit: str = "byte", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the documents' ids below ``folder`` (any URI that pyarrow opens); one row per bucket: its number of ids and
    the attempt whose files count.

    The rows (as many as tasks) are the manifest that places each bucket among all ids.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, attempt = encoder(tokenizer), uuid.uuid4().hex
        store, base = fs.FileSystem.from_uri(folder)
        state = {"bucket": None, "file": 0, "first": 0, "n": 0}
        held_docs: list[int | None] = []
        held_ids: list[bytes] = []
        done: list[tuple[int, int, str]] = []

        def close() -> None:
            if held_ids:
                with store.open_output_stream(f"{base}/bucket-{state['bucket']:07d}-{state['file']:06d}-{attempt}.bpl") as f:
                    f.write(encode_file(held_docs, held_ids, state["first"], unit))
                state["file"] += 1
                state["first"] += state["n"]
                state["n"] = 0
                held_docs.clear()
                held_ids.clear()

        for batch in batches:
            buckets, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in in_batches(batch.column(2).to_pylist()):
                for i, ids in enumerate(enc.encode(texts), first):
                    if buckets[i] != state["bucket"]:
                        close()
                        if state["bucket"] is not None:
                            done.append((state["bucket"], state["first"], attempt))
                        state.update(bucket=buckets[i], file=0, first=0)
                    held_docs.append(doc_ids[i])
                    held_ids.append(ids + end)
                    state["n"] += len(ids) // 4 + 1
                    if state["n"] >= file_ids:
                        close()
        close()
        if state["bucket"] is not None:
            done.append((state["bucket"], state["first"], attempt))
        types = (pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], ["bucket", "n_ids", "attempt"])

    return in_order(docs).select("bucket", "doc_id", "text").mapInArrow(run, "bucket long, n_ids long, attempt string")


def read_tokens(spark: SparkSession, folder: str, manifest: dict[int, tuple[int, str]]) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in the files of the manifest, which has
    the number of ids and the attempt of each bucket."""
    starts, total = {}, 0
    for bucket in sorted(manifest):
        starts[bucket] = total
        total += manifest[bucket][0]
    valid = {(bucket, attempt) for bucket, (_, attempt) in manifest.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bucket, _, attempt = path.rsplit("bucket-", 1)[1].removesuffix(".bpl").split("-")
                if (int(bucket), attempt) not in valid:
                    continue
                docs, ids, at = decode_file(content.as_py())
                at += starts[int(bucket)]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                start = at + np.cumsum(counts) - counts
                for k in range(0, len(ids), 2000):
                    own = slice(k, k + 2000)
                    yield pa.record_batch([pa.array(docs[own], pa.int64()), pa.array(start[own]), pa.array(ids[own], pa.binary())], ["doc_id", "start", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpl").load(folder)
    return files.select("path", "content").mapInArrow(run, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, unit: str = "byte", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files, then the documents as read back from them."""
    rows = write_tokens(docs, tokenizer, folder, end_id, unit, file_ids).collect()
    return read_tokens(docs.sparkSession, folder, {r["bucket"]: (r["n_ids"], r["attempt"]) for r in rows})


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
