"""Files of token ids, as shuffled bit or byte planes.

A file holds the ids of documents in ascending order of ``doc_id``, each
document followed by an end id::

    magic | chunk | chunk | ... | documents | index | trailer

* A chunk has a fixed number of ids (the last one of a file may have fewer).
  Its unsigned 32-bit ids are transposed to 4 byte planes, or 32 bit planes;
  each plane is compressed by zstandard on its own. A plane of zeros is empty.
* ``documents`` has ids and lengths of the documents, as compressed 64-bit columns.
* ``index`` has a row per chunk: its place in the file, its number of ids and
  the size of every plane, so a chunk is found and read without any other.
* The trailer has the places and sizes of ``documents`` and ``index``.

All integers are little-endian. Every Spark partition writes one file under a
name of its own attempt, and the list of files is a table that Spark commits:
what a lost or repeated attempt wrote is not in it. Files go through
``pyarrow.fs``, so the folder may be in any store that this can open.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vertexweave.llm.frames import id_and_text
from vertexweave.llm.tokens import byte_ids
from vertexweave.llm.workers import SLICE_BYTES, slices, texts
from vertexweave.plans.storage import scratch_path, stored

MAGIC = b"IDPLANE1"
CHUNK_IDS = 1 << 16
PLANES = {"byte": 4, "bit": 32}
_TRAILER = struct.Struct("<QQQQB7x8s")
# doc_id null is written as this, which no 64-bit id of a table should be.
_NO_ID = np.iinfo(np.int64).min


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; a bit plane is filled up with zero bits to whole bytes."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        bits = np.unpackbits(columns, axis=1, bitorder="little")
        return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    return [np.ascontiguousarray(columns[:, i]).tobytes() for i in range(4)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """Undo ``to_planes``; an empty plane is one of zeros."""
    if kind == "bit":
        bits = np.zeros((n, 32), np.uint8)
        for i, plane in enumerate(planes):
            if plane:
                bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(n)
    columns = np.zeros((n, 4), np.uint8)
    for i, plane in enumerate(planes):
        if plane:
            columns[:, i] = np.frombuffer(plane, np.uint8)
    return columns.view("<u4").reshape(n)


class IdWriter:
    """Writes one file; ids are held only until a chunk is full."""

    def __init__(self, out, kind: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3):
        self.out, self.kind, self.chunk_bytes = out, kind, 4 * chunk_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes = [], 0
        self.index, self.doc_ids, self.lengths = [], [], []
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(_NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.chunk_bytes:
            data = b"".join(self.held)
            whole = len(data) - len(data) % self.chunk_bytes
            for start in range(0, whole, self.chunk_bytes):
                self._chunk(data[start : start + self.chunk_bytes])
            self.held, self.held_bytes = [data[whole:]], len(data) - whole

    def _chunk(self, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        packed = [self.zstd.compress(p) if any_set(p) else b"" for p in to_planes(ids, self.kind)]
        self.index.append([self.at, len(ids), *map(len, packed)])
        self._write(b"".join(packed))

    def _write(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def finish(self) -> tuple[int, int]:
        """Numbers of documents and of ids."""
        rest = b"".join(self.held)
        if rest:
            self._chunk(rest)
        docs = np.array([self.doc_ids, self.lengths], "<i8")
        place = self._write(self.zstd.compress(docs.tobytes()))
        index = np.array(self.index, "<u8").reshape(-1, 2 + PLANES[self.kind])
        where = self._write(self.zstd.compress(index.tobytes()))
        self._write(_TRAILER.pack(*place, *where, PLANES[self.kind], MAGIC))
        return len(self.lengths), sum(self.lengths)


def any_set(plane: bytes) -> bool:
    return plane.count(0) != len(plane)


class IdReader:
    """Reads one file chunk by chunk; ``source`` can seek."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        place, length, index_at, index_length, planes, magic = _TRAILER.unpack(
            self._read(size - _TRAILER.size, _TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a file of id planes, or one cut short")
        self.kind = next(k for k, n in PLANES.items() if n == planes)
        self.zstd = zstandard.ZstdDecompressor()
        self.doc_ids, self.lengths = np.frombuffer(self.zstd.decompress(self._read(place, length)), "<i8").reshape(2, -1)
        index = self.zstd.decompress(self._read(index_at, index_length))
        self.index = np.frombuffer(index, "<u8").reshape(-1, 2 + planes).astype(np.int64)

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def chunk(self, i: int) -> np.ndarray:
        """The ids of one chunk; only its bytes are read."""
        at, n, *sizes = self.index[i].tolist()
        data, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.zstd.decompress(data[:size]) if size else b"")
            data = data[size:]
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Every document's id and ids, as bytes, in the order of the file."""
        held, next_chunk = b"", 0
        for doc_id, length in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            parts, missing = [], 4 * length
            while missing:
                if not held:
                    held = self.chunk(next_chunk).tobytes()
                    next_chunk += 1
                part, held = held[:missing], held[missing:]
                parts.append(part)
                missing -= len(part)
            yield None if doc_id == _NO_ID else doc_id, b"".join(parts)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


_FILES = "part int, path string, n_docs bigint, n_ids bigint"


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    kind: str = "byte",
    chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """Write the ids of all texts in ascending order of id; returns the list of files.

    Rows ``(part, path, n_docs, n_ids, start)``: files follow each other by
    ``part``, and ``start`` is the number of ids in all files before. A null or
    empty text has only the end id; a null id sorts first; rows with one id are
    in order of a hash of their text. An empty table gives no documents.
    ``folder`` must be one that all executors reach.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # The hash lets rows with one and the same id go to several files.
    order = ["doc_id", F.xxhash64("text")]
    in_order = docs.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_ids(tokenizer_path), end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{base}/{name}") as out:
            writer = IdWriter(out, kind, chunk_ids)
            for batch in slices(batches):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                    writer.add(doc_id, encode(text) + end)
            n_docs, n_ids = writer.finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([n_docs]), pa.array([n_ids])],
            ["part", "path", "n_docs", "n_ids"],
        )

    files = stored(in_order.mapInArrow(write, _FILES))
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(files: DataFrame) -> DataFrame:
    """The documents of files, ``(doc_id, start, ids)``: ids as bytes, ``start`` counted over all files."""
    n = max(1, files.count())
    one_each = files.select("part", "path", "start").repartitionByRange(n, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as source:
                    yield from _rows(IdReader(source), row["start"])

    return one_each.mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def _rows(reader: IdReader, start: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        doc_ids, starts, ids = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "start", "ids"],
        )

    for doc_id, ids in reader.documents():
        held.append((doc_id, start, ids))
        start += len(ids) // 4
        size += len(ids)
        if size >= SLICE_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return scratch_path(spark, "ids")
