"""Packing documents into sequences of a fixed number of tokens, harmonically.

A piece of length ``n`` belongs to class ``k`` = capacity // n, and a sequence
of class ``k`` takes exactly ``k`` pieces of its class, in whatever order they
come. So workers fill sequences without knowing of each other. A document may
be cut: a length that would leave a gap in its class gives up the largest part
that fills its class exactly, ``capacity // (k + 1)``, until the rest fits
well. The parts shrink with the square, so few cuts are made.

What is left in unfinished sequences of the workers is numbered through, class
by class, and filled by the same rule. What then remains, fewer than ``k``
pieces per class, has a size that depends on the capacity alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vertexweave.llm.frames import id_and_text
from vertexweave.llm.tokens import word_ids
from vertexweave.llm.workers import slices, texts
from vertexweave.plans.storage import stored

CAPACITY = 2048
END_ID = 1
# A sequence may be left unfilled by this part of its capacity before a document is cut for it.
GAP = 1 / 64
# Bytes of texts handled at a time.
_SLICE = 2 << 20

# Sequence numbers: those of workers hold the task and a count, the others start beyond them.
_TASK_BITS = 36
_NUMBERED = 1 << 61
_CLASS_BITS = 44
_LAST = 1 << 62


def cuts(length: int, capacity: int = CAPACITY, gap: float = GAP) -> list[int]:
    """The lengths of the pieces of a document, in order; they sum to its length."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k * rest >= capacity * (1 - gap):
            pieces.append(rest)
            break
        part = capacity // (k + 1)
        pieces.append(part)
        rest -= part
    return pieces


_PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int,"
    " sequence_id bigint, offset bigint, task bigint, place bigint"
)


class _Bins:
    """The open sequence of every class in one task. Pieces of a sequence that is not finished have no sequence."""

    def __init__(self, task: int, capacity: int):
        self.next, self.capacity, self.open = task << _TASK_BITS, capacity, {}

    def add(self, row: list, length: int, done: list[list]) -> None:
        k = self.capacity // length
        rows = self.open.setdefault(k, [])
        rows.append([*row, k])
        if len(rows) == k:
            self.finish(rows, done)
            del self.open[k]

    def finish(self, rows: list[list], done: list[list]) -> None:
        offset = 0
        for row in rows:
            done.append([*row, self.next, offset, None, None])
            offset += row[2]
        self.next += 1

    def left(self, task: int) -> list[list]:
        return [[*row, None, None, task, i] for rows in self.open.values() for i, row in enumerate(rows)]


def _pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, gap: float) -> DataFrame:
    names = [c.split()[0] for c in _PIECE.split(",")]
    types = [pa.int32() if n == "class" else pa.int64() for n in names]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode, bins, end = word_ids(tokenizer_path), _Bins(task, capacity), end_id.to_bytes(4, "little")
        lengths = {}
        for batch in slices(batches, _SLICE):
            done = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                ids = encode(text) + end
                total, start = len(ids) // 4, 0
                if total < 4 * capacity:
                    if total not in lengths:
                        lengths[total] = cuts(total, capacity, gap)
                    pieces = lengths[total]
                else:
                    pieces = cuts(total, capacity, gap)
                for length in pieces:
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    bins.add([doc_id, start, length, crc, total], length, done)
                    start += length
            yield batch_of(done)
        yield batch_of(bins.left(task))

    return docs.mapInArrow(cut, _PIECE)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    gap: float = GAP,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text has only the end id. Rows with a null or repeated id
    are packed like others, each by itself. Sequence numbers are unique, not
    dense. An empty table gives an empty result; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # Tokens are made once; what follows reads a few numbers per piece.
    pieces = stored(_pieces(docs, tokenizer_path, end_id, capacity, gap))
    finished = pieces.where(F.col("sequence_id").isNotNull())
    numbered = stored(_numbered(pieces.where(F.col("sequence_id").isNull())))
    by_class = numbered.where("number < full").withColumn(
        "sequence_id", F.lit(_NUMBERED) + F.col("class") * (1 << _CLASS_BITS) + F.floor(F.col("number") / F.col("class"))
    )
    slot = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    by_class = by_class.withColumn("offset", F.sum("length").over(slot) - F.col("length"))
    last = _last(numbered.where("number >= full"), capacity)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return finished.select(*columns).unionByName(by_class.select(*columns)).unionByName(last.select(*columns))


def _numbered(left: DataFrame) -> DataFrame:
    """Add ``number`` of a piece in its class, over all tasks, and ``full``, how many of the class fill whole sequences.

    Only the counts of pieces per task and class meet; the pieces stay where they are.
    """
    counts = left.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(
        "class", "task",
        (F.sum("n").over(before) - F.col("n")).alias("first"),
        F.sum("n").over(Window.partitionBy("class")).alias("in_class"),
    )
    return left.join(starts, ["class", "task"]).select(
        *left.columns,
        (F.col("first") + F.col("place")).alias("number"),
        (F.col("in_class") - F.col("in_class") % F.col("class")).alias("full"),
    )


def _last(rest: DataFrame, capacity: int) -> DataFrame:
    """First fit, longest first, of fewer than ``k`` pieces of each class ``k``: about 10,000 at capacity 2048."""
    schema = to_arrow_schema(rest.schema)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda r: (-r["length"], r["class"], r["number"]))
        used: list[int] = []
        first = 0
        for row in rows:
            while first < len(used) and used[first] == capacity:
                first += 1
            at = next((i for i in range(first, len(used)) if used[i] + row["length"] <= capacity), len(used))
            if at == len(used):
                used.append(0)
            row["sequence_id"], row["offset"] = _LAST + at, used[at]
            used[at] += row["length"]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # The rows are picked where they are, and only those picked meet.
    return rest.repartition(1).mapInArrow(fit, rest.schema)

