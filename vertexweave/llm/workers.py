"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa

# Bytes of Arrow data handled, and sent back, at a time.
SLICE_BYTES = 8 << 20
# Entries in each of the two halves of a memo.
MEMO_ENTRIES = 400_000
# Characters or bytes of a key that is remembered, at most: no entry is large, and longer ones hardly come again.
LONGEST_KEY = 256


class Memo(dict):
    """Results of a pure function of one key, computed on first use.

    Holds a bounded number of entries: when the young half is full, it becomes
    the old half and a new one begins. What is used again moves to the young
    half, so frequent keys stay. Texts longer than ``LONGEST_KEY`` are computed
    each time.
    """

    def __init__(self, make: Callable[[Hashable], object], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, (str, bytes)) and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def learn(self, keys: Iterable[Hashable], make_all: Callable[[list], list]) -> None:
        """Results of different texts in advance, of all that are not remembered at once."""
        new = []
        for key in keys:
            if key not in self and len(key) <= LONGEST_KEY:
                value = self.old.get(key)
                new.append(key) if value is None else self._keep(key, value)
        for key, value in zip(new, make_all(new), strict=True):
            self._keep(key, value)

    def _keep(self, key: Hashable, value: object) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into ones of about ``size`` bytes, one row at least, none of them empty.

    A worker is kept for the tasks to come, so what Arrow has freed goes back to the system at the end.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * size / max(size, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
