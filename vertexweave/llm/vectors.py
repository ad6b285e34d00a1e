"""Near duplicates among vectors by sorted projection passes.

Random projections give every vector a string of bits. A pass sorts all vectors
by its own run of bits, and every vector is compared with the next few in that
order. What is compared is the vector itself, rounded to a byte a component:
how far that is off is known, so most pairs are settled on the spot, and the
few that are too close to call are looked up and computed in full. Links found
in any pass are united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.llm.minhash import components
from vertexweave.llm.workers import slices
from vertexweave.plans.skew import spread_lookup
from vertexweave.plans.storage import stored

# Sorted orders, and how many followers a vector is compared with in each.
PASSES, WINDOW = 8, 32
_SEED = 20011
_LEVELS = 127
# Room for rounding in sums of products.
_SLACK = 1e-9


def matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of list: the rows that have it and are whole, and their values as doubles.

    Whole are lists that are not null, not empty, and hold neither nulls nor values that are not finite.
    """
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values
    known = values.is_valid().to_numpy(zero_copy_only=False) if values.null_count else np.ones(len(values), bool)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    known &= np.isfinite(flat)
    begins = column.offsets.to_numpy()[:-1]
    present = column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[present & (sizes > 0)]):
        rows = np.flatnonzero(present & (sizes == size))
        at = begins[rows][:, None] + np.arange(size)
        rows_known = known[at].all(axis=1)
        yield rows[rows_known], flat[at[rows_known]]


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which rows have one: zeros have not."""
    most = np.abs(vectors).max(axis=1)
    some = most > 0
    scaled = vectors[some] / most[some, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None], some


def _keys(unit: np.ndarray, passes: int) -> np.ndarray:
    """64 signs of random projections for each pass, as integers."""
    planes = np.random.default_rng([_SEED, unit.shape[1]]).standard_normal((unit.shape[1], 64 * passes))
    return np.packbits(unit @ planes > 0, axis=1).view(">i8").astype(np.int64)


_SIGNED = "vec_id bigint, dim int, name1 bigint, name2 bigint, keys array<bigint>, coded binary, scale double, error double"


def _signed(vectors: DataFrame, passes: int) -> DataFrame:
    """Keys, a 128-bit name of the exact values, and the vector in bytes; none of that for vectors that link with nothing."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, n = batch.column("vec_id"), batch.num_rows
            dim, names, keys = np.zeros(n, np.int32), [None] * n, [None] * n
            coded, scale, error = [None] * n, np.zeros(n), np.zeros(n)
            for rows, values in matrix(batch.column("vector")):
                unit, some = _unit(values)
                rows = rows[some]
                step = np.abs(unit).max(axis=1, initial=0) / _LEVELS
                # Nothing to divide where no row is left.
                bytes_ = np.rint(unit / step[:, None]).astype(np.int8)
                off = np.sqrt(((unit - bytes_ * step[:, None]) ** 2).sum(axis=1))
                dim[rows], scale[rows], error[rows] = values.shape[1], step, off
                for i, row, key, whole in zip(rows, bytes_, _keys(unit, passes), values[some] + 0.0):
                    names[i] = np.frombuffer(hashlib.blake2b(whole.tobytes(), digest_size=16).digest(), np.int64)
                    keys[i], coded[i] = key, row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(dim), *[pa.array([None if x is None else int(x[j]) for x in names], pa.int64()) for j in (0, 1)],
                 pa.array(keys, pa.list_(pa.int64())), pa.array(coded, pa.binary()), pa.array(scale), pa.array(error)],
                ["vec_id", "dim", "name1", "name2", "keys", "coded", "scale", "error"],
            )

    return vectors.mapInArrow(sign, _SIGNED)


_FOUND = "kind int, a bigint, b bigint, part int, at bigint, turn int, dim int, coded binary, scale double, error double"


class _Window:
    """Rows in order, with what is needed to compare them."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        self.rows = rows
        self.id = rows.column("rep").to_numpy()
        self.group = np.stack([rows.column(c).to_numpy() for c in ("turn", "dim")], axis=1)
        self.scale, self.error = rows.column("scale").to_numpy(), rows.column("error").to_numpy()
        dims = self.group[:, 1]
        self.coded = np.zeros((len(dims), int(dims.max(initial=0))), np.float32)
        data = rows.column("coded").to_pylist()
        for dim in np.unique(dims):
            these = np.flatnonzero(dims == dim)
            self.coded[these, :dim] = np.frombuffer(b"".join(data[i] for i in these), np.int8).reshape(len(these), dim)

    def pairs(self, first: np.ndarray, step: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows ``first`` and those ``step`` behind: pairs that are or may be similar enough, and which of them are for sure."""
        second = first + step
        same = (self.group[first] == self.group[second]).all(axis=1)
        first, second = first[same], second[same]
        # Whole numbers below 2**24 for up to a thousand components; beyond, rounding is far below the error allowed.
        dot = np.einsum("ij,ij->i", self.coded[first], self.coded[second], dtype=np.float64)
        about = dot * self.scale[first] * self.scale[second]
        off = self.error[first] + self.error[second] + self.error[first] * self.error[second] + _SLACK
        maybe = about + off >= cosine
        return first[maybe], second[maybe], (about - off >= cosine)[maybe]


def _output(**columns) -> pa.RecordBatch:
    """Rows of ``_FOUND``, null where nothing is given."""
    types = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "part": pa.int32(), "at": pa.int64(), "turn": pa.int32(),
             "dim": pa.int32(), "coded": pa.binary(), "scale": pa.float64(), "error": pa.float64()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], list(types)
    )


_SURE, _MAYBE, _EDGE, _COUNT = 0, 1, 2, 3


def _compared(ordered: DataFrame, window: int, cosine: float) -> DataFrame:
    """Pairs within partitions; the rows near the ends of partitions, and how many rows each has."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, before = TaskContext.get().partitionId(), 0, None
        last: pa.Table | None = None
        for batch in slices(batches, 4 << 20):
            new = pa.Table.from_batches([batch])
            rows = pa.concat_tables([before, new]).combine_chunks() if before is not None else new
            old = len(rows) - len(new)
            w = _Window(rows)
            for step in range(1, min(window, len(rows) - 1) + 1):
                # Pairs whose second row is new.
                first = np.arange(max(0, old - step), len(rows) - step)
                x, y, sure = w.pairs(first, step, cosine)
                if len(x):
                    kind = np.where(sure, _SURE, _MAYBE)
                    a, b = np.minimum(w.id[x], w.id[y]), np.maximum(w.id[x], w.id[y])
                    yield _output(kind=kind, a=a, b=b)
            if seen < window:
                yield _edge(new.slice(0, window - seen), part, seen)
            seen += len(new)
            before = last = rows.slice(max(0, len(rows) - window))
        if last is not None:
            # Those already sent as first rows are not sent again.
            fresh = min(len(last), max(0, seen - window))
            yield _edge(last.slice(len(last) - fresh), part, seen - fresh)
        yield _output(kind=[_COUNT], part=[part], at=[seen])

    return ordered.mapInArrow(compare, _FOUND)


def _edge(rows: pa.Table, part: int, start: int) -> pa.RecordBatch:
    n = len(rows)
    columns = {c: rows.column(c).combine_chunks() for c in ("turn", "dim", "coded", "scale", "error")}
    return _output(
        kind=[_EDGE] * n, a=rows.column("rep").combine_chunks(), part=[part] * n, at=np.arange(start, start + n), **columns
    )


def _across(found: DataFrame, window: int, cosine: float) -> DataFrame:
    """The pairs on either side of an end of a partition, as if there were none."""
    # One number for each partition.
    counts = {r["part"]: r["at"] for r in found.where(F.col("kind") == _COUNT).select("part", "at").collect()}
    parts = sorted(counts)
    ends = np.cumsum([counts[p] for p in parts])
    start = dict(zip(parts, ends - [counts[p] for p in parts]))
    ends = np.unique(ends)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("at").to_numpy() + np.array([start[p] for p in batch.column("part").to_pylist()], np.int64)
            # Ends in (rank - window, rank + window]: those that this row is near.
            low, high = np.searchsorted(ends, rank - window, "right"), np.searchsorted(ends, rank + window, "right")
            which = np.repeat(np.arange(len(rank)), high - low)
            number = np.concatenate([ends[i:j] for i, j in zip(low, high)]) if len(rank) else np.zeros(0, np.int64)
            taken = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.astype(np.int64)), pa.array(rank[which]), taken.column("a"),
                 *[taken.column(c) for c in ("turn", "dim", "coded", "scale", "error")]],
                ["border", "rank", "rep", "turn", "dim", "coded", "scale", "error"],
            )

    def compare(key, rows):
        border = key[0].as_py()
        rows = rows.sort_by("rank")
        rank, w, out = rows.column("rank").to_numpy(), _Window(rows.combine_chunks()), []
        for step in range(1, min(window, len(rows) - 1) + 1):
            x, y, sure = w.pairs(np.arange(len(rows) - step), step, cosine)
            here = (rank[x] < border) & (rank[y] >= border) & (rank[y] - rank[x] <= window)
            kind = np.where(sure, _SURE, _MAYBE)[here]
            a, b = np.minimum(w.id[x], w.id[y])[here], np.maximum(w.id[x], w.id[y])[here]
            out.append(pa.table({"kind": pa.array(kind, pa.int32()), "a": a, "b": b}))
        return pa.concat_tables(out) if out else pa.table(
            {"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        )

    schema = "border bigint, rank bigint, rep bigint, turn int, dim int, coded binary, scale double, error double"
    near = found.where(F.col("kind") == _EDGE).select("a", "part", "at", "turn", "dim", "coded", "scale", "error")
    # At most two windows of rows to a border.
    return near.mapInArrow(place, schema).groupBy("border").applyInArrow(compare, "kind int, a bigint, b bigint")


def _exact(pairs: DataFrame, vectors: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """Those of the pairs whose cosine, in doubles, is large enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("vec_id")).distinct()
    named = _signed(vectors.join(ends, "vec_id", "left_semi"), 1).select("vec_id", "name1", "name2")
    known = stored(named.join(nodes.select(F.col("rep").alias("vec_id"), "name1", "name2"), ["vec_id", "name1", "name2"], "left_semi").distinct())
    if known.isEmpty():
        return pairs
    values = vectors.join(ends, "vec_id", "left_semi").dropDuplicates(["vec_id", "vector"])
    both = pairs.join(values.select(F.col("vec_id").alias("a"), F.col("vector").alias("va")), "a").join(
        values.select(F.col("vec_id").alias("b"), F.col("vector").alias("vb")), "b"
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = np.zeros(batch.num_rows, bool)
            units = [{}, {}]
            for side, column in enumerate(("va", "vb")):
                for rows, values in matrix(batch.column(column)):
                    unit, some = _unit(values)
                    units[side].update(zip(rows[some].tolist(), unit))
            for i in units[0].keys() & units[1].keys():
                x, y = units[0][i], units[1][i]
                keep[i] = len(x) == len(y) and float(x @ y) >= cosine
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return both.mapInArrow(confirm, "a bigint, b bigint").distinct()


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors found to have a ``cosine`` at least as large, in doubles, are
    linked. ``component_id`` is the smallest id reachable over links, the own
    one included, and a row is kept if that is its own. Vectors that are null,
    empty or zero, or hold nulls or values that are not finite, link with
    nothing, and so do vectors of different lengths with each other. Equal
    vectors are one class, compared once, and all linked. Of rows that repeat an
    id, one counts, the first by a digest of its values, and all get equal
    verdicts. A row without an id links with nothing, has no component and is
    kept. An empty table gives an empty result; other columns are not read.

    Sorting by (pass, bits, id) is a total order, and windows go on across the
    partitions it is kept in, so the links found do not depend on how many there
    are. Pairs with a cosine of 0.975 or more are found nearly always; those
    just above 0.95 may stay apart in a large table, unless others link them.
    """
    vectors = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    signed = stored(_signed(vectors, passes))
    rows = signed.where(F.col("vec_id").isNotNull())
    single = rows.groupBy("vec_id").agg(F.min(F.struct("name1", "name2")).alias("name"))
    single = stored(single.select("vec_id", "name.name1", "name.name2"))
    names = ["name1", "name2"]
    # One row for each class of equal vectors; its rows may be many, but are summed up where they are read.
    nodes = stored(single.where(F.col("name1").isNotNull()).groupBy(*names).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    shown = signed.where(F.col("name1").isNotNull()).select(F.col("vec_id").alias("rep"), *names, "dim", "keys", "coded", "scale", "error")
    first = nodes.join(shown.dropDuplicates(["rep", *names]), ["rep", *names])
    ordered = (
        first.select("rep", "dim", "coded", "scale", "error", F.posexplode("keys").alias("turn", "key"))
        .repartitionByRange("turn", "dim", "key", "rep")
        .sortWithinPartitions("turn", "dim", "key", "rep")
        .select("rep", "turn", "dim", "coded", "scale", "error")
    )
    found = stored(_compared(ordered, window, cosine))
    pairs = found.where(F.col("kind") <= _MAYBE).select("kind", "a", "b").unionByName(_across(found, window, cosine))
    pairs = stored(pairs.groupBy("a", "b").agg(F.min("kind").alias("kind")))
    links = pairs.where(F.col("kind") == _SURE).select("a", "b")
    open_pairs = stored(pairs.where(F.col("kind") == _MAYBE).select("a", "b"))
    if not open_pairs.isEmpty():
        links = links.unionByName(_exact(open_pairs, vectors, nodes, cosine))
    links = stored(links)
    labels = components(links)
    sizes = nodes.select("rep", "size")
    counted = (
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .join(sizes.select(F.col("rep").alias("b"), "size"), "b")
        .groupBy(F.col("a").alias("rep"))
        .agg(F.sum("size").alias("others"))
    )
    classes = stored(
        nodes.join(counted, "rep", "left")
        .join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(*names, (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"), "size")
    )
    found_rows = spread_lookup(
        single, classes.drop("size"), names, "vec_id", counts=classes.select(*names, F.col("size").cast("double").alias("_n"))
    ).select("vec_id", "n_links", "component")
    out = signed.select("vec_id").join(found_rows, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
