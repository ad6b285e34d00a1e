"""Hard negatives by an inverted multi-index.

Vectors are cut into halves, and each half has a codebook; a pair of codes is a
cell. What a vector can score with the members of a cell is bounded by the sum
of two half scores, each with the radius of its code. A heap visits the cells
of a query in order of that bound, and a search for the best rows within a
window of scores ends when no cell left can hold a better one: the result is
exact, whatever the codebooks are like.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vertexweave.llm.vectors import matrix
from vertexweave.llm.workers import slices
from vertexweave.plans.storage import stored

# Vectors that codebooks are fitted on, at most, those of the least hashes; rounds of fitting.
FIT_ROWS, _ROUNDS = 16_384, 8
# Rows of a cell, about, as long as a half has at most so many codes.
_CELL_ROWS, _MOST_CODES = 1000, 256
# Rows of a cell, and anchors, that are scored against each other in one group, about.
BLOCK_ROWS, CHUNK_ANCHORS = 8192, 1024
# Rows that a query visits in its first round, at least; four times as many in each round after it.
_FIRST_VISIT = 4096
_LARGEST = 1 << 62
_HASHES = 1 << 30


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, dim, ints)`` of rows that take part; components times ``scale``, rounded down, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, dims, data = [], [], []
            for at, values in matrix(batch.column("vector")):
                with np.errstate(over="ignore"):
                    ints = np.floor(scale * values)
                if len(ints) and np.abs(ints).max() >= 2**31:
                    raise ValueError("a component is too large for a 32-bit integer")
                rows.append(at)
                dims.append(np.full(len(at), ints.shape[1], np.int32))
                data += [x.tobytes() for x in ints.astype("<i4")]
            taken = batch.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            dim = np.concatenate(dims) if dims else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [taken.column("vec_id"), taken.column("label"), pa.array(dim), pa.array(data, pa.binary())],
                ["vec_id", "label", "dim", "ints"],
            )

    known = vectors.where("vec_id is not null and label is not null")
    return known.mapInArrow(run, "vec_id bigint, label bigint, dim int, ints binary")


def _ints(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all others, exactly."""
    bound = int(np.abs(rows).max(initial=0)) * int(np.abs(others).max(initial=0)) * rows.shape[1]
    if bound < 1 << 53:
        return (rows.astype(np.float64) @ others.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return rows @ others.T
    raise ValueError("scores are too large for 64-bit integers")


def _distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes * codes).sum(axis=1)
    return np.maximum(square, 0)


def _codebook(points: np.ndarray, n: int) -> np.ndarray:
    """Centres of ``n`` clusters, or of fewer if there are not so many different points."""
    codes = np.unique(points, axis=0)
    codes = codes[np.random.default_rng(7).permutation(len(codes))[:n]].astype(np.float64)
    for _ in range(_ROUNDS):
        nearest = _distances(points, codes).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, nearest, points)
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


@dataclass
class Codebooks:
    """Codes of both halves, the radius of each code, and the rows of each cell ``(first code, second code)``."""

    codes: list[np.ndarray]
    radii: list[np.ndarray]
    rows: np.ndarray

    def split(self, vectors: np.ndarray) -> list[np.ndarray]:
        half = self.codes[0].shape[1]
        return [vectors[:, :half].astype(np.float64), vectors[:, half:].astype(np.float64)]

    def visit(self, vector: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """All cells by the most that a member can score, as ``(most, least, first, second)``, best first."""
        order, most, least = [], [], []
        for part, codes, radii in zip(self.split(vector[None]), self.codes, self.radii):
            middle, reach = codes @ part[0], np.sqrt(part[0] @ part[0]) * radii
            # Room for rounding.
            reach = reach + 1e-6 * (1 + np.abs(middle) + reach)
            at = np.argsort(-(middle + reach), kind="stable")
            order.append(at)
            most.append((middle + reach)[at])
            least.append((middle - reach)[at])
        heap = [(-(most[0][0] + most[1][0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, least[0][i] + least[1][j], int(order[0][i]), int(order[1][j])
            # Every cell is reached in one way: along the second half, and along the first from its start.
            if j + 1 < len(most[1]):
                heapq.heappush(heap, (-(most[0][i] + most[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(most[0]):
                heapq.heappush(heap, (-(most[0][i + 1] + most[1][0]), i + 1, 0))


def _index(rows: DataFrame, n: int, dim: int) -> tuple[DataFrame, Codebooks]:
    """All rows with ``cell`` and ``block``, and the codebooks. What comes to the driver is bounded by the number of codes."""
    place = F.pmod(F.xxhash64("vec_id"), F.lit(_HASHES))
    near = rows.where(place < min(_HASHES, int(2 * FIT_ROWS / n * _HASHES) + 1)) if n > FIT_ROWS else rows
    sample = near.orderBy(place, "vec_id").limit(FIT_ROWS).select("ints").toArrow()
    points = _ints(sample.column("ints"), dim)
    size = min(_MOST_CODES, max(2, round((n / _CELL_ROWS) ** 0.5)))
    books = Codebooks([_codebook(points[:, : dim // 2], size), _codebook(points[:, dim // 2 :], size)], [], np.zeros(0))
    shared = rows.sparkSession.sparkContext.broadcast(books)
    across = len(books.codes[1])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nearest, far = [], []
            for part, codes in zip(shared.value.split(_ints(batch.column("ints"), dim)), shared.value.codes):
                at = _distances(part, codes).argmin(axis=1)
                nearest.append(at)
                far.append(np.sqrt(((part - codes[at]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("vec_id", "label", "ints")]
                + [pa.array((nearest[0] * across + nearest[1]).astype(np.int32)), pa.array(far[0]), pa.array(far[1])],
                ["vec_id", "label", "ints", "cell", "far1", "far2"],
            )

    coded = stored(rows.mapInArrow(code, "vec_id bigint, label bigint, ints binary, cell int, far1 double, far2 double"))
    cells = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect()
    books.rows = np.zeros((len(books.codes[0]), across), np.int64)
    books.radii = [np.zeros(len(codes)) for codes in books.codes]
    for r in cells:
        i, j = divmod(r["cell"], across)
        books.rows[i, j] = r["n"]
        books.radii[0][i] = max(books.radii[0][i], r["far1"])
        books.radii[1][j] = max(books.radii[1][j], r["far2"])
    blocks = -(-books.rows.ravel() // BLOCK_ROWS)
    blocks = np.maximum(blocks, 1)
    # A literal list as long as there are cells.
    many = {int(c): int(blocks[c]) for c in np.flatnonzero(blocks > 1)}
    n_blocks = F.lit(1)
    if many:
        listed = F.create_map(*[F.lit(x) for item in many.items() for x in item])
        n_blocks = F.coalesce(listed[F.col("cell")], F.lit(1))
    return coded.select("vec_id", "label", "ints", "cell", F.pmod(F.hash("vec_id"), n_blocks).alias("block")), books


_WINDOWS = "array<struct<wid:bigint,low:bigint,high:bigint,same:boolean,worst:bigint>>"
_STATE = f"anchor_id bigint, label bigint, ints binary, visited int, windows {_WINDOWS}"


def _visits(state: DataFrame, books: Codebooks, dim: int, rows: int, chunks: int) -> DataFrame:
    """The cells, block by block, that every query visits next; none for those whose windows are all certified."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    schema = f"{_STATE}, cell int, block int"

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        across = books.rows.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, windows = _ints(batch.column("ints"), dim), batch.column("windows").to_pylist()
            visited = batch.column("visited").to_pylist()
            owner, cell, block, until = [], [], [], []
            for q, vector in enumerate(vectors):
                # What a window still needs: more than its lower end, and no less than the worst it has.
                needs = [w["low"] if w["worst"] is None else max(w["low"], w["worst"]) for w in windows[q]]
                taken, last, mine = 0, visited[q], []
                for k, (most, least, i, j) in enumerate(books.visit(vector)):
                    wanted = [w for w, need in zip(windows[q], needs) if most >= need]
                    if not wanted or taken >= rows:
                        break
                    if k < visited[q]:
                        continue
                    last = k + 1
                    n = int(books.rows[i, j])
                    if n and any(least <= w["high"] for w in wanted):
                        taken += n
                        mine += [(i * across + j, b) for b in range(max(1, -(-n // BLOCK_ROWS)))]
                for c, b in mine:
                    owner.append(q)
                    cell.append(c)
                    block.append(b)
                    until.append(last)
            some = batch.take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [some.column("anchor_id"), some.column("label"), some.column("ints"), pa.array(until, pa.int32()),
                 some.column("windows"), pa.array(cell, pa.int32()), pa.array(block, pa.int32())],
                ["anchor_id", "label", "ints", "visited", "windows", "cell", "block"],
            )

    visits = state.mapInArrow(plan, schema)
    return visits.withColumn("chunk", F.pmod(F.hash("anchor_id"), F.lit(chunks)))


def _scored(index: DataFrame, visits: DataFrame, dim: int, first: int) -> DataFrame:
    """``(anchor_id, wid, vec_id, score)``: the first rows of every window in each block visited."""
    units = visits.select("cell", "block", F.col("chunk").alias("part")).distinct()
    members = index.join(units, ["cell", "block"])
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "wid", "vec_id", "score")])

    def score(rows, queries):
        out = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("vec_id")
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            scores = _products(_ints(queries.column("ints"), dim), _ints(rows.column("ints"), dim))
            anchors, own = queries.column("anchor_id").to_pylist(), queries.column("label").to_pylist()
            for q, windows in enumerate(queries.column("windows").to_pylist()):
                # Stable: of equal scores the smaller id comes first.
                order = np.argsort(-scores[q], kind="stable")
                alike = labels[order] == own[q]
                for same in (True, False):
                    mine = [w for w in windows if w["same"] == same]
                    if not mine:
                        continue
                    listed = order[alike & (ids[order] != anchors[q])] if same else order[~alike]
                    down = -scores[q][listed]
                    for w in mine:
                        begin = np.searchsorted(down, -w["high"], "left")
                        end = min(begin + first, np.searchsorted(down, -w["low"], "right"))
                        for at in listed[begin:end]:
                            for column, value in zip(out, (anchors[q], w["wid"], ids[at], scores[q][at])):
                                column.append(int(value))
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=schema)

    asked = visits.select("anchor_id", "label", "ints", "windows", "cell", "block", "chunk")
    return members.groupBy("cell", "block", "part").cogroup(asked.groupBy("cell", "block", "chunk")).applyInArrow(
        score, "anchor_id bigint, wid bigint, vec_id bigint, score bigint"
    )


def _first(found: DataFrame, first: int) -> DataFrame:
    """The first rows of every window, with ``rank``."""
    order = Window.partitionBy("anchor_id", "wid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def _search(index: DataFrame, books: Codebooks, queries: DataFrame, dim: int, first: int, chunks: int) -> DataFrame:
    """The first rows of every window of all queries, exactly. Each round visits further cells, and drops what is certified."""
    state = stored(queries)
    spark = index.sparkSession
    found = spark.createDataFrame([], "anchor_id bigint, wid bigint, vec_id bigint, score bigint, rank int")
    rows = _FIRST_VISIT
    while True:
        visits = stored(_visits(state, books, dim, rows, chunks))
        if visits.isEmpty():
            return found
        new = _scored(index, visits, dim, first)
        found = stored(_first(found.drop("rank").unionByName(new), first))
        worst = found.where(F.col("rank") == first).select("anchor_id", "wid", F.col("score").alias("worst"))
        going = visits.groupBy("anchor_id").agg(F.max("visited").alias("visited"))
        w = F.col("w")
        windows = (
            state.select("anchor_id", F.explode("windows").alias("w"))
            .select("anchor_id", w["wid"].alias("wid"), w["low"].alias("low"), w["high"].alias("high"), w["same"].alias("same"))
            .join(worst, ["anchor_id", "wid"], "left")
            .groupBy("anchor_id")
            .agg(F.collect_list(F.struct("wid", "low", "high", "same", "worst")).alias("windows"))
        )
        state = stored(
            state.select("anchor_id", "label", "ints").join(going, "anchor_id").join(windows, "anchor_id")
            .select("anchor_id", "label", "ints", "visited", "windows")
        )
        rows *= 4


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows where ``is_anchor``.

    Components times ``scale`` are rounded down, and a score is the inner
    product of the integers. An anchor's positives are the ``positives`` other
    rows of its label with the highest scores; of each, the negatives are the
    first ``negatives`` rows of other labels that score between ``low_percent``
    and ``high_percent`` of it. Equal scores go by the smaller id. All of it is
    exact; the cells only save work.

    Rows with a null id or label, a vector that is null, empty, or holds nulls
    or values that are not finite, and those of another length than most
    (of equally many, the longer) take no part. Of rows that repeat an id, one
    counts, the least by label and integers. An empty table, or one without
    anchors, gives an empty result. Components and scores that integers of 32
    and 64 bits cannot hold fail the job. Other columns are not read, but by ``is_anchor``.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    ids = rows.where("is_anchor").select(F.col("vec_id").alias("anchor_id")).distinct()
    known = stored(_whole(rows.select("vec_id", "label", "vector"), scale))
    sizes = known.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    result = (
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    if not sizes:
        return vectors.sparkSession.createDataFrame([], result)
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    known = known.where(F.col("dim") == dim).drop("dim")
    again = stored(known.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if not again.isEmpty():
        least = known.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("row"))
        known = known.join(again, "vec_id", "left_anti").unionByName(least.select("vec_id", "row.label", "row.ints"))
        known = stored(known)
    index, books = _index(known, n, dim)
    anchors = stored(known.select(F.col("vec_id").alias("anchor_id"), "label", "ints").join(ids, "anchor_id", "left_semi"))
    chunks = max(1, -(-anchors.count() // CHUNK_ANCHORS))

    def window(wid: Column, low: Column, high: Column, same: bool) -> Column:
        return F.struct(
            wid.alias("wid"), low.alias("low"), high.alias("high"), F.lit(same).alias("same"),
            F.lit(None).cast("bigint").alias("worst"),
        )

    every = window(F.lit(0).cast("bigint"), F.lit(-_LARGEST), F.lit(_LARGEST), True)
    alike = anchors.select("anchor_id", "label", "ints", F.lit(0).alias("visited"), F.array(every).alias("windows"))
    best = _search(index, books, alike, dim, positives, chunks).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    best = stored(best)
    least, most = f"({low_percent} * positive_score)", f"({high_percent} * positive_score)"
    # Hundredths, rounded up and down.
    low, high = F.expr(f"({least} + pmod(-{least}, 100)) div 100"), F.expr(f"({most} - pmod({most}, 100)) div 100")
    windows = (
        best.select("anchor_id", "positive_id", low.alias("low"), high.alias("high"))
        .where("low <= high")
        .groupBy("anchor_id")
        .agg(F.collect_list(window(F.col("positive_id"), F.col("low"), F.col("high"), False)).alias("windows"))
    )
    unlike = anchors.join(windows, "anchor_id").select("anchor_id", "label", "ints", F.lit(0).alias("visited"), "windows")
    worst = _search(index, books, unlike, dim, negatives, chunks)
    return worst.withColumnRenamed("wid", "positive_id").join(best, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
