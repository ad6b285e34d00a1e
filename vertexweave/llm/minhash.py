"""Near duplicates by one-permutation MinHash.

Each text becomes its set of word shingles. One hash function deals the set
over the bins of a signature, and empty bins borrow from others by optimal
densification. Bands of bins name buckets; in each bucket, one star of
candidate edges goes from the member that is in the fullest buckets to the
others, so a bucket of m yields m - 1 pairs. Every candidate is confirmed on the full sets.

A star alone could lose links between members that are not linked with its
centre. Those members, outside the main component of a bucket, are met again
by their rarest shingles: a text that is linked with one of n shingles must
have one of any n / 5 + 1 of them, whichever those are. Each such shingle has
stars of its own, from centres that differ from shingle to shingle. The pairs of
a star are no more than its members, so pairs grow with the texts and not with
the square of a group; a link that no star has is lost, unless others make it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.llm.exact import SUPPORT
from vertexweave.llm.frames import id_and_text
from vertexweave.llm.workers import Memo, slices
from vertexweave.plans.skew import spread_lookup
from vertexweave.plans.storage import stored

BANDS, ROWS = 32, 4
# Word hashes that a task remembers, in each half of its memo.
_WORDS = 100_000
# Bytes of texts handled at a time.
_SLICE = 2 << 20
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Rounds after which an open densification walk is cut short by taking the nearest filled bin.
_WALK = 4096


@dataclass(frozen=True)
class Similarity:
    """``shingle`` words make a shingle; texts are linked from ``percent`` % of shared shingles up."""

    shingle: int = 5
    percent: int = 80


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str | None, memo: Memo, shingle: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles; none without words, one for fewer words than a shingle has."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    found = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        found = _mixed(found * _MIX1 + hashes[i : len(words) - k + 1 + i])
    return np.unique(found)


def _donors(bins: int) -> np.ndarray:
    """For every bin, the order in which it asks others when it is empty: ``[walk step, bin]``, the same everywhere."""
    step, bin_ = np.meshgrid(np.arange(_WALK, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (_mixed(_mixed(bin_ + _MIX2) + step * _MIX1) % np.uint64(bins)).astype(np.int16)


def signature(shingles: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """The least hash in every bin; an empty bin takes that of the first filled bin on its own walk."""
    bins = donors.shape[1]
    mixed = _mixed(shingles + _MIX2)
    place = (mixed % np.uint64(bins)).astype(np.int64)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, mixed)
    filled = np.zeros(bins, bool)
    filled[place] = True
    source = np.arange(bins)
    empty = np.flatnonzero(~filled)
    step = 0
    while len(empty) and step < _WALK:
        asked = donors[step, empty]
        hit = filled[asked]
        source[empty[hit]] = asked[hit]
        empty = empty[~hit]
        step += 1
    if len(empty):
        source[empty] = np.flatnonzero(filled)[0]
    return least[source]


def _bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * _MIX1 + rows[:, i])
    return key.view(np.int64)


def _sketch(values: np.ndarray) -> np.ndarray:
    mixed = _mixed(values)
    planes = [np.packbits(((mixed >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in (7, 23)]
    return np.concatenate(planes).view(np.int64)


_SIGNED = "doc_id bigint, n_shingles bigint, set_id bigint, set_id2 bigint, bands array<bigint>, sketch array<bigint>"


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """Set size, a 128-bit name of the set, bands and sketch of every text; empty sets have no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, donors = Memo(_word_hash, _WORDS), _donors(BANDS * ROWS)
        nothing = np.empty(0, np.int64)
        for batch in slices(batches, _SLICE):
            sizes, names, bands, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, memo, shingle)
                sizes.append(len(found))
                names.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                values = signature(found, donors) if len(found) else None
                bands.append(nothing if values is None else _bands(values))
                sketches.append(nothing if values is None else _sketch(values))
            names = np.stack(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "set_id2", "bands", "sketch"],
            )

    return docs.mapInArrow(sign, _SIGNED)


# Bits of a filter for each id in it, and the most that one has: 32 MB.
_BITS_PER_ID, _MOST_BITS = 16, 1 << 28
# Bits of a bitmap that Spark builds in one group.
_BITMAP = 1 << 15


def _filter_bits(n: int) -> int:
    """A power of two with room for ``n`` values, as far as the bound allows."""
    bits = _BITMAP
    while bits < min(_BITS_PER_ID * n, _MOST_BITS):
        bits *= 2
    return bits


def _bitmap(values: Column, frame: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of the values, which are below ``bits``; made by tasks, a group for every 32,768 bits."""
    at = (values + 1).alias("at")
    parts = (
        frame.select(at)
        .groupBy(F.bitmap_bucket_number("at").alias("number"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    packed = np.zeros(bits // 8, np.uint8)
    for row in parts:
        start = (row["number"] - 1) * (_BITMAP // 8)
        packed[start : start + _BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return packed


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """The full shingle sets, ``(doc_id, shingles)``, of the texts with the given ids, and of a few others.

    A filter of bounded size picks the texts where they are read, so that only
    sets go on to a shuffle. It lets others pass, the more the more ids there
    are; who joins with the ids drops those.
    """
    bits = _filter_bits(ids.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(place, ids, bits))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, packed = Memo(_word_hash, _WORDS), shared.value
        for batch in slices(batches, _SLICE):
            batch = batch.filter(pa.array(_has(packed, batch.column("place").to_numpy())))
            if batch.num_rows:
                found = [shingle_set(t, memo, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"]
                )

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", place.alias("place"))
    return known.mapInArrow(collect, "doc_id bigint, shingles array<bigint>")


def _near(percent: int) -> Column:
    """Whether a pair may be similar enough, by set sizes (exactly) and by sketch."""
    differ = [
        F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i]).bitwiseOR(
            F.col("x.sketch")[i + 2].bitwiseXOR(F.col("y.sketch")[i + 2])
        )
        for i in range(2)
    ]
    fields = BANDS * ROWS - F.bit_count(differ[0]) - F.bit_count(differ[1])
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    return (100 * small >= percent * large) & (fields >= _least_fields(percent))


def _least_fields(percent: int) -> int:
    """Seven deviations below the mean of shared two-bit fields at the least similarity, 80 of 128 for 80 %."""
    share = percent / 100 + (1 - percent / 100) / 4
    bins = BANDS * ROWS
    return int(bins * share - 7 * (bins * share * (1 - share)) ** 0.5)


def _confirmed(pairs: DataFrame, docs: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough. Sets are made anew, of texts in some pair only."""
    pairs = stored(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(_sets(docs, stored(needed), similarity.shingle))
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("bigint"))
    )
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return stored(both.where(100 * F.col("shared") >= similarity.percent * union).select("a", "b").distinct())


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for every end of a link ``(a, b)``: the smallest node that can be reached.

    Each round hands every node the least label among its own, its
    neighbours' and those labels' own labels; the labels are written down
    after each round, so lineage stays short. ``links`` should be stored.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        met = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .select(F.col("a").alias("node"), F.col("component"))
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("component").alias("component"))
        )
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        old = labels.withColumnRenamed("component", "before")
        new = stored(
            met.join(further, "component", "left")
            .select("node", F.least("component", F.coalesce("beyond", "component")).alias("component"))
            .join(old, "node")
        )
        changed = not new.where("component <> before").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity = Similarity()
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without white space, A-Z in lower case. Texts with fewer
    words than a shingle have their whole sequence as the one shingle; texts
    without words have none and are linked with nothing. ``component_id`` is
    the smallest id reachable over links, the own one included, and a row is
    kept if that is its own. Repeated rows with one id get equal verdicts. A
    row without an id is linked with nothing, gets no component and is kept.
    An empty table gives an empty result; other columns are not read.

    Texts with the same set are one class, stood for by its smallest id, and
    only that one is compared. Shingles are compared by 64-bit hashes. A pair
    with similarity 0.8 shares no bucket with a probability of 5e-8, and less
    than two with one of 1e-6. That a link is not at a centre of any star is
    left to measurement: the tests hold the result against all pairs.
    """
    every = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    docs, repeated = _one_text_each(every)
    rows = stored(_signed(docs, similarity.shingle))
    classes = _classes(rows)
    members = stored(
        classes.where(F.col("doc_id") == F.col("rep")).select("rep", "n_shingles", "bands", "sketch").dropDuplicates(["rep"])
    )
    shared = stored(_shared_buckets(members))
    pairs = stored(_star_pairs(shared, members, similarity))
    # One centre per text settles most; other centres are asked where the two are still apart.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    links = _confirmed(best, docs, similarity)
    labels = components(links)
    for further in (_open_stars, _residual_pairs):
        more = _confirmed(further(pairs, shared, members, labels, docs, similarity), docs, similarity)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    thin = classes.select("doc_id", "n_shingles", "rep")
    out = thin.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    verdicts = out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
    if repeated is None:
        return verdicts
    # As many rows for an id as it had.
    copies = verdicts.join(repeated, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)))))
    return copies.select(verdicts.columns)


def _one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the first text of every id, and ``(doc_id, rows)`` of repeated ids; None if there are none."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    repeated = stored(ids.where("rows > 1"))
    if repeated.isEmpty():
        return docs, None
    # No id is null here, and a null text comes first.
    order = F.struct(F.col("text").isNotNull().alias("some"), "text")
    one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(order)["text"].alias("text"))
    return docs.join(repeated, "doc_id", "left_anti").unionByName(one), repeated


def _classes(rows: DataFrame) -> DataFrame:
    """Rows with ``rep``, the smallest id with the same set; a frequent set's is broadcast, not shuffled."""
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    single = rows.where(alone).withColumn("rep", F.col("doc_id"))
    sets = rows.where(~alone)
    names = ["set_id", "set_id2"]
    frequent = sets.freqItems(["set_id"], SUPPORT).select(F.explode("set_id_freqItems").alias("set_id")).distinct()
    least = F.min("doc_id").alias("rep")
    # At most 1 / SUPPORT rows.
    heavy = stored(sets.join(F.broadcast(frequent), "set_id", "left_semi").groupBy(*names).agg(least))
    marked = sets.join(F.broadcast(heavy), names, "left")
    rest = marked.where(F.col("rep").isNull()).drop("rep")
    found = rest.groupBy(*names).agg(least, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rest = rest.join(found, names, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    together = [single, marked.where(F.col("rep").isNotNull()), rest]
    return stored(together[0].unionByName(together[1]).unionByName(together[2]))


def _shared_buckets(members: DataFrame) -> DataFrame:
    """``(bucket, rep, weight, a, members)`` of buckets with more than one member.

    ``weight`` is how many members the buckets of a text have together. It is
    greatest in the middle of a group of near copies, so the centre ``a`` of a
    bucket is its member of the greatest weight, of equal ones the smallest.
    """
    buckets = members.select("rep", F.explode("bands").alias("bucket"))
    sizes = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    counts = sizes.select("bucket", F.col("members").cast("double").alias("_n"))
    # The table comes out of an aggregate, so Spark would leave a hot bucket in one task.
    shared = stored(spread_lookup(buckets, sizes, "bucket", "rep", _ROWS_PER_TASK, counts).where("members is not null"))
    weights = shared.groupBy("rep").agg(F.sum("members").alias("weight"))
    shared = stored(shared.join(weights, "rep"))
    centres = stored(shared.groupBy("bucket").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("a")))
    return spread_lookup(shared, centres, "bucket", "rep", _ROWS_PER_TASK, counts)


def _star_pairs(shared: DataFrame, members: DataFrame, similarity: Similarity) -> DataFrame:
    """``(a, b, n)``: pairs with the centre of ``n`` buckets, that may be similar enough."""
    star = shared.where("a <> rep").groupBy("a", F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return _sketched(star, members, similarity)


def _open_stars(pairs, shared, members, labels, docs, similarity: Similarity) -> DataFrame:
    """Pairs with a centre that are in two components."""
    ends = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    others = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(ends, "a", "left").join(others, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _sketched(pairs: DataFrame, members: DataFrame, similarity: Similarity) -> DataFrame:
    side = members.select("rep", F.struct("n_shingles", "sketch").alias("s"))
    return (
        pairs.join(side.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a")
        .join(side.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
        .where(_near(similarity.percent))
        .drop("x", "y")
    )


def _residual_pairs(pairs, shared, members, labels, docs, similarity: Similarity) -> DataFrame:
    """Pairs in one bucket but in two components, at least one of them outside the bucket's largest component,
    that may be linked. Buckets of two are settled by their star. Two texts meet in several others if they are
    linked: with similarity 0.8, one pair in a million in less than two. So only texts in two mixed buckets
    or more are looked at, which leaves out those that share no more than a passage."""
    sizes = members.select("rep", "n_shingles", "sketch")
    there = stored(
        shared.where("members > 2")
        .select("bucket", "rep", "weight")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    mixed = (
        there.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket")
        .agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .drop("parts")
    )
    there = stored(there.join(mixed, "bucket"))
    often = there.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    there = stored(there.join(often, "rep", "left_semi").join(sizes, "rep"))
    outside = there.where(F.col("component") != F.col("main"))
    found = _by_rare_shingles(there, outside, docs, similarity).distinct()
    return stored(_sketched(found, members, similarity))


# Stars of each group, beside that of its member of the greatest weight.
_STARS = 1


def _stars(askers: DataFrame, others: DataFrame, key: list[str], similarity: Similarity) -> DataFrame:
    """Pairs ``(a, b)`` of different components and like sizes that have the centre of a group at one end.

    A group is the askers and the others with one ``key``. Its centres are its
    member of the greatest weight, and the askers that hash least together with
    the key: these differ from group to group, and a pair that shares several
    small groups has one of them for centre in some. Rows of a large group are
    spread over tasks.
    """
    names = [*key, "rep", "component", "n_shingles", "weight"]
    me = F.struct("rep", "component", "n_shingles")
    centres = [F.min_by(me, F.struct(F.xxhash64("rep", *key, F.lit(star)), "rep")) for star in range(_STARS)]
    asked = askers.groupBy(*key).agg(F.array(*centres).alias("centres"))
    rows = stored(askers.select(*names).unionByName(others.select(*names)))
    middle = rows.groupBy(*key).agg(
        F.max_by(me, F.struct("weight", -F.col("rep"))).alias("middle"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    chosen = stored(
        asked.join(middle, key).select(*key, F.array_distinct(F.array_append("centres", F.col("middle"))).alias("centres"), "_n")
    )
    met = spread_lookup(rows, chosen.drop("_n"), key, "rep", _ROWS_PER_TASK, chosen.select(*key, "_n")).select(
        "rep", "component", "n_shingles", F.explode("centres").alias("c")
    )
    small, large = F.least("n_shingles", "c.n_shingles"), F.greatest("n_shingles", "c.n_shingles")
    alike = 100 * small >= similarity.percent * large
    return met.where((F.col("component") != F.col("c.component")) & alike).select(
        F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")
    )


# Rows of one group that look their centres up in one task.
_ROWS_PER_TASK = 100_000


# Shingles fall into this many counters for their frequency; any order of them would do, a rough one saves pairs.
_COUNTERS = 1 << 18


def _by_rare_shingles(there: DataFrame, outside: DataFrame, docs: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs of a text outside and another one, met by the rarest shingles of the first.

    If a text of n shingles is linked, the other one has at least ``percent`` %
    of the n. So of one shingle more than may be missing, taken anyhow, the
    other has one, whatever its size.
    """
    nodes = stored(there.select(F.col("rep").alias("doc_id"), "component", "n_shingles", "weight").distinct())
    sets = stored(_sets(docs, nodes, similarity.shingle).join(nodes.select("doc_id"), "doc_id", "left_semi"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_counter(_flat(batch)[0]), minlength=_COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])

    # At most _COUNTERS rows.
    counted = sets.mapInArrow(count, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(_COUNTERS, np.int64)
    frequency[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rare = [], []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("shingles")):
                found = found.values.to_numpy()
                k = (100 - similarity.percent) * len(found) // 100 + 1
                few = found[np.argsort(shared.value[_counter(found)], kind="stable")[:k]]
                rare.append(few)
                ids.append(np.full(len(few), doc_id, np.int64))
            ids, rare = np.concatenate(ids), np.concatenate(rare)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rare)], ["a", "shingle"])

    apart = outside.select(F.col("rep").alias("doc_id")).distinct()
    rare = stored(sets.join(apart, "doc_id", "left_semi").mapInArrow(rarest, "a bigint, shingle bigint"))
    # Which shingles are asked for, and a few others.
    bits = _filter_bits(rare.count())
    asked = _bitmap(F.col("shingle").bitwiseAND(bits - 1), rare, bits)
    shared_asked = docs.sparkSession.sparkContext.broadcast(asked)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = _flat(batch)
            hit = _has(shared_asked.value, found & np.int64(bits - 1))
            ids = batch.column("doc_id").to_numpy()[owner[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[hit])], ["b", "shingle"])

    answers = sets.mapInArrow(answer, "b bigint, shingle bigint")
    texts = nodes.withColumnRenamed("doc_id", "rep")
    askers = rare.withColumnRenamed("a", "rep").join(texts, "rep")
    others = answers.withColumnRenamed("b", "rep").join(texts, "rep")
    return _stars(askers, others, ["shingle"], similarity)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return shingles & np.int64(_COUNTERS - 1)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch, and the row of each."""
    lists = batch.column("shingles")
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity = Similarity()
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, similarity)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("dropped_doc_id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["dropped_doc_id"], "left_anti")
