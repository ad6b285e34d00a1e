"""Collocations by dynamic itemset counting.

Documents are dealt to shards, which are scanned in turn, round after round.
Words are counted from the start. A longer phrase is counted once both phrases
that it is made of have reached the threshold in what was scanned so far, from
the next shard on, and through one full round of shards: so it is counted in
every shard once, and lengths are counted side by side in one scan instead of
one after the other.

These counts are by hash, and phrases are not listed beforehand: a task counts
those it meets whose parts are in bit filters of bounded size. Both can only
add to a count. So all frequent phrases are among those that reach the
threshold, and a last scan counts these, spelled out, exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from vertexweave.llm.minhash import _bitmap, _filter_bits, _has, _mixed
from vertexweave.llm.workers import SLICE_BYTES, slices
from vertexweave.plans.storage import scratch_path, stored

UNKNOWN = "und"
# Occurrences that a phrase has at least, and shards of the documents.
THRESHOLD, SHARDS = 10, 2
# Phrases listed for each language.
TOP = 2000
# Lists are first cut within so many parts of a language.
_PARTS = 64
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Characters that end a piece, and words between blanks and tabs.
_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_ENDS = [bytes([c]) for c in b".,;:!?\x0A\x0B\x0C\x0D"]
# Words handled at a time: three numbers of words in a run fit in 63 bits.
_RUN_BITS = 21
_RUN = (1 << _RUN_BITS) - 2
# Characters of which the words are found at a time, about; from then on they are numbers.
_SPELLED_OUT = 1 << 18
_SEPARATOR = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
# Kinds of bytes: of a word, between words, an end of a piece.
_WORD, _BLANK, _END = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _BLANK
_KINDS[[e[0] for e in _ENDS]] = _END
# The print of a word is the sum of a number for each byte times a power of an odd one; longer words have a digest.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX1)
_LONG = 1 << 12
# Words or phrases that are gathered before they are counted and sent on, about.
_COUNTED = 1 << 21
# Bytes of phrases that are spelled out, or of words that are compared, at a time, about.
_AT_ONCE = 1 << 20
# Bytes of texts of which the counts go on together, about, and of batches sent back.
_SLICE, _SENT = SLICE_BYTES, 4 << 20
# The step of what has not reached the threshold.
_NEVER = np.iinfo(np.int32).max
# Many counts in a row: numbers one after the other, as bytes.
_HASHED = "part int, words int, hashes binary, n binary, at binary"
_KNOWN = f"{_HASHED}, reached array<bigint>, steps array<int>"
_LISTED = "part int, lang string, phrases binary, sizes binary, n binary"
_SPELLED = "lang string, words int, phrase string, n bigint"


def _shards(docs: DataFrame, shards: int) -> DataFrame:
    """``(lang, text, shard)`` in a folder for each shard."""
    path = scratch_path(docs.sparkSession, "shards")
    docs.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class _Numbers(dict):
    """Words numbered in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Cuts of a list so that what it names has about ``_AT_ONCE`` bytes each time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _AT_ONCE)) + 1
    return map(slice, [0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


class _Run:
    """Words in order, as places in a text with a print each, and hashes of the phrases that begin at each place."""

    def __init__(self, lang: str, data: bytes, starts: np.ndarray, sizes: np.ndarray, prints: np.ndarray, own: int):
        self.lang, self.data, self.starts, self.sizes, self.prints, self.own = lang, data, starts, sizes, prints, own
        self.bytes = np.frombuffer(data, np.uint8)
        each = _mixed(prints * _MIX1 + np.uint64(_digest(lang.encode("utf-8", "surrogatepass"))))
        self.hashes, self.there = [each], [_KINDS[self.bytes[starts]] == _WORD]
        for _ in range(2):
            part, there = self.hashes[-1], self.there[-1]
            # Each phrase from the hash of all but its last word, and of all but its first.
            self.hashes.append(_mixed(part[:-1] * _MIX1 + part[1:] * _MIX2))
            self.there.append(there[:-1] & there[1:])

    def begin_here(self, size: int, chosen: np.ndarray) -> np.ndarray:
        """Places of phrases that begin in the run's own part."""
        at = np.flatnonzero(chosen & self.there[size - 1])
        return at[at < self.own]

    @cached_property
    def _numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """For each number, where the word first stands; for each place, the number of its word."""
        _, first, code = np.unique(self.prints, return_index=True, return_inverse=True)
        if not self._same(first[code]):
            # Two words have one print.
            number, codes = _Numbers(), []
            for words in _words(self.data[self.starts[0] : self.starts[-1] + self.sizes[-1]]):
                codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            code = np.concatenate(codes)
            _, first = np.unique(code, return_index=True)
        return first, code

    def _same(self, other: np.ndarray) -> bool:
        """Whether at every place stands the word of the other place named for it."""
        if not np.array_equal(self.sizes, self.sizes[other]):
            return False
        return all(
            np.array_equal(self._text(self.starts[c], self.sizes[c]), self._text(self.starts[other[c]], self.sizes[c]))
            for c in _chunks(self.sizes)
        )

    def _text(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of spans, one after the other."""
        if sizes.max(initial=0) > _LONG:
            return np.frombuffer(bytearray().join(self.data[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())), np.uint8)
        before = np.cumsum(sizes) - sizes
        return self.bytes[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]

    @property
    def code(self) -> np.ndarray:
        return self._numbered[1]

    @property
    def words(self) -> list[bytes]:
        first = self._numbered[0]
        return [self.data[s : s + n] for s, n in zip(self.starts[first].tolist(), self.sizes[first].tolist())]

    def spelled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of phrases, one after the other, and how many each has. ``codes`` has the numbers of the words of a
        phrase in each row, -1 behind the last."""
        token, there = self._numbered[0][codes], codes >= 0
        sizes = np.where(there, self.sizes[token], 0)
        # A blank follows each word but the last of a phrase.
        blank = np.zeros(there.shape, bool)
        blank[:, :-1] = there[:, 1:]
        sizes += blank
        lengths = sizes.sum(axis=1, dtype=np.int32)
        found = [np.empty(0, np.uint8)]
        for c in _chunks(lengths):
            each = sizes[c][there[c]]
            # What follows a word is in the text, too, as another word follows it there.
            phrases = self._text(self.starts[token[c][there[c]]], each)
            phrases[(np.cumsum(each) - 1)[blank[c][there[c]]]] = 0x20
            found.append(phrases)
        return np.concatenate(found), lengths


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces in order, those of about ``_SPELLED_OUT`` characters at a time."""
    start = 0
    while start < len(data):
        end = _SEPARATOR.search(data, start + _SPELLED_OUT)
        end = end.end() if end else len(data)
        yield _TOKEN.findall(data, start, end)
        start = end


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of prints, and of its inverse."""
    found = []
    for base in (int(_MIX2), pow(int(_MIX2), -1, 1 << 64)):
        powers = np.full(n, np.uint64(base))
        powers[0] = 1
        found.append(np.cumprod(powers))
    return found[0], found[1]


def _spans(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, sizes and prints of what ``_words`` has, as many at a time."""
    start = 0
    while start < len(data):
        found = _SEPARATOR.search(data, start + _SPELLED_OUT)
        end = found.end() if found else len(data)
        seen = np.frombuffer(data, np.uint8)[start : min(end, start + _SPELLED_OUT + _LONG)]
        kinds = _KINDS[seen]
        word, mark = kinds == _WORD, kinds == _END
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        starts, stops = np.flatnonzero(begins | mark), np.flatnonzero(stops | mark) + 1
        powers, inverse = _powers(_SPELLED_OUT + _LONG)
        sums = np.zeros(len(seen) + 1, np.uint64)
        np.cumsum(_BYTES[seen] * powers[: len(seen)], out=sums[1:])
        prints = (sums[stops] - sums[starts]) * inverse[starts]
        if start + len(seen) < end:
            # The last word is longer than that. What ends it comes next.
            end = found.start() if found else end
            stops[-1] = end - start
        sizes = stops - starts
        for i in np.flatnonzero(sizes > _LONG).tolist():
            prints[i] = _digest(data[start + starts[i] : start + stops[i]])
        yield starts + start, sizes, prints
        start = end


def _runs_of(lang: str, data: bytes) -> Iterator[_Run]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for spans in _spans(data):
        held.append(spans)
        n += len(spans[0])
        while n > _RUN + 2:
            # Runs overlap by two words; what begins there counts in the next one.
            whole = [np.concatenate(x) for x in zip(*held)]
            yield _Run(lang, data, *(x[: _RUN + 2] for x in whole), _RUN)
            held = [tuple(x[_RUN:] for x in whole)]
            n -= _RUN
    if n:
        yield _Run(lang, data, *(np.concatenate(x) for x in zip(*held)), n)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    for by_lang in _gathered(batches):
        while by_lang:
            lang, of_lang = by_lang.popitem()
            # A line end keeps documents apart.
            yield from _runs_of(lang, b"\n".join(of_lang).lower())


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, of as many batches as have ``_SLICE`` bytes together."""
    by_lang: dict[str, list[bytes]] = {}
    held = 0
    for batch in slices(batches, _SLICE):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            by_lang.setdefault(lang, []).append(text)
        held += batch.nbytes
        if held >= _SLICE:
            yield by_lang
            by_lang, held = {}, 0
    yield by_lang


def _held(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return _has(packed, (hashes & np.uint64(8 * len(packed) - 1)).astype(np.int64))


def _parts(docs: DataFrame) -> int:
    """How many parts hashes are dealt to, by their upper bits: more for more documents."""
    spark = docs.sparkSession
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that ascending hashes fall in, and where each begins; behind the last, their number."""
    least = np.array([-(-(i << 32) // parts) << 32 for i in range(parts)], np.uint64)
    begin = np.append(np.searchsorted(hashes, least), len(hashes))
    there = np.flatnonzero(begin[1:] > begin[:-1])
    return there, np.append(begin[there], len(hashes))


def _joined(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of values, those from one beginning to the next in a row."""
    offsets = (begin * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)


def _hashed(shard: DataFrame, singles: bool, filters: list[np.ndarray | None], parts: int) -> DataFrame:
    """Counts by hash of what is active in a shard. ``filters`` are of words, then of pairs: each those that reached
    the threshold before this step, and those of them that did so no longer ago than a round."""
    shared = shard.sparkSession.sparkContext.broadcast(filters)

    def counted(size: int, hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(hashes), return_counts=True)
        there, begin = _dealt(found, parts)
        never = np.full(len(found), _NEVER, np.int32)
        yield from slices([pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(np.full(len(there), size, np.int32)), _joined(found, begin),
             _joined(n.astype(np.int64), begin), _joined(never, begin)],
            ["part", "words", "hashes", "n", "at"],
        )], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list[np.ndarray]] = {}
        n = 0
        for r in _runs(batches):
            active = {1: np.ones(len(r.prints), bool)} if singles else {}
            for size in (2, 3):
                early, late = shared.value[2 * size - 4 : 2 * size - 2]
                if early is not None and len(r.prints) >= size:
                    held = r.hashes[size - 2]
                    early, late = _held(early, held), _held(late, held)
                    active[size] = early[:-1] & early[1:] & (late[:-1] | late[1:])
            for size, chosen in active.items():
                gathered.setdefault(size, []).append(r.hashes[size - 1][r.begin_here(size, chosen)])
                n += len(gathered[size][-1])
            if n >= _COUNTED:
                while gathered:
                    yield from counted(*gathered.popitem())
                n = 0
        while gathered:
            yield from counted(*gathered.popitem())

    return shard.select("lang", "text").mapInArrow(run, _HASHED)


def _summed(counts: DataFrame, step: int, least: int, over: int) -> DataFrame:
    """The sums by hash, and ``at``, the step that brought them to the threshold. Those of up to ``over`` words that are
    below it will stay there, and go no further."""

    def total(rows: pa.Table) -> pa.Table:
        out = []
        for words in (1, 2, 3):
            some = rows.filter(pc.equal(rows.column("words"), words))
            hashes = _numbers(some, "hashes", np.uint64)
            if not len(hashes):
                continue
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            hashes = hashes[first]
            n = np.add.reduceat(_numbers(some, "n", np.int64)[order], first)
            at = np.minimum.reduceat(_numbers(some, "at", np.int32)[order], first)
            at[(at == _NEVER) & (n >= least)] = step
            reached = at != _NEVER
            if words <= over:
                hashes, n, at, reached = hashes[reached], n[reached], at[reached], reached[reached]
            out.append({
                "part": rows.column("part")[0].as_py(), "words": words, "hashes": hashes.tobytes(), "n": n.tobytes(),
                "at": at.tobytes(), "reached": hashes[reached].view(np.int64), "steps": at[reached],
            })
        kinds = pa.schema([
            ("part", pa.int32()), ("words", pa.int32()), ("hashes", pa.binary()), ("n", pa.binary()), ("at", pa.binary()),
            ("reached", pa.list_(pa.int64())), ("steps", pa.list_(pa.int32())),
        ])
        return pa.Table.from_pylist(out, kinds)

    return counts.groupBy("part").applyInArrow(total, _KNOWN)


def _spelled(docs: DataFrame, filters: list[np.ndarray | None], least: int, parts: int) -> DataFrame:
    """``(lang, words, phrase, n)`` of the phrases in the filters, one for each length, that occur ``least`` times; the
    number of all words of a language is that of the empty phrase, with no words."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches):
            nothing = np.full((1, 3), -1)
            codes, hashes = [nothing], [np.zeros(1, np.uint64)]
            counts = [np.array([r.there[0][: r.own].sum()])]
            for size, packed in enumerate(shared.value, 1):
                if packed is None or len(r.prints) < size:
                    continue
                at = r.begin_here(size, _held(packed, r.hashes[size - 1]))
                key = r.code[at]
                for i in range(1, size):
                    key = (key << _RUN_BITS) + r.code[at + i]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                at = at[first]
                own = np.full((len(at), 3), -1)
                for i in range(size):
                    own[:, i] = r.code[at + i]
                codes.append(own)
                hashes.append(r.hashes[size - 1][at])
                counts.append(n)
            codes, hashes, counts = np.concatenate(codes), np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(hashes)
            there, begin = _dealt(hashes[order], parts)
            phrases, sizes = r.spelled(codes[order])
            ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
            yield from slices([pa.RecordBatch.from_arrays(
                [pa.array(there, pa.int32()), pa.array([r.lang] * len(there), pa.string()), _joined(phrases, ends[begin]),
                 _joined(sizes, begin), _joined(counts[order].astype(np.int64), begin)],
                ["part", "lang", "phrases", "sizes", "n"],
            )], _SENT)

    def total(rows: pa.Table) -> pa.Table:
        out = []
        for lang in rows.column("lang").unique():
            some = rows.filter(pc.equal(rows.column("lang"), lang))
            sizes = _numbers(some, "sizes", np.int32)
            ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
            whole = pa.py_buffer(b"".join(some.column("phrases").to_pylist()))
            phrases = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), whole])
            n = pa.table({"phrase": phrases, "n": _numbers(some, "n", np.int64)})
            n = n.group_by("phrase", use_threads=False).aggregate([("n", "sum")])
            blank = pc.equal(pc.binary_length(n.column("phrase")), 0)
            n = n.filter(pc.or_(blank, pc.greater_equal(n.column("n_sum"), least)))
            phrase = n.column("phrase").cast(pa.binary()).cast(pa.string())
            words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
            out.append(pa.table({
                "lang": pa.array([lang.as_py()] * len(n), pa.string()), "words": words, "phrase": phrase, "n": n.column("n_sum"),
            }))
        return pa.concat_tables(out)

    return docs.select("lang", "text").mapInArrow(run, _LISTED).groupBy("part").applyInArrow(total, _SPELLED)


def _filter(reached: DataFrame, n: int) -> np.ndarray:
    """A bit filter, of bounded size, for ``n`` phrases."""
    bits = _filter_bits(n)
    return _bitmap(F.col("hash").bitwiseAND(F.lit(bits - 1)), reached, bits)


# The size of a filter that holds nothing.
_NO_BITS = 1 << 15


def _reached(known: DataFrame) -> DataFrame:
    """``(words, hash, at)`` of what has reached the threshold."""
    found = F.inline(F.arrays_zip(F.col("reached").alias("hash"), F.col("steps").alias("at")))
    return known.select("words", found)


def _filters(frequent: DataFrame, longest: int, step: int, shards: int) -> list[np.ndarray | None]:
    """For each length of parts: a filter of those at the threshold, and one of those that came to it in the last round;
    None for both if there are none of the latter."""
    recent = F.col("at") >= step - shards
    numbers = frequent.groupBy("words").agg(F.count("at").alias("all"), F.count(F.when(recent, 1)).alias("recent")).collect()
    n = {r["words"]: (r["all"], r["recent"]) for r in numbers}
    found: list[np.ndarray | None] = []
    for words in range(1, longest):
        every, late = n.get(words, (0, 0))
        # Triples are looked for among words that may be active in no pair any more.
        if not late and not any(n.get(w, (0, 0))[1] for w in range(words, longest)):
            found += [None, None]
            continue
        reached = frequent.where(F.col("words") == words)
        early = _filter(reached, every)
        nothing = np.zeros(_NO_BITS // 8, np.uint8)
        found += [early, early if late == every else _filter(reached.where(recent), late) if late else nothing]
    return found


def _itemsets(docs: DataFrame, least: int, shards: int) -> DataFrame:
    """``(lang, words, phrase, n)`` of all phrases of up to three words that occur ``least`` times, and of no words."""
    place = F.pmod(F.xxhash64("text"), F.lit(shards))
    dealt = _shards(docs.select("lang", "text", place.cast("int").alias("shard")), shards)
    parts = _parts(dealt)
    # Phrases so far, by hash.
    known: DataFrame | None = None
    step = 0
    while True:
        singles, filters = step < shards, [None] * 4
        if known is not None:
            filters = _filters(_reached(known), 3, step, shards)
        if not singles and all(f is None for f in filters):
            break
        new = _hashed(dealt.where(F.col("shard") == step % shards), singles, filters, parts)
        counts = new if known is None else new.unionByName(known.select(*new.columns))
        # By now the rounds of shorter phrases are over: those below the threshold stay there.
        known = stored(_summed(counts, step, least, (step + 1) // shards))
        step += 1
    frequent = _reached(known)
    sizes = {r["words"]: r["count"] for r in frequent.groupBy("words").count().collect()}
    last = [_filter(frequent.where(F.col("words") == w), sizes[w]) if w in sizes else None for w in (1, 2, 3)]
    return stored(_spelled(dealt, last, least, parts))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = THRESHOLD,
    top: int = TOP,
    shards: int = SHARDS,
    covered_percent: int = 50,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words in each language.

    Texts, A-Z in lower case, are cut at full stops, commas, ``;:!?`` and line
    ends, and the pieces into words at blanks and tabs. Counts are of all
    occurrences within pieces: ``a`` of the phrase, at least ``least``, ``n`` of
    all words of the language, ``l`` and ``r`` of the two parts of the phrase at
    the cut with the lowest score, floor(1000000 a a / (l r)), the first of
    equal ones. A phrase inside a longer one that comes at least
    ``covered_percent`` as often is left out. The order is by score, then ``a``,
    then the bytes of the phrase.

    A null language is ``und``; a null or empty text, or one of separators
    only, has no words; repeated rows count each. An empty table gives an empty
    result. Texts of any length are counted whole. Other columns are not read.
    """
    docs = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")
    ).where(F.col("text").isNotNull() & (F.col("text") != ""))
    counted = _itemsets(docs, least, shards)
    phrases, totals = counted.where("words > 1"), counted.where("words = 0").select("lang", "n")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.call_function("substring_index", F.col("phrase"), F.lit(" "), k).alias("left"),
            F.call_function("substring_index", F.col("phrase"), F.lit(" "), k - F.col("words")).alias("right"),
        ),
    )
    cut = phrases.select("lang", "words", "phrase", F.col("n").alias("a"), F.inline(cuts))
    sides = [counted.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])) for side in ("left", "right")]
    # Products may pass 64 bits.
    exact = (
        "(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))))"
        " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    )
    scored = cut.join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"]).withColumn("score", F.expr(exact))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("best")
    scored = scored.groupBy("lang", "words", "phrase", "a").agg(lowest)
    inner = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    longer = (
        phrases.where("words = 3")
        .select("lang", F.explode(inner).alias("phrase"), "n")
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    covered = F.col("longer").isNotNull() & (100 * F.col("longer") >= covered_percent * F.col("a"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~covered).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(_PARTS)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
