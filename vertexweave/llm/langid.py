"""Language identification of whole texts, and of spans within them.

The script of a word, by ranges of characters, narrows down the languages it
may be in. Among those, character n-grams of the word give each a score. The
Viterbi algorithm then labels all words of a text at once, paying a penalty for
every switch of language, so that single odd words do not break a span.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.llm.frames import fresh
from vertexweave.llm.workers import slices

UNKNOWN = "und"
# Different texts per language that a model is fitted on, at most; scores hardly change beyond.
TRAINING_ROWS = 3000
# Languages that a model tells apart, at most: those with most rows.
MOST_LANGUAGES = 256
# Log-odds that words must bring together before a switch of language pays.
SWITCH_PENALTY = 12.0
_BUCKET_BITS = 16
BUCKETS = 1 << _BUCKET_BITS
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LONGEST_GRAM = 3
# A language is a candidate for a script if it has at least this part of its letters there.
_SCRIPT_SHARE = 0.001
_FORBIDDEN = -50.0
# The same for all languages, so it favours none; no word of a known script scores above zero.
_FOREIGN = 1.0
# Bytes of texts labelled at a time.
_SLICE = 2 << 20
# Words whose scores a task remembers, and new ones that are scored together.
_WORDS, _TOGETHER = 200_000, 50_000

# First characters of blocks of Unicode, and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"),
)
_STARTS = [start for start, _ in SCRIPTS]
_NAMES = sorted({name for _, name in SCRIPTS})
_BLOCK_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of character n-grams: buckets of all n-grams of words with their ends marked, word by word,
    and where those of each word begin."""
    sizes = np.array([len(w) + 2 for w in words])
    marked = "".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(marked, "<u4").astype(np.uint64)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    room = np.repeat(sizes, sizes) - place
    code = np.zeros(len(points), np.uint64)
    for n in range(1, _LONGEST_GRAM + 1):
        # An n-gram is coded at its first character; every word has one at least.
        code = code * _FACTOR
        code[: len(points) - n + 1] += points[n - 1 :] + np.uint64(1)
        kept = code[room >= n]
        kept = (kept ^ (kept >> np.uint64(29))) * _FACTOR
        yield (kept >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), np.cumsum(sizes - n + 1) - (sizes - n + 1)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: those whose crc32 of the id as text is 2 modulo 4. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class LanguageModel:
    """``scores[bucket, language]`` are log-probabilities; ``allowed[script, language]`` the candidates."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of lower-case words under all languages, relative to the best candidate; zeros where the first
        character is not a letter, and ``_FOREIGN`` where it is one of a script that no language has."""
        found = np.zeros((len(words), len(self.languages)), np.float32)
        if not words or not self.languages:
            return found
        for buckets, starts in grams(words):
            found += np.add.reduceat(self.scores[buckets], starts, axis=0)
        first = np.array([ord(w[0]) for w in words])
        allowed = self.allowed[_BLOCK_SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]]
        letter = np.array([w[0].isalpha() for w in words])[:, None]
        some = allowed.any(axis=1, keepdims=True)
        allowed &= letter
        best = np.where(allowed, found, -np.inf).max(axis=1, keepdims=True)
        found = np.where(allowed, found - best, np.float32(_FORBIDDEN))
        none = np.where(letter & ~some, np.float32(_FOREIGN), np.float32(0))
        return np.where(some & letter, found, none).astype(np.float32)


def _of_lang(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("lang")]


def _last_digests(rows: DataFrame, shares: dict[str, float], most: int) -> dict[str, str]:
    """For each language, the digest at place ``most`` in order, or the last if there are fewer.

    Only about ``shares`` of the digests are looked at, and more of a language if that was not enough.
    """
    lasts: dict[str, str] = {}
    while shares:
        place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
        near = rows.where(place < _of_lang({k: share * 2.0**32 for k, share in shares.items()})).select("lang", "digest")
        found = near.distinct().groupBy("lang").agg(F.sort_array(F.collect_list("digest")).alias("digests"))
        n = F.size("digests")
        for r in found.select("lang", n.alias("n"), F.get("digests", F.least(n, F.lit(most)) - 1).alias("last")).collect():
            if r["n"] >= most or shares[r["lang"]] >= 1:
                lasts[r["lang"]] = r["last"]
        shares = {k: 4 * share for k, share in shares.items() if k not in lasts}
    return lasts


def train(
    rows: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    training_rows: int = TRAINING_ROWS,
    most_languages: int = MOST_LANGUAGES,
) -> LanguageModel:
    """A model from rows with a language: of each, the ``training_rows`` different texts whose hashes are the least, or
    all if there are fewer. Copies of a text count once. If there are more than ``most_languages``, those with most
    rows are learned, of equal ones the first by name. Rows with a null language or text teach nothing; of an empty
    table comes a model that knows no language.

    Counts are made by tasks and added up by Spark; per language at most
    ``BUCKETS`` of them and one per script come back.
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    # Near enough to know how far to look; what is drawn is exact.
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n"), F.count(F.lit(1)).alias("rows"))
    sizes = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("rows"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    lasts = _last_digests(rows, {k: 1.25 * training_rows / max(1, n) for k, n in sizes.items()}, training_rows)
    drawn = rows.where(F.col("digest") <= _of_lang(lasts)).dropDuplicates(["lang", "digest"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        for lang, counter in words.items():
            known = [w for w in counter if w[0].isalpha()]
            if not known:
                continue
            times = np.array([counter[w] for w in known])
            found = np.zeros(BUCKETS, np.int64)
            for at in range(0, len(known), _TOGETHER):
                for buckets, starts in grams(known[at : at + _TOGETHER]):
                    each = np.repeat(times[at : at + _TOGETHER], np.diff(np.append(starts, len(buckets))))
                    found += np.bincount(buckets, each, BUCKETS).astype(np.int64)
            block = np.searchsorted(_STARTS, [ord(w[0]) for w in known], side="right") - 1
            letters = times * np.array([len(w) for w in known])
            script = np.bincount(_BLOCK_SCRIPT[block], letters, len(_NAMES)).astype(np.int64)
            some, used = np.flatnonzero(found), np.flatnonzero(script)
            keys, n = np.concatenate([some, -1 - used]), np.concatenate([found[some], script[used]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

    counted = (
        drawn.mapInArrow(count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    )
    got = counted.toPandas()
    number = got["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(int)
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    counts, scripts = np.full((BUCKETS, len(languages)), 0.5), np.zeros((len(_NAMES), len(languages)))
    np.add.at(counts, (key[key >= 0], number[key >= 0]), n[key >= 0])
    np.add.at(scripts, (-1 - key[key < 0], number[key < 0]), n[key < 0])
    allowed = (scripts > 0) & (scripts >= _SCRIPT_SHARE * scripts.sum(axis=0))
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every word. ``scores`` has the words of one text after those of another.

    All texts advance together, word by word; the longest come first, so those
    still going are always the first ones.
    """
    n_words, n_labels = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")
    best = np.zeros((len(sizes), n_labels), np.float32)
    came = np.empty((n_words, n_labels), np.uint8 if n_labels <= 256 else np.uint16)
    own = np.arange(n_labels, dtype=came.dtype)
    for t in range(longest):
        k = going[t]
        at, now = starts[:k] + t, best[:k]
        top = now.argmax(axis=1)
        switch = now[np.arange(k), top] - np.float32(penalty)
        came[at] = np.where(now < switch[:, None], top[:, None].astype(came.dtype), own)
        np.maximum(now, switch[:, None], out=now)
        now += scores[at]
        # Only differences count; this keeps numbers small in long texts.
        now -= now.max(axis=1, keepdims=True)
    labels = np.empty(n_words, came.dtype)
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = going[t]
        at = starts[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return labels


_LANGUAGE = "struct<lang:string,score:double,spans:array<struct<lang:string,first_word:int,n_words:int>>>"


def identify(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """``docs`` with a struct ``language`` behind its columns: ``lang``, ``score``, ``spans``.

    ``spans`` label runs of words (runs of letters) by language, in order. The
    language of the text is the one whose spans have most letters, ``score``
    their share of all letters; of equal ones the first by name. A null text,
    one without letters, and any text if the model knows no language, has
    ``und``, score 0 and no spans. Letters of a script that no learned language
    has count as those of none: they lower the score, and a text of nothing else
    has score 0, and as its language the first by name. Texts may be of any
    length. Rows do not depend on each other, repeated ones get equal labels,
    and an empty table gives an empty one. A column of the name ``language`` in
    ``docs`` stays, and the struct is then called ``language_``.
    """
    (result,) = fresh(docs, "language")
    schema = docs.withColumn(result, F.lit(None).cast(_LANGUAGE)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo: dict[str, bytes] = {}
        # Scores take four bytes per word and language.
        step = _SLICE * 4 // max(4, len(model.languages))
        for batch in slices(batches, step):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _languages(batch.column(text_col).to_pylist(), model, memo, penalty)], [*names, result]
            )

    return docs.mapInArrow(label, schema)


def _remember(memo: dict[str, bytes], lists: list[list[str]], model: LanguageModel) -> None:
    """Add the scores of all words of a batch; those that are new are computed together."""
    if len(memo) >= _WORDS:
        memo.clear()
    new = sorted(set().union(*lists) - memo.keys())
    for start in range(0, len(new), _TOGETHER):
        some = new[start : start + _TOGETHER]
        data, size = model.words(some).tobytes(), 4 * len(model.languages)
        memo.update((w, data[i * size : (i + 1) * size]) for i, w in enumerate(some))


def _languages(texts: list[str | None], model: LanguageModel, memo: dict[str, bytes], penalty: float) -> pa.StructArray:
    n_labels = len(model.languages)
    lists = [_WORD.findall(t.lower()) if t and n_labels else [] for t in texts]
    lists = [w if any(c.isalpha() for x in w for c in x) else [] for w in lists]
    _remember(memo, lists, model)
    sizes = np.array([len(w) for w in lists], np.int64)
    letters = [np.fromiter(map(len, w), np.int64, len(w)) for w in lists if w]
    scores = [b"".join(map(memo.__getitem__, w)) for w in lists]
    words = int(sizes.sum())
    scores = np.frombuffer(b"".join(scores), np.float32).reshape(words, max(1, n_labels))
    labels = viterbi(scores, sizes, penalty)
    owner = np.repeat(np.arange(len(texts)), sizes)
    weight = np.concatenate(letters) if letters else np.zeros(0, np.int64)
    every = np.bincount(owner, weight, len(texts))
    weight = np.where(scores[:, 0] == _FOREIGN, 0, weight) if words else weight
    shares = np.bincount(owner * max(1, n_labels) + labels, weight, len(texts) * max(1, n_labels))
    shares = shares.reshape(len(texts), max(1, n_labels))
    some = sizes > 0
    top = shares.argmax(axis=1)
    score = np.where(some, shares.max(axis=1) / np.maximum(every, 1), 0.0)
    named = np.array([*model.languages, UNKNOWN], object)
    lang = named[np.where(some, top, n_labels)]

    first = np.ones(words, bool)
    first[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
    at = np.flatnonzero(first)
    begins = np.cumsum(sizes) - sizes
    spans = pa.StructArray.from_arrays(
        [
            pa.array(named[labels[at].astype(int)], pa.string()),
            pa.array((at - begins[owner[at]]).astype(np.int32)),
            pa.array(np.diff(np.append(at, words)).astype(np.int32)),
        ],
        ["lang", "first_word", "n_words"],
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(texts)))]).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(lang, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)],
        ["lang", "score", "spans"],
    )


def keep_known(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` in one known language: not ``und``, and with ``least_score`` of their letters in it.

    The model is trained on the rows of ``docs`` that have a language and are not held out. Null and empty texts,
    those without letters, and those mostly in a script that no learned language has, go; repeated rows stay or go
    together; a null id or language does not matter. If no row has a language, nothing is kept.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    labelled = identify(docs, model, text_col)
    language = F.col(labelled.columns[-1])
    return labelled.where((language["lang"] != UNKNOWN) & (language["score"] >= least_score)).select(*docs.columns)
