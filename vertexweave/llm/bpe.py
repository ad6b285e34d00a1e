"""Byte-level BPE by backtracking over longest matches.

Merging pair by pair gives one sequence of tokens for a piece of text. That
sequence is the only one in which every two neighbours would also come out if
their bytes were encoded alone. So it is found from left to right: take the
longest token that matches and suits the one before it, and step back where
none does. A position that was left once is never entered again, which bounds
the work by the length of the piece, and whether two tokens suit each other is
remembered.

Tokens are found by an Aho-Corasick automaton over bytes mapped to the
characters of the same code (Latin-1). The words of many texts are told apart by
Arrow, so that each different one is looked up once. Pieces that are new are
encoded together, by a step in each of them at a time.
"""

from __future__ import annotations

import base64
import itertools
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from vertexweave.llm.workers import SLICE_BYTES, Memo, slices


# Entries in each half of a memo: of words and of pieces, which are mostly met once, and of pairs of neighbours.
_WORDS, _PAIRS = 1 << 18, 1 << 18
# Bytes of texts or ids handled at a time. Encoding and decoding may run side by side in every slot of an executor.
# Texts come in larger slices, as more of their words are the same then.
_TEXTS, _IDS = SLICE_BYTES // 2, SLICE_BYTES // 8
# Pieces encoded together, and their bytes at most: longer ones take many steps. The last few are encoded one by one.
_TOGETHER, _SHORT, _FEW = 1 << 13, 64, 32
_BORDER = "\u0100"
_MATCH = np.dtype([("end", np.int64), ("rank", np.int64)])
# A blank behind white space: the two are one run, and are not split.
_RUN_OF_SPACE = re.compile(r"\s ")


class Vocabulary:
    """The ranks of a file with lines of a token in base64 and its rank, merged in order of rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pieces = regex.compile(pattern).findall
        self.longest = max(map(len, self.rank), default=0)
        self.split = Memo(self._split, 1 << 20)
        most = max(self.token, default=-1) + 1
        self.most = most
        self.suit = Memo(self._suit, _PAIRS)
        self.piece_ids = Memo(self._piece, _WORDS)
        self.word_ids = Memo(self._word, _WORDS)
        self.sizes = np.array([len(self.token.get(i, b"")) for i in range(most)], np.int64)
        self.tokens = pa.array([self.token.get(i) for i in range(most)], pa.large_binary())

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds the tokens that merges lead to. Decoding needs none."""
        found = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if self.split[rank] is not None:
                found.add_word(token.decode("latin-1"), rank)
        found.make_automaton()
        return found

    @cached_property
    def shorter(self) -> np.ndarray:
        """For each token the next shorter one that it begins with and that merges lead to, or -1."""
        found = np.full(self.most, -1)
        for token, rank in self.rank.items():
            ranks = (self.rank.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            found[rank] = next((r for r in ranks if r is not None and self.split[r] is not None), -1)
        return found

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens of the last merge of a token; itself twice if it is one byte, None if no merges lead to it."""
        token = self.token[rank]
        if len(token) == 1:
            return rank, rank
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b) for a, b in itertools.pairwise(parts)]
            least = min((r for r in ranks if r is not None and r < rank), default=None)
            if least is None:
                return None
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _suit(self, pair: int) -> bool:
        """Whether encoding the bytes of both gives both: no merge across the border comes before theirs.
        The pair is one number, the left rank times ``most`` plus the right one.

        Undoes the merges on both sides of the border, latest first, and looks
        for a token across it that would have come earlier.
        """
        left, right = divmod(pair, self.most)
        limit = 1 << 62
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < limit:
                return False
            first, second = self.split[left], self.split[right]
            left_whole, right_whole = first[0] == first[1] == left, second[0] == second[1] == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                limit, left = left, first[1]
            else:
                # A merge on the right is made after those across of equal rank, as merges go from left to right.
                limit, right = right + 1, second[0]

    def _piece(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        return array("i", (whole,) if whole is not None else self.backtrack(data)).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.pieces(" " + word)))

    def _words(self, words: list[str]) -> list[bytes]:
        return self._together([self.pieces(" " + word) for word in words])

    def _together(self, split: list[list[str]]) -> list[bytes]:
        """Ids of texts that are split into pieces."""
        self.piece_ids.learn(dict.fromkeys(itertools.chain.from_iterable(split)), self._many)
        return [b"".join(map(self.piece_ids.__getitem__, pieces)) for pieces in split]

    def _many(self, pieces: list[str]) -> list[bytes]:
        data = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        short = [d for d in data if len(d) <= _SHORT and d not in self.rank]
        walks = (self._walk(short[i : i + _TOGETHER]) for i in range(0, len(short), _TOGETHER))
        known = dict(zip(short, itertools.chain.from_iterable(walks), strict=True))
        return [known.get(d) or self._piece(piece) for d, piece in zip(data, pieces, strict=True)]

    def _walk(self, data: list[bytes]) -> list[bytes]:
        """Ids of many pieces, four bytes each, found as in ``backtrack``, with a step in each piece at a time.

        No bytes for the last few pieces that are still on their way.
        """
        text = _BORDER.join(d.decode("latin-1") for d in data)
        lengths = np.array([*map(len, data)])
        ends = np.cumsum(lengths + 1) - 1
        match = np.fromiter(self.automaton.iter(text), _MATCH)
        longest = np.full(len(text) + 1, -1)
        # Ends come in ascending order, so the longest match from a place is set last.
        longest[match["end"] + 1 - self.sizes[match["rank"]]] = match["rank"]
        # The token that led to each place, -1 at the first one of a piece.
        came, dead = np.full(len(text) + 1, -1), np.zeros(len(text) + 1, bool)
        piece = np.flatnonzero(lengths)
        at = (ends - lengths)[piece]
        token = longest[at]
        while len(piece) > _FEW:
            left, to = came[at], at + np.where(token < 0, 0, self.sizes[token])
            fits = (token >= 0) & ~dead[to]
            check = np.flatnonzero(fits & (left >= 0))
            fits[check] = self._suits(left[check] * self.most + token[check])
            back = token < 0
            if (back & (left < 0)).any():
                raise ValueError("no tokens for these bytes: the vocabulary lacks a byte")
            came[to[fits]] = token[fits]
            dead[at[back]] = True
            # Steps back come to the token that led here, and it is replaced by a shorter one as others are.
            tried = np.where(back, left, token)
            at = np.where(fits, to, np.where(back, at - self.sizes[left], at))
            token = np.where(fits, longest[at], self.shorter[tried])
            on = at < ends[piece]
            piece, at, token = piece[on], at[on], token[on]
        lengths[piece] = 0
        piece, steps = np.flatnonzero(lengths), []
        at, first = ends[piece], (ends - lengths)[piece]
        while len(piece):
            steps.append((piece, came[at]))
            at = at - self.sizes[came[at]]
            on = at > first
            piece, at, first = piece[on], at[on], first[on]
        if not steps:
            return [b""] * len(data)
        pieces, tokens = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        ids = tokens[np.argsort(pieces, kind="stable")].astype(np.int32).tobytes()
        bounds = 4 * np.cumsum([0, *np.bincount(pieces, minlength=len(data))])
        return [ids[a:z] for a, z in itertools.pairwise(bounds.tolist())]

    def _suits(self, pairs: np.ndarray) -> np.ndarray:
        different, place = np.unique(pairs, return_inverse=True)
        return np.array([*map(self.suit.__getitem__, different.tolist())], bool)[place]

    def backtrack(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        n, text = len(data), data.decode("latin-1")
        rank, split, suit, most = self.rank, self.split, self.suit, self.most
        # The length up to which a token can match.
        match, longest = self.automaton.longest_prefix, self.longest
        dead = bytearray(n + 1)
        found: list[int] = []
        sizes: list[int] = []
        at, size = 0, match(text[:longest])
        while at < n:
            left = found[-1] * most if found else None
            while size:
                token = rank.get(data[at : at + size])
                if token is not None and split[token] is not None and not dead[at + size]:
                    if left is None or suit[left + token]:
                        break
                size -= 1
            if size:
                found.append(token)
                sizes.append(size)
                at += size
                size = match(text[at : at + longest])
            else:
                if not found:
                    raise ValueError("no tokens for these bytes: the vocabulary lacks a byte")
                dead[at] = 1
                found.pop()
                at -= sizes[-1]
                size = sizes.pop() - 1
        return found

    def encode_texts(self, texts: pa.Array) -> tuple[pa.Buffer | None, np.ndarray]:
        """The ids of all texts in a row, four bytes each, and where those of each text begin and end.

        No piece goes on across a blank behind a character that is not white
        space, so the ids of a text are those of its words, each with the blank before it.
        Other texts are encoded whole, in the place of their first word.
        """
        texts = pc.fill_null(texts, "")
        strings = texts.to_pylist()
        whole = [_RUN_OF_SPACE.search(t) is not None for t in strings]
        firsts = [self.pieces(t if w else t.partition(" ")[0]) for t, w in zip(strings, whole, strict=True)]
        firsts = self._together(firsts)
        words = pc.split_pattern(pc.if_else(pa.array(whole, pa.bool_()), pa.scalar("", texts.type), texts), " ")
        ends = np.cumsum([0, *pc.list_value_length(words).to_numpy()])
        words = words.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.word_ids.learn(different, self._words)
        others = map(self.word_ids.__getitem__, different)
        at = words.indices.to_numpy().astype(np.int64)
        at[ends[:-1]] = len(different) + np.arange(len(texts))
        return _joined(pa.array([*others, *firsts], pa.large_binary()).take(pa.array(at)), ends, 4)

    def encode(self, text: str) -> list[int]:
        ids, ends = self.encode_texts(pa.array([text], pa.string()))
        return np.frombuffer(ids or b"", np.int32, ends[-1]).tolist()

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> tuple[pa.Buffer | None, np.ndarray]:
        """The bytes of all ids in a row, and where those of each list begin and end."""
        span = pc.min_max(ids).as_py()
        if len(ids) and (span["min"] < 0 or span["max"] >= len(self.tokens)):
            raise ValueError("an id that the vocabulary lacks")
        found = self.tokens.take(ids)
        if found.null_count:
            raise ValueError("an id that the vocabulary lacks")
        return _joined(found, offsets, 1)


def _joined(values: pa.LargeBinaryArray, offsets: np.ndarray, width: int) -> tuple[pa.Buffer | None, np.ndarray]:
    """All bytes of the values, and the offsets of lists of values as offsets of items of ``width`` bytes."""
    _, starts, data = values.buffers()
    return data, np.frombuffer(starts, np.int64, len(values) + 1)[offsets] // width


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Made once in a worker process."""
    return Vocabulary(path, pattern)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """``docs`` with the ids of the whole text in a further column ``ids_col``, an array of int.

    A null or empty text has no ids. Each match of ``pattern`` is encoded by
    itself, without special tokens. Texts may be of any length. A column of the
    name ``ids_col`` is replaced; all others stay. Rows are independent of each
    other, repeated ones too, and an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c.lower() != ids_col.lower()]
    schema = docs.select(*rest, F.lit(None).cast("array<int>").alias(ids_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path, pattern)
        for batch in slices(batches, _TEXTS):
            found, ends = words.encode_texts(batch.column(text_col))
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, found])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [ids], [*rest, ids_col])

    return docs.mapInArrow(run, schema)


def decode(
    docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded"
) -> DataFrame:
    """``docs`` with the bytes that the ids stand for in a further column, binary; null or no ids give no bytes.

    Lists may be of any length. An id that the vocabulary lacks, or a null
    among ids, fails the job. A column of the name ``bytes_col`` is replaced;
    all others stay. Rows are independent of each other, repeated ones too, and
    an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c.lower() != bytes_col.lower()]
    schema = docs.select(*rest, F.lit(None).cast("binary").alias(bytes_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path, pattern)
        for batch in slices(batches, _IDS):
            lists = batch.column(ids_col)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null among ids")
            # Null lists are empty ones here.
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found, ends = words.decode(flat, np.cumsum([0, *sizes]))
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends), found])
            data = data.cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [data], [*rest, bytes_col])

    return docs.mapInArrow(run, schema)
