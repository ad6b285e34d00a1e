"""Token ids of whole texts with the tokenizers library, chunk by chunk.

Both vocabularies split a text at white space, and between a letter or digit
and a comma or full stop, before they merge. So the ids of a text are those of
its chunks in a row. Chunks repeat, and a worker remembers the ids of those it
has met. The ids of a text are kept as bytes: little-endian unsigned 32-bit
integers.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

from vertexweave.llm.workers import MEMO_ENTRIES, Memo

# Words up to a comma or full stop behind a letter or digit that no normalisation changes but for its case, else up
# to white space; a blank goes with what follows.
_CHUNK = re.compile(r" ?[^ \n,.]++(?:(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])|[^ \n]*)| ?[^ \n]+|\n")
_WORD = re.compile(r"[^ \n,.]++(?:(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])|[^ \n]*)|[^ \n]+")
# White space other than blanks and line ends.
_OTHER_SPACE = re.compile(r"[^\S \n]")
# A line end between two characters that are no white space is a chunk of its own.
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
# One run of such letters.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Such letters, and ASCII signs behind them: both vocabularies split there, but for an apostrophe.
_SIGNED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
# Words whose ids a worker remembers for a vocabulary that drops white space, in each half of its memo.
_WORDS = 200_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1,
    or else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


def _encode(path: str) -> Callable[[str], bytes]:
    encode = tokenizer(path).encode
    return lambda text: array("I", encode(text, add_special_tokens=False).ids).tobytes()


def _encode_chunk(path: str) -> Callable[[str], bytes]:
    """One run of letters goes to the merges of the tokenizer at once, as it would be split off anyway."""
    whole, tok, letters = _encode(path), tokenizer(path), _byte_letters()
    merge = tok.model.tokenize
    # All that normalisation does to such letters.
    cased = str.lower if tok.normalizer and tok.normalizer.normalize_str("A") == "a" else str

    def encode(chunk: str) -> bytes:
        mapped = cased(chunk)
        if not (chunk.isascii() and chunk.isalpha()):
            if not _LETTERS.fullmatch(chunk):
                signed = _SIGNED.fullmatch(chunk)
                return encode(signed[1]) + whole(signed[2]) if signed else whole(chunk)
            mapped = mapped.encode().decode("latin-1").translate(letters)
        return array("I", [token.id for token in merge(mapped)]).tobytes()

    return encode


@lru_cache(maxsize=4)
def _memo(path: str, entries: int = MEMO_ENTRIES) -> Memo:
    """The same through all tasks of a worker process."""
    return Memo(_encode_chunk(path), entries)


def word_ids(path: str) -> Callable[[str], bytes]:
    """For a vocabulary that drops white space."""
    memo = _memo(path, _WORDS)
    return lambda text: b"".join(map(memo.__getitem__, _WORD.findall(text)))


def byte_ids(path: str) -> Callable[[str], bytes]:
    """For a byte-level vocabulary, in which a blank belongs to the word behind it.

    Where white space is not single blanks and line ends between words, the
    library decides what goes together, line by line.
    """
    memo, whole = _memo(path), _encode(path)

    def plain(text: str) -> bytes:
        return b"".join(map(memo.__getitem__, _CHUNK.findall(text)))

    def odd(text: str) -> bool:
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] == " "
        return runs or _OTHER_SPACE.search(text) is not None

    def ids(text: str) -> bytes:
        if not odd(text):
            return plain(text)
        return memo["\n"].join(whole(part) if odd(part) else plain(part) for part in _LINE_END.split(text))

    return ids
