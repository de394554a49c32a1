"""Words of noisy text as hashed ids, with common disguises undone.

Accents, letter case, damaged encodings, zero-width and soft hyphens, hyphenation
marks, braces inside words, digits and signs standing for letters, letters
repeated three times or more and letters written apart all lead to the plain
word; a word masked by stars keeps its first and last letter.  Whole texts are
read; chunks between blanks are cached per worker up to a bounded number.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import chain

import numpy as np

#: ids below FIRST are reserved: 0 padding, 1 number, 2 quotation mark, 3..28 single letters a..z, 29 any word unknown to a model
PAD, NUMBER, QUOTE, LETTER, UNKNOWN, FIRST = 0, 1, 2, 3, 29, 32
HASH_BITS = 16
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48

#: digits and signs that stand for letters (fixed values)
_STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]|\\\\-")
_ACCENT = re.compile(r"\\[\"'`^~=.]\s*\{?\\?([a-z])\}?")
_COMMAND = re.compile(r"\\([a-z]+)\*?")
_BRACE = re.compile(r"(?<=[a-z0-9@$*])[{}]+(?=[a-z0-9@$*])")
_STARS = re.compile(r"(?<=[a-z])\*+(?=[a-z])")
_TOKEN = re.compile(r"``|''|[\"“”„«»]|[0-9]+(?:[.,][0-9]+)*(?![a-z0-9@$])|[a-z0-9@$!|*]*[a-z][a-z0-9@$|*]*")
_THRICE = re.compile(r"([a-z])\1\1+")
_NUMBERED = re.compile(r"([a-z]{4,})\d+")


def word_id(word: str) -> int:
    """Stable id of a plain word."""
    if len(word) == 1 and "a" <= word <= "z":
        return LETTER + ord(word) - 97
    return FIRST + zlib.crc32(word.encode()) % ((1 << HASH_BITS) - FIRST)


def _repair(chunk: str) -> str:
    if "Ã" in chunk or "Â" in chunk:
        for code in ("cp1252", "latin-1"):
            try:
                return chunk.encode(code).decode("utf-8")
            except UnicodeError:
                continue
    return chunk


def chunk_ids(chunk: str) -> tuple[int, ...]:
    """Ids of the words in a piece of text without blanks."""
    if chunk.isascii() and chunk.isalpha():
        return (word_id(_THRICE.sub(r"\1", chunk.lower())),)
    s = _repair(_INVISIBLE.sub("", chunk)).lower()
    s = _ACCENT.sub(r"\1", s)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("ß", "ss")
    s = _BRACE.sub("", _COMMAND.sub(r" \1 ", s))
    s = _STARS.sub("*", s)
    out = []
    for t in _TOKEN.findall(s):
        if t[0] in "`'\"“”„«»":
            out.append(QUOTE)
        elif t[0].isdigit() and not any("a" <= c <= "z" for c in t):
            out.append(NUMBER)
        else:
            if not t.isalpha():
                t = t.strip("|!*") if "*" not in t[1:-1] else t.strip("|!")
                if re.search(r"\d{4}", t):  # keys and years, not words
                    out.append(NUMBER)
                    continue
                if plain := _NUMBERED.fullmatch(t):  # names of files and parts: the number is no disguise
                    t = plain[1]
                t = t.translate(_STANDS_FOR)
            t = _THRICE.sub(r"\1", t)
            if t:
                out.append(word_id(t))
    return tuple(out)


class WordIds(dict):
    """Chunk to ids, filled on demand and bounded."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = chunk_ids(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        ids = np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), dtype=np.int32)
        return join_spelled(ids)


def join_spelled(ids: np.ndarray, least: int = 4) -> np.ndarray:
    """Replace runs of at least ``least`` single letters by the word they spell."""
    single = (ids >= LETTER) & (ids < LETTER + 26)
    if np.count_nonzero(single) < least:
        return ids
    edge = np.diff(np.concatenate(([0], single.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - begins >= least
    if not long.any():
        return ids
    out = ids.copy()
    keep = np.ones(len(ids), dtype=bool)
    for a, b in zip(begins[long].tolist(), ends[long].tolist()):
        out[a] = word_id(_THRICE.sub(r"\1", "".join(chr(97 + i - LETTER) for i in ids[a:b].tolist())))
        keep[a + 1 : b] = False
    return out[keep]
