"""Cutting texts into pieces that a tokenizer encodes independently of each other.

A *chunk* is a run of white space with the run of other characters after it.
No pre-token reaches from other characters into white space, so chunks encode
independently, and a memo of chunks saves encoding common ones again.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

# White space as the tokenizers' patterns take it, and the
# pre-token pattern of the byte-level vocabulary.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_SPACE_WITHIN_RUN = re.compile(f"[{WHITE}] [{WHITE}]")
_WORD = re.compile(f"[^{WHITE}]+")
_UNSURE = re.compile("[\x1c-\x1f]")
_BYTE_LEVEL = regex.compile(BYTE_LEVEL)
_WORD_LEVEL = regex.compile(WORD_LEVEL)


def spaced_chunks(text: str) -> tuple[list[str], list[str]]:
    """Chunks of a text in order: the first as they are, then those that a single space precedes, without it.

    Splitting at single spaces is fast and right unless a space lies within
    a run of white space; then the whole text is cut by the pattern.
    """
    if _SPACE_WITHIN_RUN.search(text):
        return _CHUNK.findall(text), []
    first, *rest = text.split(" ")
    return ([first] if first else []), rest


def words(text: str) -> list[str]:
    """Runs of characters that are not white space."""
    return _WORD.findall(text) if _UNSURE.search(text) else text.split()


def byte_level_pretokens(chunk: str) -> list[str]:
    # ASCII letters with at most one mark after them are most chunks and need no pattern.
    if chunk.isascii():
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return _BYTE_LEVEL.findall(chunk)


def word_level_pretokens(word: str) -> list[str]:
    if word.isascii():
        if word.isalpha():
            return [word]
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return [word[:-1], word[-1]]
    return _WORD_LEVEL.findall(word)


SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=17)
def word_level_kinds(planes: int) -> np.ndarray:
    """For each code point what the library takes it for; ``regex`` knows letters of a later Unicode as well."""
    if not planes:
        return np.empty(0, np.uint8)
    kinds = np.full(0x10000, OTHER, np.uint8)
    first = (planes - 1) * len(kinds)
    every = "".join(map(chr, range(first, first + len(kinds)))).encode(errors="replace").decode()
    for kind, characters in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (begin, end) in Split(Regex(characters), "removed", invert=True).pre_tokenize_str(every):
            kinds[begin:end] = kind
    return np.concatenate([word_level_kinds(planes - 1), kinds])


def word_level_cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts in one row, and how many of them stand before each text and in all.

    As ``word_level_pretokens`` cuts each word, but worked out for all characters at once: a pre-token
    begins where the kind of character changes and at each number; an apostrophe that stands alone takes
    an ending after it along.
    """
    joined = "\n".join([*texts, "", ""])  # two characters at least follow each character of a text
    form, unit = ("ascii", "u1") if joined.isascii() else ("utf-32-le", "<u4")
    codes = np.frombuffer(joined.encode(form), unit)
    kinds = word_level_kinds(1 + int(codes.max()) // 0x10000)[codes]
    kept = kinds != SPACE
    begins = kinds == NUMBER
    begins[0] |= kept[0]
    begins[1:] |= (kinds[1:] != kinds[:-1]) & kept[1:]
    quotes = np.flatnonzero(codes == ord("'"))
    quotes = quotes[begins[quotes]]
    first, second = codes[quotes + 1], codes[quotes + 2]
    short = np.isin(first, [ord(c) for c in "stmd"])
    long = np.isin(first, [ord(c) for c in "rv"]) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    ended = short | long
    quotes, after = quotes[ended], (quotes + 2 + long)[ended]
    begins[quotes + 1] = False
    begins[after] |= kinds[after] == LETTER
    places = np.flatnonzero(begins)
    letters = codes[kept]
    widths = np.ones(len(letters), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        widths += letters >= least
    sizes = np.add.reduceat(widths, np.flatnonzero(begins[kept]), dtype=np.int64) if len(places) else places
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = str(letters, form).encode()
    cut = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(data))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return cut, np.searchsorted(places, np.concatenate([[0], np.cumsum(lengths)]))


def sections(text: str, special: re.Pattern | None) -> list[str]:
    """The text cut at special strings, which stand at odd places; one section if there are none."""
    return special.split(text) if special else [text]


@lru_cache(maxsize=8)
def special_pattern(strings: tuple[str, ...]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None


MEMO_KEY = 64


class Memo(dict):
    """A dictionary that fills missing keys with a function and starts anew when it is full.

    Keys longer than ``MEMO_KEY`` are worked out each time: they hardly recur, and in scripts without spaces
    they are whole texts. So the bound on the number of entries bounds their bytes as well.
    """

    def __init__(self, fill, most: int):
        super().__init__()
        self.fill, self.most = fill, most

    def __missing__(self, key):
        if len(key) > MEMO_KEY:
            return self.fill(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fill(key)
        return value
