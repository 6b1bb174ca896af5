"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

For each start position an Aho-Corasick pass gives the longest token there.
The encoder takes the longest token that may follow the one before it; two tokens may
stand side by side if merging by rank would not have joined across their border,
which follows from the merge table alone. Where no token fits, it steps back.
A position that led nowhere is not tried again, so work is linear in the length.

Pre-tokens repeat, so each worker keeps a bounded memo of encoded chunks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fiscus.llm.pretokens import Memo, byte_level_pretokens, sections, spaced_chunks, special_pattern

MEMO_CHUNKS = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its public rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + n): b for n, b in enumerate(hidden)}


class BytePairs:
    """A byte-level vocabulary in the tables that encoding and decoding use."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, letters = described["model"], byte_letters()
        added = described.get("added_tokens", [])
        vocabulary = {token: number for token, number in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in added}
        content = {n: bytes(letters[c] for c in token) for token, n in vocabulary.items()}
        size = 1 + max([*content, *self.special.values()])
        spelled = [content.get(n, b"") for n in range(size)]
        for text, n in self.special.items():
            spelled[n] = text.encode()
        self.length = [len(s) for s in spelled]
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

        # Of each token: when it is merged, and from which two parts. Single bytes come first, from no parts.
        self.rank = [0] * size
        self.left = list(range(size))
        self.right = list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(model["merges"], start=1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = vocabulary[a + b]
            self.rank[token] = order
            self.left[token], self.right[token] = vocabulary[a], vocabulary[b]
            self.joined[vocabulary[a], vocabulary[b]] = token

        self.automaton = ahocorasick.Automaton()
        by_text = {s.decode("latin-1"): n for n, s in content.items()}
        for text, n in by_text.items():
            self.automaton.add_word(text, n)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for text, n in by_text.items():
            for cut in range(len(text) - 1, 0, -1):
                if (found := by_text.get(text[:cut])) is not None:
                    self.shorter[n] = found
                    break
        self.compatible = Memo(self._compatible, 1_000_000)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging by rank keeps the border between two tokens.

        Walks back through the merges that made them, latest first: at each
        moment the parts that touch at the border must not be a pair that
        would have merged before one of them was used up.
        """
        a, b = pair
        rank, joined = self.rank, self.joined
        until = float("inf")  # twice the rank of the merge undone last; one more if it was the right part's
        while True:
            whole = joined.get((a, b))
            if whole is not None and 2 * rank[whole] < until:
                return False  # among equal ranks the pair at the left goes first
            if rank[a] > rank[b]:
                until, a = 2 * rank[a], self.right[a]
            elif rank[b]:
                until, b = 2 * rank[b] + 1, self.left[b]
            else:
                return True

    def encode(self, pretoken: bytes) -> list[int]:
        text = pretoken.decode("latin-1")
        size = len(text)
        longest = [-1] * size
        length = self.length
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        if length[longest[0]] == size:
            return [longest[0]]
        compatible, shorter = self.compatible, self.shorter
        dead = bytearray(size + 1)
        done: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = done[-1] if done else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (last < 0 or compatible[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                done.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token = done.pop()
                at -= length[token]
                token = shorter[token]
        return done

    def decode(self, ids: np.ndarray) -> bytes:
        """All bytes at once: each id's slice of the blob, by the offset table."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(starts - ends + sizes, sizes)
        return self.blob[places].tobytes()


class Encoder:
    """Whole texts to ids, with a memo of chunks."""

    def __init__(self, path: str):
        self.pairs = BytePairs(path)
        self.special = special_pattern(tuple(sorted(self.pairs.special, key=len, reverse=True)))
        self.binary = [n.to_bytes(4, "little") for n in range(len(self.pairs.rank))]
        self.decimal = [b"%d," % n for n in range(len(self.pairs.rank))]
        self.pretokens = Memo(lambda pretoken: self._written(self.pairs.encode(pretoken.encode())), MEMO_CHUNKS)
        self.chunks = Memo(self._chunk, MEMO_CHUNKS)
        self.spaced = Memo(lambda chunk: self._chunk(" " + chunk), MEMO_CHUNKS)

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        parts = [self.pretokens[pretoken] for pretoken in byte_level_pretokens(chunk)]
        return parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))

    def _written(self, ids: list[int]) -> tuple[bytes, bytes]:
        if len(ids) == 1:
            return self.binary[ids[0]], self.decimal[ids[0]]
        return b"".join([self.binary[i] for i in ids]), b"".join([self.decimal[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The ids as little-endian 32-bit integers and as decimals, each followed by a comma."""
        found: list[tuple[bytes, bytes]] = []
        for section in sections(text, self.special):
            if section in self.pairs.special:
                found.append(self._written([self.pairs.special[section]]))
                continue
            first, rest = spaced_chunks(section)
            found += map(self.chunks.__getitem__, first)
            found += map(self.spaced.__getitem__, rest)
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        return self.pairs.decode(np.frombuffer(ids, "<u4").astype(np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row; null texts count as empty, repeated rows stay."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(own.encode(text or "")[0], "<i4") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"]
            )

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(encoded, f"{id_col} {dict(kept.dtypes)[id_col]}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row; bytes that are not UTF-8 become replacement characters."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kept = encoded.select(id_col, ids_col)
    return kept.mapInArrow(decoded, f"{id_col} {dict(kept.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    Narrow: no shuffle, and a row's ids never leave its task. Null texts count
    as empty, repeated rows and null ids stay, an empty table gives an empty
    result, further columns are ignored.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decimals = own.encode(text or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(decimals[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = docs.select(id_col, text_col)
    schema = f"{id_col} {dict(kept.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(digests, schema)
