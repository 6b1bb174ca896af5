"""Packing documents into sequences of bounded length, shortest pack first.

1. Each text is tokenized once, in its own task: full sequences are cut off, and
   what is left is one piece. Only lengths and checksums are kept.
2. The plan depends on the length histogram alone: at most ``capacity`` numbers,
   whatever the size of the corpus. Lengths are placed longest first, each
   into the packs that are shortest so far, by whole counts of equal packs.
3. Pieces of a length are numbered; a pattern takes the next numbers of each
   of its lengths. Numbers are made per (length, salt) and shifted by the
   counts of the salts before, so a length that most pieces share is spread as well.
"""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fiscus.llm.pretokens import MEMO_KEY, WORD_LEVEL, Memo, sections, special_pattern, word_level_cut, words
from fiscus.shared import small_batches, stored

MEMO_WORDS = 500_000
SLICE_BYTES = 4_000_000
PIECE_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens"]


class WordEncoder:
    """Ids of a vocabulary that lower-cases and drops white space, with a memo of pre-tokens.

    Each different pre-token of a batch is looked up once. Unknown ones are encoded many at a time;
    the last piece of each ends with the vocabulary's mark of a word's end. Pre-tokens longer than
    ``MEMO_KEY``, in scripts without spaces whole texts, are not remembered, so the memo is bounded in bytes.
    ``clear`` empties it at the end of a task.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        ending = described["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.pattern = special_pattern(tuple(sorted(self.special, key=len, reverse=True)))
        (split,) = [p for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        cut = split["pattern"]["Regex"]
        self.cut = word_level_cut if cut == WORD_LEVEL else self.cut_words
        self.memo = Memo(regex.compile(cut).findall, MEMO_WORDS)  # words of other patterns
        vocabulary = described["model"]["vocab"]
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith(ending)]] = True
        described["pre_tokenizer"]["pretokenizers"].remove(split)
        self.tokenizer = Tokenizer.from_str(json.dumps(described))
        self.normalizer = self.tokenizer.normalizer
        self.tokenizer.normalizer = None  # texts are normalised and cut before they are encoded
        self.pieces: dict[str, bytes] = {}

    def normalised(self, section: str) -> str:
        """Composed and lower-cased character by character; a final sigma is an ordinary one."""
        if not section.isascii():
            if not section.replace("\n", "").isprintable() and any(unicodedata.category(c) == "Cn" for c in set(section)):
                return self.normalizer.normalize_str(section)  # characters that the library may know and Python does not
            if not unicodedata.is_normalized("NFC", section):
                section = unicodedata.normalize("NFC", section)
        return section.replace("Σ", "σ").lower()

    def cut_words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of all texts in one row, and how many of them stand before each text and in all."""
        cut = [[part for word in words(text) for part in self.memo[word]] for text in texts]
        return pa.array(chain.from_iterable(cut), pa.large_string()), np.cumsum([0, *map(len, cut)])

    def learn(self, pretokens: list[str]) -> list[bytes]:
        """The ids of different pre-tokens, those that are not remembered encoded together."""
        found = list(map(self.pieces.get, pretokens))
        missing = [k for k, piece in enumerate(found) if piece is None]
        if missing:
            unknown = [pretokens[k] for k in missing]
            ids = self.tokenizer.encode_batch_fast([unknown], is_pretokenized=True, add_special_tokens=False)[0].ids
            raw = np.array(ids, "<u4")
            ends = np.flatnonzero(self.ends[raw]) * 4 + 4
            if len(ends) != len(unknown):
                raise ValueError("the vocabulary does not mark the end of each pre-token")
            raw, ends = raw.tobytes(), ends.tolist()
            if len(self.pieces) + len(unknown) > MEMO_WORDS:
                self.pieces.clear()
            for k, word, a, b in zip(missing, unknown, [0, *ends], ends):
                found[k] = raw[a:b]
                if len(word) <= MEMO_KEY:
                    self.pieces[word] = found[k]
        return found

    def encode_sections(self, texts: list[str]) -> list[bytes]:
        """The ids of normalised texts without special strings."""
        cut, upto = self.cut(texts)
        coded = cut.dictionary_encode()
        which, pieces = coded.indices.to_numpy(), self.learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(pieces), "<u4")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        firsts, counts = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        raw = ids[np.arange(ends[-1]) + np.repeat(firsts - ends[:-1], counts)].tobytes()
        bounds = (ends[upto] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [sections(text, self.pattern) for text in texts]
        found = iter(self.encode_sections([self.normalised(s) for parts in cut for s in parts if s not in self.special]))
        return [
            b"".join([self.special[s].to_bytes(4, "little") if s in self.special else next(found) for s in parts])
            for parts in cut
        ]

    def clear(self) -> None:
        """Empty the memos: idle workers outlive a stage, and those of several stages share an executor's memory."""
        self.memo.clear()
        self.pieces.clear()


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``SLICE_BYTES`` of text, however many rows that are."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    turn = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES, prepend=-1)).tolist()
    for at, until in zip(turn, [*turn[1:], batch.num_rows]):
        yield batch.slice(at, until - at)


def cut_pieces(
    docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of each text with its end id: full sequences, then the rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_encoder(path), end_id.to_bytes(4, "little")
        try:
            for batch in batches:
                for part in slices(batch):
                    row, starts, lengths, sums, totals = [], [], [], [], []
                    for k, ids in enumerate(own.encode([t or "" for t in part.column(1).to_pylist()])):
                        ids += end
                        total = len(ids) // 4
                        for start in range(0, total, capacity):
                            piece = ids[4 * start : 4 * (start + capacity)]
                            row.append(k)
                            starts.append(start)
                            lengths.append(len(piece) // 4)
                            sums.append(zlib.crc32(piece))
                            totals.append(total)
                    numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row, pa.int64())), *numbers], names=[id_col, *PIECE_COLUMNS]
                    )
        finally:
            own.clear()

    kept = docs.select(id_col, text_col)
    columns = ", ".join(f"{name} long" for name in PIECE_COLUMNS)
    return kept.mapInArrow(pieces, f"{id_col} {dict(kept.dtypes)[id_col]}, {columns}")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that take every length of the histogram.

    Lengths go longest first, each into the shortest packs with room for it;
    where there are none, new packs start.
    """
    by_size: dict[int, list[list]] = defaultdict(list)  # total length -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, list]] = []
        for size in sorted(size for size in by_size if size + length <= capacity):
            packs = by_size[size]
            while left and packs:
                count, lengths = packs.pop()
                # As many of this length as fit, so that equal packs stay equal.
                fit = (capacity - size) // length
                whole = min(count, left // fit)
                if whole:
                    placed.append((size + fit * length, [whole, lengths + (length,) * fit]))
                    left -= whole * fit
                if whole < count and 0 < left < fit:
                    placed.append((size + left * length, [1, lengths + (length,) * left]))
                    whole += 1
                    left = 0
                if whole < count:
                    packs.append([count - whole, lengths])
                    break
            if not packs:
                del by_size[size]
            if not left:
                break
        for size, pack in placed:
            by_size[size].append(pack)
        if left:
            fit = capacity // length
            if left // fit:
                by_size[fit * length].append([left // fit, (length,) * fit])
            if left % fit:
                by_size[left % fit * length].append([1, (length,) * (left % fit)])
    return [(count, lengths) for size in sorted(by_size) for count, lengths in by_size[size]]


SLOT_SCHEMA = "length long, first_rank long, end_rank long, first_sequence long, first_offset long, times long"


def pattern_slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, ...]]:
    """For each length of each pattern: which numbers of that length it takes, and where they go.

    A pattern that holds a length several times takes that many consecutive numbers for each sequence.
    """
    slots = []
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            times = lengths.count(length)
            first = taken[length]
            taken[length] += count * times
            slots.append((length, first, taken[length], sequence, offset, times))
            offset += times * length
        sequence += count
    return slots


def numbered(pieces: DataFrame, histogram: dict[int, int], id_col: str) -> DataFrame:
    """``rank`` from 0 among the pieces of the same length, made in parts of about the root of all pieces."""
    spark = pieces.sparkSession
    part = max(200, math.isqrt(sum(histogram.values())))
    salts = spark.createDataFrame(
        [(length, math.ceil(n / part)) for length, n in histogram.items()], "length long, salts long"
    )
    # At most one row per length up to the capacity, whatever the corpus.
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("salts"))
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        salted.groupBy("length", "salt")
        .count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("length", "salt").orderBy(id_col, "start", "ids_crc32", "doc_tokens")
    return (
        salted.withColumn("within", F.row_number().over(within) - 1)
        .join(shifts, ["length", "salt"])
        .withColumn("rank", F.col("shift") + F.col("within"))
    )


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Offsets of a sequence leave no gap. A null or empty text is its end id
    alone. Rows that repeat an id are packed each on its own; null ids are
    allowed. An empty table gives an empty result; further columns are ignored.
    """
    with small_batches(docs.sparkSession):
        pieces = stored(cut_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    # At most ``capacity`` rows, so the plan may be made on the driver.
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    slots = docs.sparkSession.createDataFrame(
        pattern_slots(shortest_pack_first(histogram, capacity)), SLOT_SCHEMA
    )
    place = F.col("rank") - F.col("first_rank")
    # The slots follow from the histogram: their number is bounded by the capacity, not by the corpus.
    return (
        numbered(pieces, histogram, id_col)
        .join(
            F.broadcast(slots.withColumnRenamed("length", "slot_length")),
            (F.col("length") == F.col("slot_length"))
            & (F.col("rank") >= F.col("first_rank"))
            & (F.col("rank") < F.col("end_rank")),
        )
        .select(
            id_col,
            *PIECE_COLUMNS,
            (F.col("first_sequence") + F.floor(place / F.col("times"))).alias("sequence_id"),
            (F.col("first_offset") + F.pmod(place, F.col("times")) * F.col("length")).alias("offset"),
        )
    )
