"""Token counts without ids: pieces are counted once per distinct pre-token.

1. Every task reduces its texts to distinct pre-tokens with their frequencies; one
   grouping makes the table of distinct pre-tokens, and the tokenizer counts the pieces of each once.
2. Every text becomes its pre-token frequencies. Pre-tokens that make up at
   least one part in ``FREQUENT`` of all occurrences are at most ``FREQUENT``
   many, so their table may be broadcast; their share of each text is summed
   at once. The other frequencies are joined to the table by pre-token.
3. Sums per text. No list of ids exists at any point.

Hot pre-tokens are among the broadcast ones, so the join has no hot key: each
key of it holds less than one part in ``FREQUENT`` of all occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fiscus.llm.pretokens import MEMO_KEY, Memo, byte_level_pretokens, sections, spaced_chunks, special_pattern
from fiscus.shared import stored

FREQUENT = 1_000_000
FREQUENT_CHARS = 64  # longer pre-tokens are never broadcast, so the table's bytes are bounded too
MEMO_CHUNKS = 300_000
MEMO_CUTS = 50_000
DISTINCT_IN_TASK = 400_000
CHARS_IN_TASK = 32_000_000
TEXTS_AT_ONCE = 512


class PretokenCounter:
    """Cuts texts into pre-tokens and counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = special_pattern(tuple(sorted((t.content for t in added), key=len, reverse=True)))
        self.names = {t.content for t in added}
        self.separator = max(self.names, key=len, default="")
        self.chunks = Memo(byte_level_pretokens, MEMO_CUTS)
        self.spaced = Memo(lambda chunk: byte_level_pretokens(" " + chunk), MEMO_CUTS)

    def chunks_of(self, text: str, plain: list[str], spaced: list[str], special: list[str]) -> None:
        """Sort the text's parts into chunks, chunks after a single space, and special strings."""
        for section in sections(text, self.special):
            if section in self.names:
                special.append(section)
            else:
                first, rest = spaced_chunks(section)
                plain += first
                spaced += rest

    def frequencies(self, texts: list[str]) -> Counter:
        """How often each pre-token occurs; special strings are pre-tokens of their own."""
        seen = ChunkCounts(self)
        seen.add(texts)
        return seen.pretokens()

    def split_frequencies(self, text: str, known: KnownPieces) -> tuple[int, Counter]:
        """Pieces of all known pre-tokens of a text, and the frequencies of the others."""
        plain: list[str] = []
        spaced: list[str] = []
        special: list[str] = []
        self.chunks_of(text, plain, spaced, special)
        sure, rare = len(special), Counter()
        for pieces, chunks in ((known.chunks, plain), (known.spaced, spaced)):
            sure += sum(map(pieces.__getitem__, chunks))
            for chunk in filter(pieces.others.__contains__, chunks):
                for pretoken in pieces.others[chunk]:
                    rare[pretoken] += 1
            pieces.trim()
        return sure, rare

    def pieces(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token, encoded in one call with a special string between them."""
        if not self.separator:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]
        between = self.tokenizer.token_to_id(self.separator)
        plain = [p for p in pretokens if p not in self.names]
        ids = self.tokenizer.encode_batch_fast([self.separator.join(plain)], add_special_tokens=False)[0].ids
        lengths = iter(_runs(ids, between))
        return [1 if p in self.names else next(lengths) for p in pretokens]


class ChunkCounts:
    """Frequencies of the chunks of many texts; each distinct chunk is cut into pre-tokens once, at the end."""

    def __init__(self, own: PretokenCounter):
        self.own, self.special, self.chars = own, Counter(), 0
        self.plain: Counter = Counter()
        self.spaced: Counter = Counter()

    def add(self, texts: list[str]) -> None:
        plain: list[str] = []
        spaced: list[str] = []
        special: list[str] = []
        for text in texts:
            self.own.chunks_of(text, plain, spaced, special)
            self.chars += len(text)
        self.plain.update(plain)
        self.spaced.update(spaced)
        self.special.update(special)

    def is_full(self) -> bool:
        """Bounded in number and, as keys are parts of the texts, in bytes."""
        return len(self.plain) + len(self.spaced) >= DISTINCT_IN_TASK or self.chars >= CHARS_IN_TASK

    def pretokens(self) -> Counter:
        found = Counter(self.special)
        for memo, counts in ((self.own.chunks, self.plain), (self.own.spaced, self.spaced)):
            for chunk, n in counts.items():
                for pretoken in memo[chunk]:
                    found[pretoken] += n
        return found


class ChunkPieces(dict):
    """For each chunk the pieces of its known pre-tokens; in ``others`` its other pre-tokens, if it has any.

    Chunks longer than ``MEMO_KEY`` are forgotten after their text, all when there are too many.
    """

    def __init__(self, pieces: dict[str, int], before: str):
        super().__init__()
        self.pieces, self.before = pieces, before
        self.others: dict[str, list[str]] = {}
        self.long: list[str] = []

    def __missing__(self, chunk: str) -> int:
        total, others = 0, []
        for pretoken in byte_level_pretokens(self.before + chunk):
            n = self.pieces.get(pretoken)
            if n is None:
                others.append(pretoken)
            else:
                total += n
        if others:
            self.others[chunk] = others
        if len(chunk) > MEMO_KEY:
            self.long.append(chunk)
        self[chunk] = total
        return total

    def trim(self) -> None:
        for chunk in self.long:
            del self[chunk]
            self.others.pop(chunk, None)
        self.long.clear()
        if len(self) > MEMO_CHUNKS:
            self.clear()
            self.others.clear()


class KnownPieces:
    """Chunks as they are, and chunks that a single space precedes."""

    def __init__(self, pieces: dict[str, int]):
        self.chunks, self.spaced = ChunkPieces(pieces, ""), ChunkPieces(pieces, " ")


def _runs(ids: list[int], between: int) -> Iterator[int]:
    run = 0
    for i in ids:
        if i == between:
            yield run
            run = 0
        else:
            run += 1
    yield run


@lru_cache(maxsize=2)
def counter(path: str) -> PretokenCounter:
    """One counter for each worker process and vocabulary."""
    return PretokenCounter(path)


def pretoken_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``pretoken``, ``occurrences`` and ``pieces`` of every distinct pre-token of the texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        seen = ChunkCounts(own)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                texts = batch.column(0).slice(at, TEXTS_AT_ONCE).to_pylist()
                seen.add([text or "" for text in texts])
                if seen.is_full():
                    yield _counted(seen.pretokens())
                    seen = ChunkCounts(own)
        yield _counted(seen.pretokens())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            pieces = own.pieces(batch.column(0).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.int64())], names=["pretoken", "occurrences", "pieces"]
            )

    return (
        docs.select(text_col)
        .mapInArrow(distinct, "pretoken string, n long")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("occurrences"))
        .mapInArrow(counted, "pretoken string, occurrences long, pieces long")
    )


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pretoken", "n"]
    )


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    Null texts count as empty. Rows that repeat an id are counted each on its
    own; null ids are allowed. An empty table gives an empty result; further
    columns are ignored.
    """
    docs = docs.select(id_col, text_col)
    table = stored(pretoken_table(docs, path, text_col), "pretokens")
    total = table.agg(F.sum("occurrences")).first()[0] or 0
    frequent = {
        row.pretoken: row.pieces
        for row in table.filter(
            (F.col("occurrences") * FREQUENT >= total) & (F.length("pretoken") <= FREQUENT_CHARS)
        ).toLocalIterator()
    }
    broadcast = docs.sparkSession.sparkContext.broadcast(frequent)
    # Only where ids repeat does a text need a mark of its own beside its id.
    marked = not docs.groupBy(id_col).count().filter("count > 1").isEmpty()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each rare pre-token of a text; the first carries what is already known of the text.

        A text without rare pre-tokens gets one that no text has, so that it passes the join as well.
        """
        own, known = counter(path), KnownPieces(broadcast.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, marks, names, times, sums, sizes = [], [], [], [], [], []
            for k, text in enumerate(texts):
                raw = (text or "").encode()
                mark = xxhash.xxh3_64_intdigest(raw) - 2**63
                sure, others = own.split_frequencies(text or "", known)
                rare = list(others.items()) or [(f"\0{mark % 4096}", 0)]
                mark = mark if marked else 0
                row += [k] * len(rare)
                marks += [mark] * len(rare)
                names += [r[0] for r in rare]
                times += [r[1] for r in rare]
                sums += [sure] + [0] * (len(rare) - 1)
                sizes += [len(raw)] + [None] * (len(rare) - 1)
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(marks, pa.int64()), pa.array(names, pa.string()), pa.array(times, pa.int64()),
                 pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())],
                names=[id_col, "mark", "pretoken", "n", "sure", "n_bytes"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.mapInArrow(
        frequencies, f"{id_col} {kind}, mark long, pretoken string, n long, sure long, n_bytes long"
    )
    rare = table.filter((F.col("occurrences") * FREQUENT < total) | (F.length("pretoken") > FREQUENT_CHARS))
    summed = (
        rows.join(rare.select("pretoken", "pieces"), "pretoken", "left")
        .groupBy(id_col, "mark")
        .agg(
            F.sum(F.col("sure") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("sum"),
            F.max("n_bytes").alias("n_bytes"),
            F.count("n_bytes").alias("copies"),
        )
    )
    # Rows of one id and one text were summed together; each gets its share back.
    return (
        summed.withColumn("n_tokens", (F.col("sum") / F.col("copies")).cast("long"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
