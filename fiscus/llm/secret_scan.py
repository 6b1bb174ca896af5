"""Secrets in texts: fixed forms, and strings whose sliding-window entropy is too high for words.

*Fixed forms* are assignments to names such as ``password``, access keys and long hexadecimal runs.

*Entropy.* Candidates are runs of one character class that are at least a window long. A window slides over
each; its Shannon entropy follows from the sum of ``c * log2(c)`` over the counts of its characters. A step
changes two counts, so the sum is kept up to date from a table of differences, in whole numbers, without
rounding errors that add up. Windows that reach the class's entropy and mix letters with digits are hits; those that
overlap or touch are one span.

*Allow list.* An entropy span is left out if it lies within a match of an allowed pattern (addresses,
UUIDs, integrity digests, embedded data) or holds an allowed part (placeholders, alphabets). Spans of fixed forms are never suppressed.
An entropy span within a span of an earlier kind adds nothing and is left out as well.

Each text is scanned whole in one pass per form; work is linear in its length, whatever it holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long>>"
BASE_KINDS = ("assign", "access", "hex")
LEAST_SECRET = 8

# The base forms. Assignments are searched in lower-cased text.
_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")

# What high entropy does not give away.
ALLOWED_PATTERNS = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"https?://[^\x00-\x20\"'<>?#]+",
    r"sha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+",
    r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
)
ALLOWED_PARTS = ("EXAMPLE", "example", "abcdefghij", "ABCDEFGHIJ", "0123456789")

SCALE = 2**20


def scaled_terms(window: int) -> list[int]:
    """``c * log2(c)`` for counts up to a window's length, in whole parts of ``SCALE``."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``characters`` in which windows of ``window`` characters reach ``bits`` of entropy a character."""

    kind: str
    characters: str
    window: int
    bits: float

    @cached_property
    def runs(self) -> re.Pattern:
        return re.compile(f"[{self.characters}]{{{self.window},}}".encode())

    @cached_property
    def most(self) -> int:
        """The greatest sum of terms that a window may have."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * SCALE)

    @cached_property
    def steps(self) -> list[int]:
        """How the sum grows when a count goes up by one."""
        terms = scaled_terms(self.window)
        return [after - before for before, after in zip(terms, terms[1:])]

    def spans(self, data: bytes) -> Iterator[tuple[int, int]]:
        for run in self.runs.finditer(data):
            yield from self.spans_of_run(run.group(), run.start())

    def spans_of_run(self, run: bytes, offset: int) -> Iterator[tuple[int, int]]:
        """Merged hits in one run, at byte places of the text."""
        window, most, steps = self.window, self.most, self.steps
        counts = [0] * 256
        total = digits = 0
        start = end = -1
        for at, byte in enumerate(run):
            if at >= window:
                old = run[at - window]
                counts[old] -= 1
                total -= steps[counts[old]]
                digits -= 0x30 <= old <= 0x39
            total += steps[counts[byte]]
            counts[byte] += 1
            digits += 0x30 <= byte <= 0x39
            if at + 1 >= window and total <= most and 0 < digits and self._has_letter(counts, digits):
                first = at + 1 - window
                if end < first:
                    if end > 0:
                        yield offset + start, offset + end
                    start = first
                end = at + 1
        if end > 0:
            yield offset + start, offset + end

    def _has_letter(self, counts: list[int], digits: int) -> bool:
        others = sum(counts[c] for c in b"+/_=-")
        return digits + others < self.window


CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", window=24, bits=3.0),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", window=20, bits=3.8),
)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed forms, in bytes."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(data.lower()) if m.end(2) - m.start(2) >= LEAST_SECRET]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(data)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(data)]
    return found


def _outside(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the ordered spans that lie in no cover, in one walk over both."""
    left, reach, at = [], -1, 0
    covers = sorted(covers)
    for start, end in spans:
        while at < len(covers) and covers[at][0] <= start:
            reach = max(reach, covers[at][1])
            at += 1
        if reach < end:
            left.append((start, end))
    return left


class Scanner:
    def __init__(self, classes: tuple[EntropyClass, ...], patterns: tuple[str, ...], parts: tuple[str, ...]):
        self.classes = classes
        self.kinds = BASE_KINDS + tuple(c.kind for c in classes)
        self.patterns = [re.compile(p.encode()) for p in patterns]
        self.parts = [p.encode() for p in parts]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, kind number) in code points, by start and kind."""
        found = base_spans(data)
        covers = [(start, end) for start, end, _ in found]
        allowed = None
        for number, own in enumerate(self.classes, len(BASE_KINDS)):
            hits = [(s, e) for s, e in own.spans(data) if not any(part in data[s:e] for part in self.parts)]
            if not hits:
                continue
            if allowed is None:
                allowed = [m.span() for pattern in self.patterns for m in pattern.finditer(data)]
            hits = _outside(hits, covers + allowed)
            found += [(start, end, number) for start, end in hits]
            covers += hits
        return in_code_points(data, sorted(found, key=lambda span: (span[0], span[2])))


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans with places counted in code points; each place is looked up once, in order."""
    if not spans or data.isascii():
        return spans
    places, at, points = {}, 0, 0
    for place in sorted({p for start, end, _ in spans for p in (start, end)}):
        points += len(data[at:place].decode())
        places[place] = points
        at = place
    return [(places[start], places[end], kind) for start, end, kind in spans]


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: tuple[EntropyClass, ...] = CLASSES,
    allowed_patterns: tuple[str, ...] = ALLOWED_PATTERNS,
    allowed_parts: tuple[str, ...] = ALLOWED_PARTS,
) -> DataFrame:
    """``id_col`` and ``secrets``, an array of (kind, start, end), of every row.

    Places count code points, ends are exclusive; spans are ordered by start, then by kind: ``assign``, ``access``,
    ``hex``, then the entropy classes. Null and empty texts have none. Rows are independent of each other, so
    repeated and null ids are treated like all others. Texts are scanned whole, also very long ones.
    An empty table gives an empty result; further columns are ignored.
    """
    scanner = Scanner(classes, allowed_patterns, allowed_parts)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = scanner.kinds
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [
                [{"kind": kinds[k], "start": s, "end": e} for s, e, k in scanner.spans(data)] if data else []
                for data in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["id", "secrets"])

    data = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    id_type = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(scanned, f"id {id_type}, secrets {SPANS}").withColumnRenamed("id", id_col)


def digest_secrets(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed forms, the digest of their list, and the list of all spans as text."""

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def of_kind(*kinds: str):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    return found.select(
        id_col,
        *(F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(listed(of_kind(*BASE_KINDS)), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
