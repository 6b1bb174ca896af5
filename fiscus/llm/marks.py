"""A bitmap of wanted ids, of bounded size, that spares a shuffle of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.signatures import mixed

MARK_BITS = 2**26  # 8 MB, whatever the number of ids


class IdMarks:
    """Tells of every wanted id that it is wanted, and of few others.

    Two hashed bits stand for each id. Where the bound on the bitmap is tight, more others
    pass; none is missed. Null ids never pass.
    """

    def __init__(self, wanted: DataFrame, id_col: str = "id"):
        self.bits = min(MARK_BITS, 2 ** max(10, (16 * wanted.count()).bit_length()))
        bits, places = self.bits, self._places

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                    words, where = np.unique(at >> 6, return_inverse=True)
                    marks = np.zeros(len(words), np.uint64)
                    np.bitwise_or.at(marks, where, np.uint64(1) << (at & 63).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(marks.view(np.int64))], names=["word", "bits"])

        # Words of the bitmap are put together by all tasks; at most MARK_BITS / 64 of them come back.
        found = (
            wanted.select(F.col(id_col).cast("long")).mapInArrow(marked, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        )
        marks = np.zeros(bits >> 6, np.int64)
        marks[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        marks = marks.view(np.uint64)
        self.known = wanted.sparkSession.sparkContext.broadcast(marks)

    @staticmethod
    def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        numbers = ids.astype(np.int64).view(np.uint64)
        return [(mixed(numbers + salt) % np.uint64(bits)).astype(np.int64) for salt in (np.uint64(1), np.uint64(2**63))]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """For tasks: which of these ids may be wanted."""
        marks = self.known.value
        first, second = (marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) for at in self._places(ids, self.bits))
        return (first & second).astype(bool)

    def column(self, ids: Column) -> Column:
        """The same as a boolean column."""
        hits = self.hits

        @F.arrow_udf("boolean")
        def marked(values: pa.Array) -> pa.Array:
            found = np.zeros(len(values), bool)
            present = values.is_valid().to_numpy(zero_copy_only=False)
            found[present] = hits(values.drop_null().to_numpy(zero_copy_only=False))
            return pa.array(found)

        return marked(ids.cast("long"))

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "known": self.known}
