"""Intermediate tables go when they are not needed any more, results stay."""

from __future__ import annotations

import os

import pytest

from fiscus.shared import scratch, stored


def folder(frame):
    return os.path.dirname(frame.inputFiles()[0].removeprefix("file://"))


def test_scratch_tables_go_and_results_stay(spark):
    before = stored(spark.range(3).toDF("a"), "before")
    with scratch(spark):
        inner = stored(spark.range(4).toDF("a"), "inner")
        with scratch(spark):
            gone, kept = folder(stored(spark.range(5).toDF("a"), "gone")), stored(spark.range(6).toDF("a"), "kept", outlives=True)
        assert not os.path.exists(gone) and kept.count() == 6
        result = stored(inner.union(kept), "result", outlives=True)
        left = [folder(inner), folder(kept)]
    assert not any(map(os.path.exists, left))
    assert result.count() == 10 and before.count() == 3


def test_scratch_tables_go_after_an_error(spark):
    with pytest.raises(KeyError), scratch(spark):
        gone = folder(stored(spark.range(5).toDF("a"), "gone"))
        raise KeyError
    assert not os.path.exists(gone)
