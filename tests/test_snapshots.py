"""Publication as snapshots, and the fingerprint that guards their content."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fiscus.sinks import snapshots as snap
from fiscus.sinks.fingerprint import fingerprint, fingerprints_by
from fiscus.sinks.snapshots import (
    publish_snapshot, publish_table_snapshot, read_snapshot, release_snapshots, snapshot_entry, snapshots,
)


def table(spark, first, last):
    return spark.range(first, last).select("id", (F.col("id") / 3).alias("amount"), F.when(F.col("id") % 7 > 0, "x").alias("note"))


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "published")


def test_readers_see_the_old_or_the_new_snapshot(spark, root):
    first, second = table(spark, 0, 50), table(spark, 20, 90)
    publish_snapshot(first, root)
    begun = read_snapshot(spark, root)  # a reader that has listed its files already
    assert rows(publish_snapshot(second, root)) == rows(second)
    assert rows(begun) == rows(first)
    assert rows(read_snapshot(spark, root)) == rows(second)
    assert rows(read_snapshot(spark, root, version=1)) == rows(first)
    assert [(r.version, r.rows) for r in snapshots(spark, root).orderBy("version").collect()] == [(1, 50), (2, 70)]


def test_a_write_that_breaks_leaves_the_old_snapshot(spark, root):
    first = table(spark, 0, 50)
    publish_snapshot(first, root)
    broken = table(spark, 0, 80).withColumn(
        "amount", F.when(F.col("id") == 79, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("amount"))
    )
    with pytest.raises(PySparkException):
        publish_snapshot(broken, root)
    assert rows(read_snapshot(spark, root)) == rows(first) and snapshot_entry(spark, root).version == 1


def test_stored_content_that_differs_is_never_made_current(spark, root, monkeypatch):
    publish_snapshot(table(spark, 0, 5), root)
    taken = snap.fingerprint
    monkeypatch.setattr(snap, "fingerprint", lambda stored: taken(stored.filter("id <> 3").union(stored.filter("id = 4"))))
    with pytest.raises(RuntimeError, match="differs"):
        publish_snapshot(table(spark, 0, 9), root)
    assert rows(read_snapshot(spark, root)) == rows(table(spark, 0, 5))


def test_released_snapshots_go_and_broken_ones_when_asked(spark, root):
    for last in (3, 4, 5, 6):
        publish_snapshot(table(spark, 0, last), root)
    with pytest.raises(PySparkException):
        publish_snapshot(table(spark, 0, 9).withColumn("amount", F.raise_error(F.lit("lost")).cast("double")), root)
    assert len(release_snapshots(spark, root, keep=2)) == 2
    assert read_snapshot(spark, root).count() == 6 and read_snapshot(spark, root, 3).count() == 5
    with pytest.raises(PySparkException):
        read_snapshot(spark, root, 1).count()
    assert len(release_snapshots(spark, root, keep=1, unlisted=True)) >= 1
    assert read_snapshot(spark, root).count() == 6
    with pytest.raises(ValueError):
        release_snapshots(spark, root, keep=0)


def test_nothing_published_yet(spark, root):
    with pytest.raises(LookupError):
        read_snapshot(spark, root)
    assert snapshots(spark, root).count() == 0 and release_snapshots(spark, root) == []
    assert publish_snapshot(table(spark, 0, 0), root).count() == 0


def test_a_catalog_table_moves_to_the_new_location(spark, root):
    publish_table_snapshot(table(spark, 0, 5), "moved_table", root)
    before = spark.table("moved_table")
    publish_table_snapshot(table(spark, 3, 9), "moved_table", root)
    assert rows(spark.table("moved_table")) == rows(table(spark, 3, 9))
    assert rows(before) == rows(table(spark, 0, 5))
    with pytest.raises(ValueError):
        publish_table_snapshot(table(spark, 0, 5).drop("note"), "moved_table", root)
    assert rows(spark.table("moved_table")) == rows(table(spark, 3, 9))
    spark.sql("DROP TABLE moved_table")


def test_the_fingerprint_notices_what_counts_alone_do_not(spark):
    frame = table(spark, 0, 40)
    same = fingerprint(frame)
    assert fingerprint(frame.repartition(7).orderBy(F.desc("id"))) == same
    assert fingerprint(frame.select("note", "id", "amount")) == same
    doubled = frame.filter("id <> 3").union(frame.filter("id = 5"))
    changed = frame.withColumn("amount", F.when(F.col("id") == 3, 1.5).otherwise(F.col("amount")))
    swapped = spark.createDataFrame([(None, 1), (2, None)], "a long, b long")
    other = spark.createDataFrame([(1, None), (None, 2)], "a long, b long")
    assert fingerprint(doubled).rows == same.rows
    assert len({same, fingerprint(doubled), fingerprint(changed)}) == 3
    assert fingerprint(swapped) != fingerprint(other)
    nested = spark.createDataFrame([([1, None], 1)], "a array<long>, b long")
    assert fingerprint(nested) != fingerprint(spark.createDataFrame([([None, 1], 1)], "a array<long>, b long"))
    groups = {r.note: r.rows for r in fingerprints_by(frame, "note").collect()}
    assert groups == {None: 6, "x": 34}
