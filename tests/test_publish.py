from __future__ import annotations

import pytest

from fiscus.plans.projection_plan import project_revenue, publishable_revenue
from fiscus.schema import UPDATED_AT
from fiscus.shared import shared_folder
from fiscus.sinks import publish
from fiscus.sinks.publish import publish_jdbc, publish_parquet, publish_table
from tests.conftest import fact_row, make_fact


@pytest.fixture(scope="module")
def result(spark):
    fact = make_fact(spark, [fact_row(collected="100"), fact_row(origin="12", collected="7")])
    return publishable_revenue(project_revenue(fact))


def without_stamp(frame):
    return sorted(repr(row) for row in frame.drop(UPDATED_AT).collect())


def test_parquet_is_replaced_and_read_back(result, tmp_path):
    path = str(tmp_path / "published")
    publish_parquet(result.limit(1), path)
    published = publish_parquet(result, path)
    assert len(published.columns) == 25
    assert published.dtypes == result.dtypes
    assert without_stamp(published) == without_stamp(result)
    stamps = {row[0] for row in published.select(UPDATED_AT).collect()}
    assert len(stamps) == 1 and len(stamps.pop()) == len("2021-02-01 10:11:12")


def test_catalog_table_is_replaced_and_read_back(spark, result):
    publish_table(result.limit(1), "published_revenue")
    published = publish_table(result, "published_revenue")
    assert without_stamp(published) == without_stamp(result)
    spark.sql("DROP TABLE published_revenue")


class DatabaseRecorder:
    """Stands in for the session's reader: answers the count that the database would give."""

    def __init__(self, count):
        self.count, self.calls = count, []

    def format(self, name):
        self.calls.append(("format", name))
        return self

    def options(self, **options):
        self.calls.append(("options", options))
        return self

    def load(self):
        return self

    def first(self):
        return [self.count]


class ResultRecorder:
    """Stands in for a result frame: keeps the writer's calls."""

    def __init__(self, count):
        self.calls = []
        self.write = self
        self.sparkSession = type("Session", (), {"read": DatabaseRecorder(count)})()

    def format(self, name):
        self.calls.append(("format", name))
        return self

    def mode(self, name):
        self.calls.append(("mode", name))
        return self

    def options(self, **options):
        self.calls.append(("options", options))
        return self

    def save(self):
        self.calls.append("save")


@pytest.fixture
def three_rows(monkeypatch):
    def count_three(result, write):
        write(result)
        return 3

    monkeypatch.setattr(publish, "counted_write", count_three)


def test_database_table_is_replaced_and_counted_by_the_database(three_rows):
    options = {"url": "jdbc:x:y", "dbtable": "t"}
    frame = ResultRecorder(3)
    publish_jdbc(frame, {**options, "numPartitions": "4"})
    assert frame.calls == [
        ("format", "jdbc"), ("mode", "overwrite"), ("options", {**options, "numPartitions": "4"}), "save"
    ]
    assert frame.sparkSession.read.calls == [
        ("format", "jdbc"), ("options", {"url": "jdbc:x:y", "dbtable": "(SELECT count(*) AS n FROM t) q"})
    ]


def test_rows_written_twice_are_noticed(three_rows):
    with pytest.raises(RuntimeError, match="4 rows instead of 3"):
        publish_jdbc(ResultRecorder(4), {"url": "jdbc:x:y", "dbtable": "t"})


def test_a_lost_file_is_noticed(spark, tmp_path, monkeypatch):
    path = tmp_path / "published"
    write_all = publish.counted_write

    def write_and_lose(result, write):
        rows = write_all(result, write)
        next(file for file in sorted(path.glob("part-*.parquet"), key=lambda f: -f.stat().st_size)).unlink()
        return rows

    monkeypatch.setattr(publish, "counted_write", write_and_lose)
    with pytest.raises(RuntimeError, match="instead of 40"):
        publish_parquet(spark.range(40).repartition(4), str(path))


def test_publishing_runs_the_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(25).repartition(3).mapInArrow(count, "id long")
    assert publish_parquet(frame, str(tmp_path / "once")).count() == 25
    assert seen.value == 25


def test_shared_folder_needs_the_setting_on_a_cluster():
    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.conf = type("Conf", (dict,), {"set": dict.__setitem__})(self.conf)
            self.sparkContext = type("Context", (), {"master": master})()

    assert shared_folder(Session("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    local = Session("local[4]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"))
