from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fiscus.schema import FACT_SCHEMA  # noqa: E402

SMALL_TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("fiscus-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(scratch / "warehouse"))
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(scratch / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def fact_row(origin="11", name="ICMS", account="62121000000", fund="0100000000", nature="1118021100",
             year=2019, month=1, unit="520099", collected="0", deduction="0", budgeted="0",
             budget_deduction="0"):
    def money(value):
        return None if value is None else Decimal(value).quantize(Decimal("0.01"))

    return (unit, account, origin, fund, nature, name, year, month,
            money(collected), money(deduction), money(budgeted), money(budget_deduction))


def make_fact(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)
