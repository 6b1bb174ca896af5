from __future__ import annotations

import re
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscus.functions.numbers import locale_number
from fiscus.plans.projection_plan import project_revenue
from fiscus.schema import AMOUNT, COLLECTED, FACT_SCHEMA, MEASURES, Horizon
from fiscus.sources.fact import conform_fact, read_fact_jdbc, read_fact_parquet, read_fact_table
from fiscus.sources.manual import MANUAL_ROWS, manual_rows, paid_until
from fiscus.sources.parameters import Parameters, macro_index, nominal_gdp, selic_growth
from tests.conftest import fact_row, make_fact

TEXTS = {
    "1234,56": 1234.56, "1234.56": 1234.56, "0": 0.0, "-5,5": -5.5, " 7,25 ": 7.25, "1e3": 1000.0,
    "1.234,56": None, "abc": None, "": None, "1,5d": None, "2f": None,
}


def test_numbers_with_either_decimal_mark(spark):
    frame = spark.createDataFrame([(text,) for text in [*TEXTS, None]], "text string")
    found = {r.text: r.value for r in frame.withColumn("value", locale_number(F.col("text"))).collect()}
    assert found == {**TEXTS, None: None}


def test_text_measures_are_parsed_and_columns_selected_by_name(spark):
    fact = make_fact(spark, [fact_row(collected="12.34")])
    text = fact.select(
        F.lit("extra").alias("other"),
        *[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in reversed(MEASURES)],
        *[F.col(c) for c in fact.columns if c not in MEASURES],
    ).withColumn("num_ano", F.col("num_ano").cast("bigint"))
    conformed = conform_fact(text)
    assert conformed.columns == FACT_SCHEMA.names
    assert {f.dataType for f in conformed.schema if f.name in MEASURES} == {AMOUNT}
    assert conformed.collect()[0][COLLECTED] == Decimal("12.34")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="num_mes"):
        conform_fact(make_fact(spark, [fact_row()]).drop("num_mes"))


def test_parquet_and_catalog_sources(spark, tmp_path):
    fact = make_fact(spark, [fact_row(year=2019), fact_row(year=2020)])
    fact.write.partitionBy("num_ano").parquet(str(tmp_path / "fact"))
    assert sorted(read_fact_parquet(spark, str(tmp_path / "fact")).collect()) == sorted(fact.collect())
    fact.createOrReplaceTempView("sample_fact")
    assert sorted(read_fact_table(spark, "sample_fact").collect()) == sorted(fact.collect())


class JdbcRecorder:
    """Stands in for the session: keeps what the reader was asked for."""

    def __init__(self, frame):
        self.frame, self.calls = frame, []
        self.read = self

    def jdbc(self, url, table, predicates, properties):
        self.calls.append(("jdbc", url, table, predicates, properties))
        return self.frame

    def format(self, name):
        self.calls.append(("format", name))
        return self

    def options(self, **options):
        self.calls.append(("options", options))
        return self

    def load(self):
        return self.frame


def test_jdbc_options_come_from_the_caller(spark):
    fact = make_fact(spark, [fact_row()])
    options = {"url": "jdbc:x:y", "dbtable": "t", "user": "u"}
    with pytest.raises(ValueError, match="partitionColumn"):
        read_fact_jdbc(JdbcRecorder(fact), options)
    split = {"partitionColumn": "num_ano", "lowerBound": "2010", "upperBound": "2021"}
    with pytest.raises(ValueError, match="missing: numPartitions"):
        read_fact_jdbc(JdbcRecorder(fact), {**options, **split})
    split["numpartitions"] = "12"
    recorder = JdbcRecorder(fact)
    assert read_fact_jdbc(recorder, {**options, **split}).count() == 1
    assert recorder.calls == [("format", "jdbc"), ("options", {**options, **split})]
    recorder = JdbcRecorder(fact)
    read_fact_jdbc(recorder, options, predicates=["num_ano = 2019", "num_ano = 2020"])
    assert recorder.calls == [
        ("jdbc", "jdbc:x:y", "t", ["num_ano = 2019", "num_ano = 2020"], {"user": "u"})
    ]


def test_derived_parameters():
    parameters = Parameters.default()
    assert parameters.value("ANFAVEA", 2020) == 0.97
    assert parameters.value("ANFAVEA", 2021) == 1.0357 * 1.025 * 0.97
    assert parameters.value("SELIC_RATIO", 2021) == 0.0525 / 0.0375
    assert parameters.deflator(2019, 2020) == 1.0305
    assert parameters.deflator(2019, 2023) == 1.0305 * 1.0357 * 1.035 * 1.035
    # The last fleet factor repeats the indices of the year before it.
    moved = parameters.replace({("IPCA", 2023): 9.0})
    assert moved.value("ANFAVEA", 2023) == parameters.value("ANFAVEA", 2022)
    with pytest.raises(KeyError, match="XYZ"):
        parameters.value("XYZ", 2020)


def test_parameter_rows_hold_given_and_derived_values(spark):
    rows = {(r.indicator, r.ref_year): r.value for r in macro_index(spark, Parameters.default()).collect()}
    assert rows[("IPCA", 2021)] == 1.0357
    assert rows[("FX", 2019)] == 4.1
    assert rows[("ANFAVEA", 2023)] == 1.035 * 1.025 * 0.97
    assert rows[("SELIC", 2019)] == 0.065
    assert len(rows) == 45


def test_nominal_gdp_chain(spark):
    found = {r.ref_year: r.nominal_gdp for r in nominal_gdp(macro_index(spark, Parameters.default())).collect()}
    expected = {2017: 275400000000.0, 2018: 298381000000.0, 2019: 317300000000.0}
    growth = {2020: (1.0002, 1.0305), 2021: (1.025, 1.0357), 2022: (1.025, 1.035), 2023: (1.025, 1.035)}
    for year, (real, prices) in growth.items():
        expected[year] = expected[year - 1] * real * prices
    assert found.keys() == expected.keys()
    for year, value in expected.items():
        assert found[year] == pytest.approx(value, rel=1e-14)


def test_nominal_gdp_stays_zero_after_a_zero_factor(spark):
    stopped = Parameters.default().replace({("PIB", 2021): 0.0})
    found = {r.ref_year: r.nominal_gdp for r in nominal_gdp(macro_index(spark, stopped)).collect()}
    assert found[2020] > 0 and found[2021] == found[2022] == found[2023] == 0.0


def test_selic_growth(spark):
    found = {r.ref_year: r.selic_ratio for r in selic_growth(macro_index(spark, Parameters.default())).collect()}
    assert found == {2020: 0.0375 / 0.065, 2021: 0.0525 / 0.0375, 2022: 0.06 / 0.0525, 2023: 0.0625 / 0.06}


def test_manual_rows(spark):
    rows = {r.cod_detalhamento: r for r in manual_rows(spark, Parameters.default(), Horizon()).collect()}
    assert len(rows) == 4
    payroll = rows["1360011101"]
    assert payroll.ldo == "S"
    assert payroll.projecao_receita_arrecadada_liquida2022 == 12 * (101055919.23 / 40)
    assert payroll.projecao_receita_arrecadada_liquida2023 == 0.0
    assert rows["1990992101"].projecao_receita_arrecadada_liquida2023 == 28962264 * 1.0357 * 1.035 * 1.035
    assert rows["2119001100"].projecao_receita_arrecadada_liquida2021 == 512000000.0
    assert rows["2128015100"].projecao_receita_arrecadada_liquida2020 == 37695571.0
    assert {r.ldo for code, r in rows.items() if code != "1360011101"} == {"N"}
    assert all(r.receita_arrecadada_liquida == r.receita_orcada_liquida == 0 for r in rows.values())


def with_amounts(spark, values, kind):
    fact = make_fact(spark, [fact_row()]).drop(COLLECTED)
    amounts = spark.createDataFrame([(value,) for value in values], f"{COLLECTED} {kind}")
    return conform_fact(fact.crossJoin(amounts))


def test_unreadable_amounts_stop_the_query_with_column_and_value(spark):
    for text in ("1.234,56", "abc", "0,123456789"):
        with pytest.raises(Exception, match=f"unreadable amount in {COLLECTED}: {text}"):
            with_amounts(spark, [text], "string").collect()
    with pytest.raises(Exception, match=f"unreadable amount in {COLLECTED}: NaN"):
        with_amounts(spark, [float("nan")], "double").collect()


def test_blank_and_null_amounts_stay_null(spark):
    found = [row[COLLECTED] for row in with_amounts(spark, [" ", "", None, "7,5"], "string").collect()]
    assert sorted(found, key=str) == [Decimal("7.50000000"), None, None, None]


@pytest.mark.parametrize(("value", "kind"), [("0,004", "string"), (Decimal("0.0040"), "decimal(20,4)"), (0.004, "double")])
def test_small_amounts_are_not_rounded_before_the_sum(spark, value, kind):
    total = with_amounts(spark, [value] * 1000, kind).agg(F.sum(COLLECTED)).first()[0]
    assert total == Decimal(4)


@pytest.mark.parametrize("folders", [["cod_fonte_recurso"], ["cod_unidade_gestora"], ["num_ano", "cod_origem"]])
def test_codes_stay_text_in_every_layout(spark, tmp_path, folders):
    rows = [
        fact_row(origin="17", name="Convênio", fund=fund, nature="1718101100", unit=unit, year=year, collected="5")
        for fund in ("0128000000", "0100000000") for unit in ("052001", "520099") for year in (2019, 2020)
    ]
    fact = make_fact(spark, rows)
    fact.write.partitionBy(*folders).parquet(str(tmp_path / "fact"))
    read = read_fact_parquet(spark, str(tmp_path / "fact"))
    assert read.dtypes == fact.dtypes
    assert sorted(map(repr, project_revenue(read).collect())) == sorted(map(repr, project_revenue(fact).collect()))
    one = read.filter(F.col(folders[0]) == rows[0][FACT_SCHEMA.names.index(folders[0])])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{folders[0]}#\d+ = ", plan)


def test_codes_stored_as_numbers_are_refused(spark, tmp_path):
    path = str(tmp_path / "numbers")
    make_fact(spark, [fact_row()]).withColumn("cod_fonte_recurso", F.lit(128000000)).write.parquet(path)
    with pytest.raises(ValueError, match="cod_fonte_recurso"):
        read_fact_parquet(spark, path)


def test_a_newer_given_product_starts_a_new_chain(spark):
    later = Parameters.default().replace({("PIB_SC", 2021): 400e9})
    found = {r.ref_year: r.nominal_gdp for r in nominal_gdp(macro_index(spark, later)).collect()}
    assert found[2021] == 400e9
    assert found[2022] == pytest.approx(400e9 * 1.025 * 1.035, rel=1e-14)
    assert found[2020] == pytest.approx(317300000000.0 * 1.0002 * 1.0305, rel=1e-14)


def test_fleet_factors_for_every_year_with_both_indices(spark):
    later = Parameters.default().replace({("IPCA", 2024): 1.03, ("PIB", 2024): 1.02})
    found = {(r.indicator, r.ref_year): r.value for r in macro_index(spark, later).collect()}
    assert found[("ANFAVEA", 2024)] == later.value("ANFAVEA", 2024) == 1.03 * 1.02 * 0.97
    kept = {key: value for key, value in Parameters.default().values.items() if key != ("IPCA", 2022)}
    fewer = {r.ref_year for r in macro_index(spark, Parameters(kept)).collect() if r.indicator == "ANFAVEA"}
    assert fewer == {2020, 2021}


def test_manual_rows_go_by_calendar_year_and_are_an_argument(spark):
    def prodec(horizon):
        rows = manual_rows(spark, Parameters.default(), horizon).collect()
        return next(r for r in rows if r.cod_detalhamento == "1990992101")

    early, late = prodec(Horizon(2019, 2023)), prodec(Horizon(2020, 2023))
    assert early.projecao_receita_arrecadada_liquida2021 == late.projecao_receita_arrecadada_liquida2021
    assert early.projecao_receita_arrecadada_liquida2021 == 28962264.0 * 1.0357
    fact = make_fact(spark, [fact_row(collected="1")])
    assert project_revenue(fact, manual=()).count() == 1
    extra = replace(MANUAL_ROWS[0], name="Novo contrato", amount=paid_until(2021, 10.0))
    only = project_revenue(fact, manual=(extra,)).filter("nom_detalhamento = 'Novo contrato'").collect()
    assert [r.projecao_receita_arrecadada_liquida2021 for r in only] == [10.0]
    assert [r.projecao_receita_arrecadada_liquida2022 for r in only] == [0.0]
