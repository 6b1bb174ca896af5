"""The registered queries: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.functions.numbers import locale_number
from fiscus.operators.adjust import consolidate_fund, deflate, derive_codes, relabel_year
from fiscus.operators.aggregate import net_sum, yearly_collection
from fiscus.operators.filters import revenue_accounts
from fiscus.operators.flags import flag_audit, flag_rcl, flag_rli
from fiscus.plans.catalogue import CATALOGUE, STACKED_PAIRS, rule_by_id
from fiscus.plans.projection_plan import (
    DEFAULT_HORIZON, category_slice, project_revenue, publishable_revenue, stacked_slices,
    stacked_with_manual_rows,
)
from fiscus.schema import (
    ACCOUNT, BUDGETED, BUDGETED_DEDUCTION, COLLECTED, COLLECTED_DEDUCTION, FUND, FUND_TYPE, KEYS, LABEL,
    MEASURES, MONTH, NATURE, NET_BUDGET, NET_COLLECTED, ORIGIN, RCL, RLI, SHORT_FUND, UPDATED_AT, YEAR,
)
from fiscus.shared import new_folder
from fiscus.sinks.publish import publish_parquet
from fiscus.sources.fact import conform_fact
from fiscus.sources.parameters import Parameters, macro_index, nominal_gdp, selic_growth
from testbed import more_queries
from testbed.lineitem_fact import fact_from_lineitem
from testbed.parameter_sets import REVISED

PARAMETERS = Parameters.default()
GROWTH_INDICATORS = ("IPCA", "PIB", "EF", "CVFS", "ANFAVEA", "COVID_EMPREGO")
GDP_KNOWN_LATER = PARAMETERS.replace({("PIB_SC", 2021): 400e9})

Query = Callable[[SparkSession, str], DataFrame]


def account_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_accounts(fact_from_lineitem(spark, sf_dir))


def locale_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as text: comma in odd months, point in even ones, thousands mark in December."""
    plain = F.col(COLLECTED).cast("string")
    comma = F.replace(plain, F.lit("."), F.lit(","))
    text = (
        F.when(F.col(MONTH) == 12, F.concat(F.lit("1."), comma))
        .when(F.col(MONTH) % 2 == 0, plain)
        .otherwise(comma)
    )
    return (
        fact_from_lineitem(spark, sf_dir)
        .select(NATURE, YEAR, MONTH, text.alias("texto"))
        .withColumn("valor", locale_number(F.col("texto")))
    )


def net_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        revenue_accounts(fact_from_lineitem(spark, sf_dir))
        .groupBy(*KEYS)
        .agg(
            net_sum(COLLECTED, COLLECTED_DEDUCTION).alias(NET_COLLECTED),
            net_sum(BUDGETED, BUDGETED_DEDUCTION).alias(NET_BUDGET),
            F.count("*").alias("lancamentos"),
        )
    )


def for_each_projected_year(rows: DataFrame) -> DataFrame:
    """Every row, once for each projected year."""
    years = F.array(*[F.lit(year) for year in DEFAULT_HORIZON.years])
    return rows.withColumn("ref_year", F.explode(years))


def indexed_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection by origin and year, moved by each growth index of each projected year."""
    collected = for_each_projected_year(yearly_collection(fact_from_lineitem(spark, sf_dir), ORIGIN))
    indices = macro_index(spark, PARAMETERS).filter(F.col("indicator").isin(*GROWTH_INDICATORS))
    # One row per indicator and parameter year, whatever the size of the fact table.
    return collected.join(F.broadcast(indices), "ref_year").select(
        ORIGIN, YEAR, "indicator", "ref_year", "value",
        (F.col(NET_COLLECTED) * F.col("value")).alias("valor_indexado"),
    )


def gdp_beside_collection(parameters: Parameters, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal product and collection of every parameter year and every fact year."""
    collected = yearly_collection(fact_from_lineitem(spark, sf_dir)).withColumnRenamed(YEAR, "ref_year")
    return (
        nominal_gdp(macro_index(spark, parameters))
        .join(collected, "ref_year", "full")
        .select("ref_year", "nominal_gdp", NET_COLLECTED)
    )


def selic_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of financial income of all years, moved by each year's change of the interest rate."""
    income = category_slice(fact_from_lineitem(spark, sf_dir), rule_by_id("c08")).select(*KEYS, NET_COLLECTED)
    growth = selic_growth(macro_index(spark, PARAMETERS))
    # One row per parameter year, whatever the size of the fact table.
    return for_each_projected_year(income).join(F.broadcast(growth), "ref_year").select(
        *KEYS, "ref_year", "selic_ratio",
        (F.col(NET_COLLECTED) * F.col("selic_ratio")).alias("valor_corrigido"),
    )


def text_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts stored as text with decimal comma and four decimals, read back and summed by key."""
    fact = fact_from_lineitem(spark, sf_dir)
    finer = {c: F.col(c).cast("decimal(20,4)") + F.lit(Decimal("0.0004")) for c in MEASURES}
    texts = {c: F.replace(amount.cast("string"), F.lit("."), F.lit(",")) for c, amount in finer.items()}
    return (
        conform_fact(fact.withColumns(texts))
        .groupBy(*KEYS)
        .agg(*[F.sum(c).cast("decimal(30,4)").alias(c) for c in MEASURES])
    )


def one_slice(slice_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_slice(fact_from_lineitem(spark, sf_dir), rule_by_id(slice_id))


def stacked_pair(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """An actual slice with its budget slice, in one pass."""
    rules = [rule_by_id(slice_id) for slice_id in STACKED_PAIRS[name]]
    return stacked_slices(fact_from_lineitem(spark, sf_dir), rules=rules)


def all_slices_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked_slices(fact_from_lineitem(spark, sf_dir))


def all_slices_one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from one query per slice; for comparison only, it scans once per slice."""
    fact = fact_from_lineitem(spark, sf_dir)
    return reduce(DataFrame.unionByName, [category_slice(fact, rule) for rule in CATALOGUE])


def union_with_manual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked_with_manual_rows(fact_from_lineitem(spark, sf_dir))


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = relabel_year(union_with_manual_rows(spark, sf_dir), DEFAULT_HORIZON)
    return stacked.select(LABEL, ACCOUNT, YEAR, NET_COLLECTED)


def one_treasury_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate_fund(union_with_manual_rows(spark, sf_dir)).select(LABEL, ACCOUNT, FUND, NET_COLLECTED)


def fund_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = consolidate_fund(union_with_manual_rows(spark, sf_dir))
    return derive_codes(stacked).select(LABEL, FUND, SHORT_FUND, FUND_TYPE)


def rcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_rcl(union_with_manual_rows(spark, sf_dir)).select(LABEL, NATURE, RCL)


def rli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_rli(union_with_manual_rows(spark, sf_dir)).select(LABEL, NATURE, ACCOUNT, RLI)


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_audit(union_with_manual_rows(spark, sf_dir))


def constant_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    deflated = deflate(union_with_manual_rows(spark, sf_dir), PARAMETERS, DEFAULT_HORIZON)
    return deflated.select(*KEYS, LABEL, *DEFAULT_HORIZON.deflated)


def revenue_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_revenue(fact_from_lineitem(spark, sf_dir))


def publish_parquet_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the stamped result to the session's shared folder and read it back without the stamp."""
    folder = new_folder(spark, "published")
    return publish_parquet(publishable_revenue(revenue_projection(spark, sf_dir)), folder).drop(UPDATED_AT)


def revised_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection with every indicator different in every year, so that no factor can stand in for another."""
    return project_revenue(fact_from_lineitem(spark, sf_dir), REVISED)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "fact_scan": fact_from_lineitem,
        "account_filter": account_filter,
        "locale_number_parse": locale_number_parse,
        "net_aggregate": net_aggregate,
        "fact_scan_text_amounts": text_amounts,
        "macro_index": indexed_collection,
        "nominal_gdp_chain": partial(gdp_beside_collection, PARAMETERS),
        "nominal_gdp_chain_revised": partial(gdp_beside_collection, GDP_KNOWN_LATER),
        "selic_ratio": selic_ratio,
        "all_slices_single_pass": all_slices_single_pass,
        "union_with_manual_rows": union_with_manual_rows,
        "relabel_year": relabelled,
        "consolidate_fund": one_treasury_fund,
        "derive_codes": fund_codes,
        "flag_rcl": rcl,
        "flag_rli": rli,
        "flag_audit_counts": audit_counts,
        "deflate_2019": constant_prices,
        "revenue_projection": revenue_projection,
        "revenue_projection_revised_parameters": revised_projection,
        "publish_parquet_readback": publish_parquet_readback,
    }
    for rule in CATALOGUE:
        found[f"slice_{rule.slice_id}"] = partial(one_slice, rule.slice_id)
    for name in STACKED_PAIRS:
        found[f"stacked_{name}"] = partial(stacked_pair, name)
    return found | more_queries.queries()
