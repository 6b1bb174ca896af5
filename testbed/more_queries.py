"""Registered queries of snapshots, fingerprints, monthly partials, coverage, layout, prefixes, scenarios and number formats."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscus.functions.formats import amounts_in_own_format, format_profile
from fiscus.operators.aggregate import net_sum
from fiscus.operators.coverage import reconciliation, slice_coverage
from fiscus.operators.dimension import aggregate_slices_by_text
from fiscus.operators.filters import revenue_accounts
from fiscus.operators.flags import RCL_PREFIXES, RLI_PREFIXES
from fiscus.operators.incremental import ENTRIES, MonthlyPartials
from fiscus.operators.prefixes import first_prefixes
from fiscus.operators.projection import project_slices
from fiscus.plans.catalogue import CATALOGUE
from fiscus.plans.projection_plan import DEFAULT_HORIZON, project_revenue, stacked_with_manual_rows
from fiscus.plans.scenarios import project_scenarios
from fiscus.schema import (
    BUDGETED, BUDGETED_DEDUCTION, COLLECTED, COLLECTED_DEDUCTION, KEYS, LABEL, MEASURES, MONTH, NATURE, NET_BUDGET,
    NET_COLLECTED, RCL, RLI, YEAR,
)
from fiscus.shared import new_folder, stored
from fiscus.sinks.fingerprint import fingerprints_by
from fiscus.sinks.layout import buckets_for, write_fact_table
from fiscus.sinks.snapshots import publish_snapshot, read_snapshot
from fiscus.sources.parameters import Parameters
from testbed.lineitem_fact import fact_from_lineitem
from testbed.parameter_sets import REVISED

PARAMETERS = Parameters.default()
PREFIX_LISTS = {"rcl": RCL_PREFIXES, "rli": RLI_PREFIXES}
LAYOUT_BUCKETS = 8

Query = Callable[[SparkSession, str], DataFrame]


def publish_snapshot_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection published over one with other parameters; what readers then see."""
    fact, root = fact_from_lineitem(spark, sf_dir), new_folder(spark, "snapshots")
    publish_snapshot(project_revenue(fact, REVISED), root)
    publish_snapshot(project_revenue(fact, PARAMETERS), root)
    return read_snapshot(spark, root)


def publish_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: rows, whether the stored content is that of the result, and whether three kinds of damage are noticed.

    Damage of each label: the first row is lost and the last one doubled, if there are several; the memo of the first row is
    changed; the first row is lost.
    """
    result = stored(project_revenue(fact_from_lineitem(spark, sf_dir)), "projection")
    published = publish_snapshot(result, new_folder(spark, "snapshots"))
    order = Window.partitionBy(LABEL).orderBy(*[name for name in result.columns if name != LABEL])
    placed = published.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(LABEL)))
    doubled = F.when(F.col("n") == 1, 1).when(F.col("place") == F.col("n"), 2).when(F.col("place") == 1, 0).otherwise(1)
    swapped = placed.withColumn("copy", F.explode(F.expr("sequence(1, 2)"))).filter(F.col("copy") <= doubled)
    changed = placed.withColumn("memoria_calculo", F.when(F.col("place") == 1, "?").otherwise(F.col("memoria_calculo")))
    lost = placed.filter("place > 1")

    def prints(frame: DataFrame, name: str) -> DataFrame:
        return fingerprints_by(frame.select(*result.columns), LABEL).select(LABEL, F.struct("rows", "total", "parity").alias(name))

    found = prints(result, "written")
    for name, frame in {"read": published, "swapped": swapped, "changed": changed, "lost": lost}.items():
        found = found.join(prints(frame, name), LABEL, "left")
    return found.select(
        LABEL,
        F.col("written.rows").alias("linhas"),
        F.col("read").eqNullSafe(F.col("written")).alias("igual"),
        *[(~F.col(name).eqNullSafe(F.col("written"))).alias(name) for name in ("swapped", "changed", "lost")],
    )


def loaded_by_month(spark: SparkSession, sf_dir: str) -> MonthlyPartials:
    """Partials after three loads: years before 2020 with wrong amounts for two months, the later years, the right months."""
    fact = fact_from_lineitem(spark, sf_dir)
    partials = MonthlyPartials(spark, new_folder(spark, "monthly-partials"))
    restated = (F.col(YEAR) == 2019) & F.col(MONTH).isin(5, 6)
    wrong = {name: F.when(restated, F.col(name) * 3 + 1).otherwise(F.col(name)).cast("decimal(20,2)") for name in MEASURES}
    partials.load(fact.withColumns(wrong).filter(F.col(YEAR) < 2020))
    partials.load(fact.filter(F.col(YEAR) >= 2020))
    partials.load(fact.filter(restated), months=[(2019, 5), (2019, 6)])
    return partials


def incremental_net_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_by_month(spark, sf_dir).net_aggregate().withColumnRenamed(ENTRIES, "lancamentos")


def incremental_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = loaded_by_month(spark, sf_dir).slices(CATALOGUE, DEFAULT_HORIZON)
    return project_slices(slices, CATALOGUE, PARAMETERS, DEFAULT_HORIZON)


def slices_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices, with the rules as data instead of conditions."""
    slices = aggregate_slices_by_text(fact_from_lineitem(spark, sf_dir), CATALOGUE, DEFAULT_HORIZON)
    return project_slices(slices, CATALOGUE, PARAMETERS, DEFAULT_HORIZON)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slice_coverage(fact_from_lineitem(spark, sf_dir), CATALOGUE, DEFAULT_HORIZON)
    return found.withColumns({name: F.col(name).cast("double") for name in (NET_COLLECTED, NET_BUDGET)})


def coverage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation(slice_coverage(fact_from_lineitem(spark, sf_dir), CATALOGUE, DEFAULT_HORIZON))


def net_aggregate_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net aggregate from a table bucketed by the keys; no exchange."""
    table = f"fact_{uuid.uuid4().hex}"
    # Every line item is at most one entry; the count reads the footers of the files only.
    buckets = buckets_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), LAYOUT_BUCKETS)
    fact = write_fact_table(fact_from_lineitem(spark, sf_dir), table, buckets, new_folder(spark, "fact-table"))
    return (
        revenue_accounts(fact)
        .groupBy(*KEYS)
        .agg(
            net_sum(COLLECTED, COLLECTED_DEDUCTION).alias(NET_COLLECTED),
            net_sum(BUDGETED, BUDGETED_DEDUCTION).alias(NET_BUDGET),
            F.count("*").alias("lancamentos"),
        )
    )


def flag_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stacked_with_manual_rows(fact_from_lineitem(spark, sf_dir)).select(LABEL, NATURE)
    return first_prefixes(rows, NATURE, PREFIX_LISTS)


def projection_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = {"publicado": PARAMETERS, "revisado": REVISED}
    return project_scenarios(fact_from_lineitem(spark, sf_dir), scenarios)


def formatted_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with amounts as text: two columns with decimal comma and thousands point, two the other way round."""
    fact = fact_from_lineitem(spark, sf_dir)
    american = {name: F.format_number(F.col(name), 2) for name in MEASURES}
    european = {name: F.translate(american[name], ",.", ".,") for name in (COLLECTED, COLLECTED_DEDUCTION)}
    return fact.withColumns(american | european)


def amount_format_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of every amount column, beside the sum of its values as they are then read."""
    texts = formatted_fact(spark, sf_dir)
    sums = amounts_in_own_format(texts, MEASURES).agg(*[F.sum(name).cast("decimal(30,2)").alias(name) for name in MEASURES])
    total = sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("soma")) for n in MEASURES])))
    return format_profile(texts, MEASURES).join(total, "column")


def queries() -> dict[str, Query]:
    return {
        "publish_snapshot_readback": publish_snapshot_readback,
        "publish_fingerprint": publish_fingerprint,
        "incremental_net_aggregate": incremental_net_aggregate,
        "incremental_slices": incremental_slices,
        "slices_by_text": slices_by_text,
        "slice_coverage": coverage,
        "slice_reconciliation": coverage_reconciliation,
        "net_aggregate_bucketed": net_aggregate_bucketed,
        "flag_prefix_match": flag_prefix_match,
        "projection_scenarios": projection_scenarios,
        "amount_format_profile": amount_format_profile,
    }
