"""Revenue fact table derived from the ``lineitem`` table.

Every line item becomes one accounting entry: its order and line numbers pick
a revenue nature, its part an account, its supplier a unit, its ship date the
month (shifted so that 2019 and 2020 occur) and its price the amount.
``fact_sql`` states the same view for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.schema import (
    ACCOUNT, BUDGETED, BUDGETED_DEDUCTION, COLLECTED, COLLECTED_DEDUCTION, FUND, MONEY,
    MONTH, NAME, NATURE, ORIGIN, UNIT, YEAR,
)
from fiscus.sources.fact import conform_fact
from fiscus.sources.local import literal_table

# Origin, nature, name and fund of the sample revenues.
NATURES = (
    ("11", "1118021100", "ICMS - Principal", "0100000000"),
    ("11", "1118021200", "ICMS - Multa", "0100000000"),
    ("11", "1118013100", "ITCMD - Principal", "0161000000"),
    ("11", "1118012100", "IPVA - Principal", "0162000000"),
    ("11", "1113031100", "Imposto sobre a Renda - IRRF", "0100000000"),
    ("11", "1121011100", "Taxa de Inspeção", "0111000000"),
    ("11", "1121011200", "Taxa - Juro e Dívida Ativa", "0111000000"),
    ("11", "1118011100", "ITBI - Principal", "0100000000"),
    ("12", "1218011100", "Contribuição do Servidor", "0250000000"),
    ("13", "1321001100", "Remuneração de Depósitos", "0100000000"),
    ("13", "1311001100", "Aluguéis", "0100000000"),
    ("14", "1400001100", "Receita Agropecuária", "0240000000"),
    ("15", "1500001100", "Receita Industrial", "0240000000"),
    ("16", "1610011100", "Contribuição Assistência Médica", "0240000000"),
    ("16", "1630011100", "Serviços SUS", "0223000000"),
    ("16", "1690991100", "Outros Serviços", "0240000000"),
    ("17", "1718011100", "Cota-Parte do Fundo de Participação dos Estados", "0100000000"),
    ("17", "1718016100", "Cota-Parte do IPI", "0100000000"),
    ("17", "1718991100", "FEX - Auxílio Financeiro", "0100000000"),
    ("17", "1718061100", "Desoneração L.C. N. 87/96", "0100000000"),
    ("17", "1718051200", "FNDE - PNAE", "0120000000"),
    ("17", "1718051100", "Salário-Educação", "0120000000"),
    ("17", "1718018100", "CIDE", "0139000000"),
    ("17", "1758011100", "FUNDEB", "0131000000"),
    ("17", "1718031100", "SUS Fundo a Fundo", "0223000000"),
    ("17", "1718101100", "Convênio União", "0128000000"),
    ("17", "1728101100", "Convênio Municípios", "0912800000"),
    ("17", "1768011100", "Outras Transferências", "0100000000"),
    ("19", "1910011100", "Multas Administrativas", "0100000000"),
    ("19", "1990992100", "Acréscimos PRODEC", "0299000000"),
    ("19", "1922011100", "Recuperação de Despesas", "0100000000"),
    ("21", "2119001100", "Operação de Crédito Interna", "0191000000"),
    ("22", "2220001200", "Alienação - Poder Executivo", "0100000000"),
    ("22", "2220001100", "Alienação - Poder Judiciário", "0100000000"),
    ("23", "2300001100", "Amortização", "0100000000"),
    ("24", "2418101100", "Transferência de Capital", "0128000000"),
    ("72", "7218011100", "Contribuição Patronal", "0250000000"),
    ("73", "7310011100", "Patrimonial intra", "0100000000"),
    ("76", "7600001100", "Serviços intra", "0240000000"),
    ("79", "7990991100", "Outras intra", "0100000000"),
    ("79", "7922011100", "Recuperação intra", "0100000000"),
    ("89", "8990001100", "Capital intra", "0100000000"),
)

# Accounts, and the account prefix of each kind of amount.
ACCOUNTS = (
    "52111000000", "52112010100", "62121000000", "62131010000",
    "62131020201", "62132000000", "62129000000", "62121000000",
)
AMOUNT_ACCOUNTS = {
    COLLECTED: "6212",
    COLLECTED_DEDUCTION: "6213",
    BUDGETED: "52111",
    BUDGETED_DEDUCTION: "52112",
}
YEAR_SHIFT = 19


def fact_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.StringType()
    natures = literal_table(
        spark,
        [(i, *nature) for i, nature in enumerate(NATURES)],
        T.StructType(
            [T.StructField("nature_no", T.LongType())]
            + [T.StructField(name, text) for name in (ORIGIN, NATURE, NAME, FUND)]
        ),
    )
    accounts = literal_table(
        spark,
        list(enumerate(ACCOUNTS)),
        T.StructType([T.StructField("account_no", T.LongType()), T.StructField(ACCOUNT, text)]),
    )
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("52009"), (F.col("l_suppkey") % 5).cast("string")).alias(UNIT),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(NATURES)).alias("nature_no"),
        (F.col("l_partkey") % len(ACCOUNTS)).alias("account_no"),
        (F.year("l_shipdate") + YEAR_SHIFT).alias(YEAR),
        F.month("l_shipdate").alias(MONTH),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
    )
    # Both lookup tables are literals of this module, 42 and 8 rows.
    entries = items.join(F.broadcast(natures), "nature_no").join(F.broadcast(accounts), "account_no")
    amounts = {
        column: F.when(F.col(ACCOUNT).startswith(prefix), F.col("amount"))
        .otherwise(F.lit(0).cast(MONEY))
        for column, prefix in AMOUNT_ACCOUNTS.items()
    }
    return conform_fact(entries.withColumns(amounts))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fact_sql() -> str:
    """WITH-clause items ``nat``, ``acc`` and ``fat`` for DuckDB."""
    natures = ", ".join(
        f"({i}, {', '.join(sql_text(part) for part in nature)})" for i, nature in enumerate(NATURES)
    )
    accounts = ", ".join(f"({i}, {sql_text(account)})" for i, account in enumerate(ACCOUNTS))
    amounts = ", ".join(
        f"CASE WHEN cod_conta_contabil LIKE '{prefix}%' THEN cast(l_extendedprice AS decimal(18,2)) "
        f"ELSE cast(0 AS decimal(18,2)) END AS {column}"
        for column, prefix in AMOUNT_ACCOUNTS.items()
    )
    return f"""
nat AS (SELECT * FROM (VALUES {natures})
        AS t(k, cod_origem, cod_detalhamento, nom_detalhamento, cod_fonte_recurso)),
acc AS (SELECT * FROM (VALUES {accounts}) AS t(a, cod_conta_contabil)),
fat AS MATERIALIZED (
  SELECT concat('52009', cast(l_suppkey % 5 AS varchar)) AS cod_unidade_gestora, cod_conta_contabil,
         cod_origem, cod_fonte_recurso, cod_detalhamento, nom_detalhamento,
         cast(year(l_shipdate) + {YEAR_SHIFT} AS int) AS num_ano, cast(month(l_shipdate) AS int) AS num_mes,
         {amounts}
  FROM lineitem
  JOIN nat ON nat.k = (l_orderkey * 7 + l_linenumber) % {len(NATURES)}
  JOIN acc ON acc.a = l_partkey % {len(ACCOUNTS)})"""
