"""Quality classification by a sparse ensemble of rules over text statistics.

Statistics of each text are Spark columns. Shallow trees are grown on a
bounded sample of labelled rows; every path from a root becomes a conjunctive
rule. A logistic model with lasso penalty weighs the rules, most of them with zero, and what
is left is compiled into one column expression. Scoring is a projection of the
scan: no shuffle and no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.shared import stored

STATISTICS = (
    "log_words", "unique_words", "word_length", "upper_share", "symbol_share", "stop_share", "digit_share",
    "unique_lines", "line_words",
)

# (statistic, is above, threshold)
Condition = tuple[str, bool, float]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The statistics of the whole text as struct ``stats``; a null text counts as empty, an empty one has zeros."""

    def part(count: Column, total: Column) -> Column:
        return F.when(total > 0, count / total).otherwise(0.0)

    text = F.coalesce(F.col(text_col), F.lit(""))
    # Lower-case letters and spaces are most of a text; what is left is short.
    counted = docs.withColumn(
        "stats",
        F.struct(
            F.length(text).alias("chars"),
            F.regexp_replace(text, r"[\p{Ll} ]+", "").alias("rest"),
            F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("words"),
            F.filter(F.split(text, "\n"), lambda w: w != "").alias("lines"),
        ),
    )
    stats, rest = F.col("stats"), F.col("stats")["rest"]
    counted = counted.withColumn(
        "stats",
        F.struct(
            stats["chars"].alias("chars"),
            F.length(F.regexp_replace(rest, r"[^\p{Lu}]+", "")).alias("upper"),
            F.length(F.regexp_replace(rest, r"[^#$%&*|!@^~<>{}=+_/\\]+", "")).alias("symbols"),
            F.length(F.regexp_replace(rest, r"[^.,;:?]+", "")).alias("stops"),
            F.length(F.regexp_replace(rest, r"[^0-9]+", "")).alias("digits"),
            F.size(stats["words"]).alias("words"),
            F.size(F.array_distinct(stats["words"])).alias("distinct_words"),
            F.size(stats["lines"]).alias("lines"),
            F.size(F.array_distinct(stats["lines"])).alias("distinct_lines"),
        ),
    )
    return counted.withColumn(
        "stats",
        F.struct(
            F.log1p(stats["words"]).alias("log_words"),
            part(stats["distinct_words"], stats["words"]).alias("unique_words"),
            part(stats["chars"], stats["words"]).alias("word_length"),
            part(stats["upper"], stats["chars"]).alias("upper_share"),
            part(stats["symbols"], stats["chars"]).alias("symbol_share"),
            part(stats["stops"], stats["words"]).alias("stop_share"),
            part(stats["digits"], stats["chars"]).alias("digit_share"),
            part(stats["distinct_lines"], stats["lines"]).alias("unique_lines"),
            part(stats["words"], stats["lines"]).alias("line_words"),
        ),
    )


@dataclass(frozen=True)
class Rules:
    """Conjunctions with their weights; ``score`` is the column that they make."""

    intercept: float
    weighted: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.weighted:
            total = total + F.when(_holds(conditions), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(conditions: tuple[Condition, ...]) -> Column:
    holds = F.lit(True)
    for name, above, threshold in conditions:
        value = F.col("stats")[name]
        holds = holds & (value > threshold if above else value <= threshold)
    return holds


def tree_paths(node) -> list[tuple[Condition, ...]]:
    """Every path that starts at the root of a tree, as sorted conditions."""
    paths: list[tuple[Condition, ...]] = []
    open_nodes = [(node, ())]
    while open_nodes:
        at, conditions = open_nodes.pop()
        if conditions:
            paths.append(tuple(sorted(conditions)))
        if at.getClass().getSimpleName() == "InternalNode":
            name, threshold = STATISTICS[at.split().featureIndex()], float(at.split().threshold())
            open_nodes.append((at.leftChild(), (*conditions, (name, False, threshold))))
            open_nodes.append((at.rightChild(), (*conditions, (name, True, threshold))))
    return paths


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 20_000,
    trees: int = 16,
    depth: int = 4,
    penalty: float = 0.0003,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Rules:
    """Rules from ``labels`` (id and 0 or 1), of which about ``most_rows`` are used, chosen by a hash of the id.

    Labels that are null or otherwise valued are left out, as are ids without
    a document. Without both classes the score is constant: the smoothed share of ones.
    """
    usable = labels.select(id_col, F.col(label_col).cast("double").alias("label")).filter(
        F.col("label").isin(0.0, 1.0) & F.col(id_col).isNotNull()
    )
    total = usable.count()
    if total > most_rows:
        chance = F.pmod(F.xxhash64(id_col), F.lit(2**31)) / 2**31
        usable = usable.filter(chance < most_rows / total)
    # The sample is bounded by ``most_rows`` rows of two numbers.
    labelled = docs.select(id_col, text_col).join(F.broadcast(usable), id_col)
    values = F.array(*[F.col("stats")[name] for name in STATISTICS])
    sample = stored(
        with_statistics(labelled, text_col)
        .select("stats", "label", array_to_vector(values).alias("x"))
        .orderBy("label", *[F.col("stats")[name] for name in STATISTICS])
        .limit(2 * most_rows),
        "quality-sample",
    )
    counts = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
    if not ones or not zeros:
        share = (ones + 1) / (ones + zeros + 2)
        return Rules(_logit(share), ())
    grown = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="all",
        subsamplingRate=0.5,
    ).fit(sample.select("x", "label"))
    paths = sorted({path for tree in grown.trees for path in tree_paths(tree._call_java("rootNode"))})
    fired = F.array(*[_holds(path).cast("double") for path in paths])
    weighed = LogisticRegression(
        featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60
    ).fit(sample.select(array_to_vector(fired).alias("rules"), "label"))
    kept = [(path, float(w)) for path, w in zip(paths, weighed.coefficients.toArray()) if w]
    return Rules(float(weighed.intercept), tuple(kept))


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def score_quality(
    docs: DataFrame, rules: Rules, threshold: float = 0.7, text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored like any other. Columns of these names,
    and ``stats``, are replaced. Repeated rows stay; an empty table gives an empty result.
    """
    scored = with_statistics(docs.drop("score", "predicted", "stats"), text_col).withColumn("score", rules.score())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("stats")
