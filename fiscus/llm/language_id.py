"""Language identification in two levels of linear classifiers.

Languages are grouped into families by the likeness of their letter profiles
(or by a given table). A text's family is predicted first; within the family
every pair of languages has a linear support vector machine of its own, and the pairs vote.

Features are the frequencies of hashed letter n-grams of the whole text. The
models are fitted on the driver from a sample that is bounded by ``per_language``
rows per language; scoring runs in the tasks that read the texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BINS = 2048
GRAMS = (1, 2, 3)
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Root frequencies of hashed n-grams of lower-case letters, scaled to length one.

    Everything that is not a letter counts as one break between words.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = (codes > 127) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, 32)
    codes = codes[np.concatenate([[True], letter[1:] | letter[:-1]])]
    counts = np.zeros(BINS)
    window = np.zeros(len(codes), np.uint64)
    for n in GRAMS:
        if len(codes) < n:
            break
        window = (window[: len(codes) - n + 1] << np.uint64(21)) ^ codes[n - 1 :]
        mixed = (window + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(53)).astype(np.int64), minlength=BINS)
    roots = np.sqrt(counts)
    return roots / max(float(np.linalg.norm(roots)), 1e-12)


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) and any(map(str.isalpha, text))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 100) -> np.ndarray:
    """Weights (last one the bias) of a linear machine with squared hinge loss, by accelerated descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (1 / c + 2 * 2.0)  # rows have length at most the root of two
    weights = look = np.zeros(x.shape[1], np.float32)
    for n in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - step * (look / c - 2 * x.T @ (share * y * slack))
        look, weights = new + (n - 1) / (n + 2) * (new - weights), new
    return weights


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * z, -60, 60)))


def language_families(profiles: Mapping[str, np.ndarray]) -> dict[str, int]:
    """Join the closest groups of languages until about the root of their number is left."""
    groups = [[name] for name in sorted(profiles)]

    def likeness(a: list[str], b: list[str]) -> float:
        return min(float(profiles[i] @ profiles[j]) for i in a for j in b)

    while len(groups) > math.ceil(math.sqrt(len(profiles))):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: likeness(groups[p[0]], groups[p[1]]))
        groups[a] += groups.pop(b)
    return {name: number for number, group in enumerate(groups) for name in group}


@dataclass(frozen=True)
class LanguageModel:
    families: dict[str, int]
    family_weights: np.ndarray  # a column of weights per family, one against the rest
    pair_weights: dict[tuple[str, str], np.ndarray]  # positive for the first language

    @staticmethod
    def fit(x: np.ndarray, languages: list[str], families: Mapping[str, int] | None = None) -> LanguageModel:
        known = np.array(languages)
        names = sorted(set(languages))
        if families is None:
            means = {name: x[known == name].mean(axis=0) for name in names}
            families = language_families({n: m / max(np.linalg.norm(m), 1e-12) for n, m in means.items()})
        own = np.array([families[name] for name in languages])
        numbers = sorted(set(own.tolist()))
        columns = [linear_svm(x, np.where(own == f, 1.0, -1.0)) for f in numbers] if len(numbers) > 1 else []
        pairs = {}
        for a, b in combinations(names, 2):
            if families[a] == families[b]:
                rows = (known == a) | (known == b)
                pairs[a, b] = linear_svm(x[rows], np.where(known[rows] == a, 1.0, -1.0))
        renumbered = {name: numbers.index(families[name]) for name in names}
        return LanguageModel(renumbered, np.array(columns).T if columns else np.zeros((x.shape[1] + 1, 1)), pairs)

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        """The language and how sure it is: the shares of the family and of the pairs, multiplied."""
        vector = np.append(vector, 1.0)
        sure = _sigmoid(vector @ self.family_weights)
        family = int(np.argmax(sure))
        certainty = float(sure[family] / sure.sum())
        members = [name for name, number in self.families.items() if number == family]
        if len(members) == 1:
            return members[0], certainty
        votes = dict.fromkeys(members, 0.0)
        shares = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            first = float(_sigmoid(vector @ self.pair_weights[a, b]))
            votes[a if first >= 0.5 else b] += 1
            shares[a] += first
            shares[b] += 1 - first
        best = max(sorted(members), key=lambda name: (votes[name], shares[name]))
        return best, certainty * shares[best] / (len(members) - 1)


def training_sample(
    docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str
) -> tuple[np.ndarray, list[str]]:
    """Features of at most about ``per_language`` rows of each language, chosen by a hash of id and text.

    One count per language, then a filter by hash share; the limit holds the
    sample to ``per_language`` times the number of languages.
    """
    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {row[lang_col]: row["count"] for row in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return np.zeros((0, BINS), np.float32), []
    spark = docs.sparkSession
    shares = spark.createDataFrame(
        [(lang, min(1.0, per_language / n)) for lang, n in counts.items()], "wanted string, share double"
    )
    chance = F.pmod(F.xxhash64(id_col, text_col), F.lit(2**31)) / 2**31
    chosen = (
        labelled.join(F.broadcast(shares), F.col(lang_col) == F.col("wanted"))
        .filter(chance < F.col("share"))
        .select(text_col, lang_col)
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(t, g) for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for _, g in pairs], pa.string()),
                 pa.array([features(t).astype(np.float32).tobytes() for t, _ in pairs], pa.binary())],
                names=["lang", "x"],
            )

    rows = (
        chosen.mapInArrow(vectors, "lang string, x binary")
        .orderBy("lang", "x")
        .limit(per_language * len(counts))
        .collect()
    )
    x = np.array([np.frombuffer(row.x, np.float32) for row in rows], np.float32).reshape(-1, BINS)
    return x, [row.lang for row in rows]


def identify(
    docs: DataFrame,
    training: DataFrame,
    per_language: int = 300,
    families: Mapping[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row of ``docs``; learns from ``training`` only.

    ``families`` may give the family of each language; otherwise they are
    found from the letter profiles. Texts that are null or have no letter are
    ``und`` with score 0, as is everything if no training row has a letter.
    With one language all others with letters get it, with score 1. Repeated
    rows and null ids stay; an empty table gives an empty result; further columns are ignored.
    """
    x, languages = training_sample(training, per_language, id_col, text_col, lang_col)
    model = LanguageModel.fit(x.astype(np.float64), languages, families) if languages else None

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                model.predict(features(text)) if model and text and has_letter(text) else (UNKNOWN, 0.0)
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(predicted, f"{id_col} {dict(kept.dtypes)[id_col]}, lang_pred string, score double")
