"""Document quality by regularised quadratic discriminant analysis.

Each document becomes a few transformed statistics of its whole text. Two Gaussians are fitted, one per label, each with
its own covariance shrunk towards its diagonal; a document's score is the posterior of label 1, from the difference of
Mahalanobis log-densities. The Cholesky factors are computed once, when the model is made.

The fit takes sums, counts and products only, by one aggregation over all labelled rows; nothing of a document but its
twelve statistics leaves its task.

Edge cases: a null text counts as empty, and an empty one is scored from the statistics of an empty text; labels that
are null or neither 0 nor 1 are not learned from; with fewer than two labelled rows of a label every score is the share
of label 1 (0.5 without labels); repeated rows are scored each; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.llm.common import slices, stored

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "shouts", "stops", "repeated_next", "distinct", "repeated_lines", "compressed", "line_length")
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
SHOUTS = np.frombuffer(b"!?", np.uint8)
STOPS = np.frombuffer(b".,;:", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES.

    Added counts draw the shares of very short texts to those of ordinary prose: a few words are weak evidence.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = int(bins[65:91].sum()), int(bins[97:123].sum())
    share = lambda x: math.log(x + 1e-3)
    packed = len(zlib.compress(raw, 1)) if raw else 0
    return [
        math.log1p(len(words)),
        math.log((len(text) - len(words) + 60) / (len(words) + 12)),
        share((upper + 1) / (upper + lower + 40)),
        share(bins[48:58].sum() / (chars + 1000)),
        share(bins[SYMBOLS].sum() / (chars + 40)),
        share(bins[SHOUTS].sum() / (chars + 40)),
        share((bins[STOPS].sum() + 1) / (chars + 40)),
        share(sum(map(eq, words, words[1:])) / (n + 10)),
        math.log((len(set(words)) + 20) / (len(words) + 20)),
        share(1 - (len(set(lines)) + 4) / (len(lines) + 4)),
        math.log((packed + 40) / (len(raw) + 100)),
        math.log((chars + 200) / (len(lines) + 1)),
    ]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and an array of FEATURES for every row."""
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass
class Gaussian:
    mean: np.ndarray
    #: Inverse of the lower Cholesky factor of the covariance.
    whiten: np.ndarray
    log_det: float
    log_prior: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.log_prior - 0.5 * (self.log_det + (z * z).sum(axis=1))


@dataclass
class Model:
    """Two classes, or a constant where there was too little to learn from."""

    low: Gaussian | None
    high: Gaussian | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.constant)
        d = np.clip(self.high.log_density(x) - self.low.log_density(x), -700, 700)
        return 1 / (1 + np.exp(-d))


def gaussian(n: int, sums: np.ndarray, products: np.ndarray, total: int, shrinkage: float, floor: np.ndarray) -> Gaussian:
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), floor)
    cov = (1 - shrinkage) * cov + shrinkage * np.diag(var)
    np.fill_diagonal(cov, var)
    root = np.linalg.cholesky(cov)
    return Gaussian(mean, np.linalg.inv(root), 2 * float(np.log(np.diag(root)).sum()), math.log(n / total))


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Model:
    """Fit on the columns ``x`` (of :func:`features`) and ``y`` (0 or 1).

    The variance of a statistic is at least a hundredth of its variance over both classes, so that one that never varies
    within a class can't decide alone.
    """
    d = len(FEATURES)
    x = lambda i: F.col("x")[i]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = (
        labelled.where(F.col("y").isin(0, 1))
        .groupBy("y")
        .agg(F.count("*").alias("n"), F.array(*[F.sum(x(i)) for i in range(d)]).alias("s"), F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("p"))
        .collect()
    )
    found = {r["y"]: r for r in rows}
    total = sum(r["n"] for r in rows)
    if len(found) < 2 or min(r["n"] for r in rows) < 2:
        return Model(None, None, found[1]["n"] / total if 1 in found else 0.0 if total else 0.5)
    sums = {y: np.array(r["s"]) for y, r in found.items()}
    products = {}
    for y, r in found.items():
        m = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            m[i, j] = m[j, i] = v
        products[y] = m
    mean = sum(sums.values()) / total
    floor = np.maximum(0.01 * (np.diag(sum(products.values())) / total - mean**2), 1e-6)
    made = {y: gaussian(found[y]["n"], sums[y], products[y], total, shrinkage, floor) for y in found}
    return Model(made[0], made[1])


def apply_model(scored: DataFrame, model: Model) -> DataFrame:
    """``id`` and score for rows of :func:`features`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["id", "score"])

    return scored.mapInArrow(run, f"id {scored.schema['id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    shrinkage: float = 0.1,
) -> DataFrame:
    """``id_col``, held_out, score and predicted for every row of ``docs``; learns from rows that aren't held out.

    A document with several labels counts once for each.
    """
    x = stored(features(docs, id_col, text_col))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id"))
    model = fit(x.join(known, "id"), shrinkage)
    return apply_model(x, model).select(
        F.col("id").alias(id_col),
        F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
