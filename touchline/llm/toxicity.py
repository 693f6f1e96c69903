"""Toxicity by a linear classifier over character n-grams with naive Bayes features.

Texts are lower-cased and their white space made single; n-grams of their characters (code
points) are hashed into 2**BITS features. A text has a feature or not; the features it has are
scaled by their naive Bayes log-count ratio (shares of the toxic and of the other labelled
texts that have it) and by the text's length in features, and a logistic regression is fitted
on them. Presence rather than frequency: a few words decide, however long the text about them.

Counts cover all labelled texts: tasks add up their own, Spark sums them by feature. The
regression is fitted on a bounded sample, ``fit_rows`` texts of each class at most, taken by
a hash of the text, in one streamed task. Scoring is one pass without a shuffle.

Defined results: a null or empty text has the score of the bias alone; rows without a label
do not train; without any labelled row, or with one class alone, the score is the smoothed
share of toxic rows; long texts are read whole, in slices; repeated rows score alike and count
as often as they are there, whatever their labels; columns are taken by position, so their names
don't matter; an empty table gets no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workers
from .common import pick, saved

BITS = 18
#: Lengths of the n-grams, in characters.
ORDERS = (3, 4, 5)
#: Texts of each class that the regression may use, and how often it sees them.
FIT_ROWS = 2500
EPOCHS = 3
#: Scale of the features, and the pace of the regression.
SCALE = 5.0
PACE = 0.3
#: Characters of a text that are hashed at once.
SLICE = 1 << 16


def normal(text: str | None) -> np.ndarray:
    data = f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "replace")
    return np.frombuffer(data, np.uint32)


def features(text: str | None) -> np.ndarray:
    """The distinct feature numbers of a text's n-grams, in order."""
    data = normal(text)
    has = np.zeros(1 << BITS, bool)
    if data.size <= 2:
        return np.flatnonzero(has)
    for at in range(0, data.size, SLICE):
        part = data[at : at + SLICE + max(ORDERS) - 1].astype(np.uint64) + np.uint64(1)
        h = np.zeros(part.size, np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if part.size < n:
                break
            h = h[: part.size - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :]
            if n in ORDERS:
                x = h[:SLICE] ^ np.uint64(n)
                has[((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(has)


@dataclass
class Model:
    weights: np.ndarray  # by feature: naive Bayes ratio, scale and regression together
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text)
        z = self.bias + (float(self.weights[found].sum()) / found.size**0.5 if found.size else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def count_features(labelled: DataFrame) -> DataFrame:
    """feature, toxic, other: how many of the rows of (text, label) have it, by class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("toxicity")
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[label, features(text.as_py())] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": pa.array(some, pa.int32()), "toxic": pa.array(counts[1, some]), "other": pa.array(counts[0, some])})

    parts = labelled.select("text", "label").mapInArrow(count, "feature int, toxic long, other long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def ratios(counts: DataFrame, toxic: int, other: int) -> np.ndarray:
    """Naive Bayes log-count ratio of every feature (2**BITS rows at most come to the driver)."""
    both = np.ones((2, 1 << BITS))
    for row in counts.toLocalIterator():
        both[0, row["feature"]] += row["toxic"]
        both[1, row["feature"]] += row["other"]
    return np.log(both[0] / (toxic + 2)) - np.log(both[1] / (other + 2))


def fit(df: DataFrame, *, text: str = "text", label: str = "label", fit_rows: int = FIT_ROWS, epochs: int = EPOCHS) -> Model:
    """Fit on all labelled rows (0 or 1)."""
    spark = df.sparkSession
    labelled = pick(df, text=text, label=label).where("label is not null").select("text", F.when(F.col("label") != 0, 1).otherwise(0).alias("label"))
    labelled = saved(labelled, "labelled")  # read four times below
    sums = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sums.get(1, 0), sums.get(0, 0)
    if not toxic or not other:
        return Model(np.zeros(1 << BITS), float(np.log((toxic + 0.5) / (other + 0.5)) if toxic + other else -2.0))
    ratio = ratios(count_features(labelled), toxic, other)
    order = F.xxhash64(F.lit(7), "text")
    sample = None
    for value, rows in ((1, toxic), (0, other)):
        # Hashes below this share hold about four times the rows wanted, so few travel to the one task that sorts them.
        low = F.pmod(order, F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * 4 * (fit_rows + 100) / rows))
        taken = labelled.where((F.col("label") == value) & low).orderBy(order, "text").limit(fit_rows)
        # The classes count in the sample as they do among all labelled rows.
        share = rows / min(rows, fit_rows) * (min(toxic, fit_rows) + min(other, fit_rows)) / (toxic + other)
        taken = taken.withColumn("share", F.lit(float(share)))
        sample = taken if sample is None else sample.unionByName(taken)
    seen = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    seen = seen.repartition(1).sortWithinPartitions("epoch", F.xxhash64(F.col("epoch"), "text"), "text", "label")
    sent = spark.sparkContext.broadcast(ratio)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("toxicity")
        ratio = sent.value
        weights, squares = np.zeros(1 << BITS), np.ones(1 << BITS)
        bias, bias_squares = -2.0, 1.0
        for batch in batches:
            for text, label, share in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = features(text.as_py())
                if not found.size:
                    continue
                x = ratio[found] * (SCALE / found.size**0.5)
                z = float(x @ weights[found]) + bias
                slope = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) * share
                gradient = slope * x
                squares[found] += gradient * gradient
                weights[found] -= PACE * gradient / np.sqrt(squares[found])
                bias_squares += slope * slope
                bias -= PACE * slope / np.sqrt(bias_squares)
        yield pa.RecordBatch.from_pydict({"weights": [(weights * ratio * SCALE).astype("<f8").tobytes()], "bias": [bias]})

    row = seen.select("text", "label", "share").mapInArrow(descend, "weights binary, bias double").first()
    return Model(np.frombuffer(row["weights"], "<f8").copy(), row["bias"])


def score(df: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 in a last column; no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select("*", F.lit(0.0).alias(column)).schema
    at = df.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("toxicity")
        model = sent.value
        for batch in batches:
            scores = pa.array([model.score(value.as_py()) for value in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return df.mapInArrow(judge, schema)


#: Rows of labels up to which they are sent to every task (about 40 bytes each in a hash relation: 40 MB); beyond, both sides are shuffled.
BROADCAST_LABELS = 1_000_000


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Join (doc_id, text) with (doc_id, label)."""
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id")
