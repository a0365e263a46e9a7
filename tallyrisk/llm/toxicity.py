"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, runs of white space become one space, and each distinct n-gram of 4, 5 or 6
characters sets one of 2^18 hashed features. The log-count ratio of a feature is the log of its smoothed share
of the documents of class 1 over that of class 0; logistic regression is trained on the scaled features, and a
document's score is sigmoid(bias + sum of weight * ratio over its features). Features of fewer than
MIN_DOCS labelled documents, or with a ratio within SIGNIFICANCE standard errors of zero, are left out. The whole
text counts, whatever its length.

The fit may use a bounded sample of the labels (``max_rows``, those with the smallest hash of their id); scoring
reads every row and needs no shuffle.

Defined cases: a null or empty text has no features and gets the score of the bias; rows with a null or
unknown label are not learnt from; a document labelled twice is learnt from once per label, of a repeated
id the smallest text is learnt from; with labels of one class only, none, or no feature that tells the classes apart,
each score is the (smoothed) share of the class. Label, language, source and id are never features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyrisk.llm.common import PerWorker, field_type, map_arrow, write_out

BITS = 18
LENGTHS = (4, 5, 6)
# Labelled rows that are learnt from, at most.
MAX_ROWS = 40_000
MIN_DOCS = 8
# A log-count ratio fewer standard errors from zero may be chance; such features are most of a text and are left out.
SIGNIFICANCE = 4.0
REGULARISATION = 0.001
ITERATIONS = 100
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def features_of(text: str) -> np.ndarray:
    """The hashed features of a text, with repeats."""
    codes = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    found = []
    rolled = codes
    for n in range(2, LENGTHS[-1] + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * _STEP + codes[n - 1 :]
        if n in LENGTHS:
            found.append((rolled + np.uint64(n)) * _MULTIPLIER >> np.uint64(64 - BITS))
    if not found:
        return np.zeros(0, dtype=np.int32)
    return np.concatenate(found).astype(np.int32)


class Distinct:
    """Distinct values of an index array without sorting: the last writer of each slot stays."""

    def __init__(self):
        self.slot = np.zeros(1 << BITS, dtype=np.int32)

    def __call__(self, index: np.ndarray) -> np.ndarray:
        order = np.arange(len(index), dtype=np.int32)
        self.slot[index] = order
        return index[self.slot[index] == order]


@dataclass
class ToxicityModel:
    bias: float
    weights: np.ndarray  # float32, one per hashed feature: weight times log-count ratio

    def score(self, index: np.ndarray) -> float:
        total = self.bias + float(self.weights[index].astype(np.float64).sum())
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, total))))


def count_features(rows: DataFrame) -> DataFrame:
    """feature, toxic and all: how many rows of (text, label) have each hashed feature, and how many of them are of
    class 1. Each task counts into two arrays of 2^BITS first, so what is shuffled has at most that many rows a task."""

    def run(batches):
        distinct, counts = Distinct(), np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(label), distinct(features_of(text or ""))] += 1
        met = np.flatnonzero(counts.sum(axis=0))
        columns = [met.astype(np.int32), counts[1, met], counts.sum(axis=0)[met]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "toxic", "all"])

    parts = rows.select("text", "label").mapInArrow(run, "feature int, toxic long, all long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))


def chosen_features(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell the classes apart and their log-count ratios, in the order of the features."""
    # At most one row for each hashed feature.
    seen = count_features(rows).where(F.col("all") >= MIN_DOCS).toPandas().sort_values("feature")
    toxic, clean = seen["toxic"].to_numpy() + 1.0, (seen["all"] - seen["toxic"]).to_numpy() + 1.0
    ratio = np.log(toxic / (n_toxic + 2)) - np.log(clean / (n_clean + 2))
    error = np.sqrt(1 / toxic - 1 / (n_toxic + 2) + 1 / clean - 1 / (n_clean + 2))
    told = np.abs(ratio) > SIGNIFICANCE * error
    return seen["feature"].to_numpy()[told], ratio[told]


def scaled_vectors(rows: DataFrame, features: np.ndarray, ratio: np.ndarray) -> DataFrame:
    """label and scaled, the log-count ratios of a row's chosen features. The place of each feature (1 MB, fixed by
    BITS) is broadcast."""
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    shared = PerWorker(rows.sparkSession, place, lambda place: (place, Distinct()))

    def run(batch):
        place, distinct = shared.get()
        places = [place[distinct(features_of(x or ""))] for x in batch.column(1).to_pylist()]
        return {"label": batch.column(0), "places": [np.sort(p[p >= 0]) for p in places]}

    found = map_arrow(rows.select("label", "text"), run, T.StructType.fromDDL("label double, places array<int>"))
    vector = F.udf(lambda places: Vectors.sparse(len(ratio), places, ratio[places]), VectorUDT())
    return write_out(found, "toxicity-vectors").select("label", vector("places").alias("scaled"))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> ToxicityModel:
    """Train on rows of (doc_id, text, label 0 or 1)."""
    usable = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id), F.col(label).cast("double").alias("label"))
    rows = write_out(usable.agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text")).select("text", "label"), "toxicity-fit")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = counts.get(1.0, 0), counts.get(0.0, 0)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    features, ratio = chosen_features(rows, n_toxic, n_clean) if n_toxic and n_clean else (weights[:0], weights[:0])
    if not len(features):
        share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return ToxicityModel(math.log(share / (1 - share)), weights)
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, (n_toxic + n_clean) // 500))
    model = LogisticRegression(
        featuresCol="scaled", regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False
    ).fit(scaled_vectors(rows, features, ratio).coalesce(tasks))
    weights[features] = model.coefficients.toArray() * ratio
    return ToxicityModel(float(model.intercept), weights)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each whole text; the model (1 MB, fixed by BITS) is broadcast."""
    shared = PerWorker(docs.sparkSession, model, lambda model: (model, Distinct()))
    chosen = docs.select(F.col(doc_id), F.col(text))

    def run(batch):
        own, distinct = shared.get()
        return {"doc_id": batch.column(0), "score": [own.score(distinct(features_of(x or ""))) for x in batch.column(1).to_pylist()]}

    schema = T.StructType([T.StructField("doc_id", field_type(docs, doc_id)), T.StructField("score", T.DoubleType())])
    return map_arrow(chosen, run, schema)


def keep_below(docs: DataFrame, model: ToxicityModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows whose text scores under the threshold, with all their columns."""
    shared = PerWorker(docs.sparkSession, model, lambda model: (model, Distinct()))
    at = docs.columns.index(text)

    def run(batches):
        own, distinct = shared.get()
        for batch in batches:
            mild = [own.score(distinct(features_of(x or ""))) < threshold for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mild, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label) outside the held-out fold, of the ``max_rows`` labels with the smallest hash of their id. The
    bound makes the labels small enough for a broadcast, so texts stay where they are."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = usable.select("doc_id", F.col("toxic").alias("label")).distinct().orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(marked.limit(max_rows)), "doc_id")


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    return fit(training_rows(docs, labels, max_rows))
