"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import draw_of, drawn, encoded, long_id, ship_package, slices, table
from gaugeworks.session import settle

FEATURE_BITS = 18
#: Bound of the labelled rows the model is fitted on; a larger set of labels is cut by hash.
MAX_TRAINING_ROWS = 12_000
#: Bound of their features' bytes, which are what the learner holds.
MAX_TRAINING_BYTES = 256 << 20
EPOCHS = 3
THRESHOLD = 0.3
FOLDS = 5

# Runs of letters, digits and non-ASCII characters, or of anything else but white space.
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x09-\x0d\x20]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x5851F42D4C957F2D)  # stands for any word that follows itself


@dataclass(frozen=True)
class Ftrl:
    """Settings of the follow-the-regularised-leader updates."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.05


def features(text: str | None, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed 1- and 2-grams of a text, and their values, of Euclidean length one.

    A 2-gram of a word with itself is one feature for all words. Values are the logarithm of
    one more than the count. The first feature is always there and stands for the intercept.
    """
    found = _TOKEN.findall(encoded(text))
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    single = np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
    double = single[:-1] * np.uint64(31) + single[1:] + np.uint64(0x7F4A7C15)
    double[single[:-1] == single[1:]] = _REPEAT
    mixed = np.concatenate([single, double]) * _MULTIPLIER >> np.uint64(64 - bits)
    slots, counts = np.unique(mixed, return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values**2).sum())
    return np.r_[0, slots.astype(np.int64)], np.r_[1.0, values]


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS,
    bits: int = FEATURE_BITS, settings: Ftrl = Ftrl(),
) -> np.ndarray:
    """Weights after `epochs` passes of per-coordinate FTRL-proximal updates, in given order."""
    z = np.zeros((1 << bits) + 1)
    n = np.zeros_like(z)

    def weights(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        size = np.maximum(np.abs(zs) - settings.l1, 0.0)
        return -np.sign(zs) * size / ((settings.beta + np.sqrt(n[slots])) / settings.alpha + settings.l2)

    for _ in range(epochs):
        for (slots, values), label in zip(rows, labels, strict=True):
            w = weights(slots)
            g = (_sigmoid(float((w * values).sum())) - label) * values
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / settings.alpha
            z[slots] += g - step * w
            n[slots] += g * g
    return weights(np.arange(len(z)))


def _shifted(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features with the intercept in slot zero and the hashed ones behind it."""
    slots, values = features(text, bits)
    slots[1:] += 1
    return slots, values


def score_text(weights: np.ndarray, text: str | None, bits: int = FEATURE_BITS) -> float:
    slots, values = _shifted(text, bits)
    return float(_sigmoid(float((weights[slots] * values).sum())))


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    """True on the fold kept from training: crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, epochs: int = EPOCHS,
    bits: int = FEATURE_BITS, max_bytes: int = MAX_TRAINING_BYTES,
) -> np.ndarray:
    """Weights fitted on labelled documents out of the held-out fold.

    `labels` has doc_id and quality; ids with several labels count with the smallest, null
    labels and ids not at all. Of more than about `max_rows` labelled ids, those with the
    smallest hash are used. The rows, bounded that way, meet the documents by a broadcast of
    their ids; each document becomes its sparse features where it lies, and of more than
    about `max_bytes` of features a part is used, again by hash. One task takes them in the
    order of the hash, and one weight vector of 2**bits reaches the driver. Without any label, or any document to it, all weights are
    zero and every score is one half.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = long_id(labels, "doc_id")
    known = labels.select(own.alias("id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("id"))
    )
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    known = settle(known.withColumn("draw", draw_of("id")))
    count = known.count()
    known = known.where(drawn(max_rows / max(1, count), "id"))
    chosen = docs.select(long_id(docs, "doc_id").alias("id"), "text").join(F.broadcast(known), "id")
    # A repeated id counts once, with its smallest text, however many rows carry it.
    chosen = chosen.groupBy("id", "quality", "draw").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_shifted(t.as_py(), bits) for t in batch.column(3)]
            packed = [
                pa.array([array.astype(kind).tobytes() for array in arrays], pa.binary())
                for arrays, kind in zip(zip(*rows, strict=True), (np.int32, np.float32), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed], ["id", "quality", "draw", "slots", "values"])

    found = settle(chosen.mapInArrow(featured, "id long, quality int, draw long, slots binary, values binary"))
    size = found.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    found = found.where(drawn(max_bytes / max(1, 2 * size), "id", "draw"))

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("draw", "ascending"), ("id", "ascending")])
        rows = [
            (np.frombuffer(s.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32))
            for s, v in zip(group.column("slots"), group.column("values"), strict=True)
        ]
        weights = fit_ftrl(rows, group.column("quality").to_pylist(), epochs, bits)
        return pa.table([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["weights"])

    # Updates depend on one another: one task, over rows bounded in number and bytes.
    fitted = found.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(fit, "weights binary").collect()
    if not fitted:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.frombuffer(fitted[0]["weights"], np.float32)


def score_quality(
    docs: DataFrame, weights: np.ndarray, bits: int = FEATURE_BITS, name: str = "quality_score"
) -> DataFrame:
    """Score every document: its columns and one more, 0 to 1, higher for better.

    Scored on whole texts as a sparse dot product; null and empty texts get the intercept's
    score. A column that already has the score's name is replaced.
    """
    ship_package(docs.sparkSession)
    kept = docs.drop(name)
    names = [*kept.columns, name]
    plain = [f"c{i}" for i in range(len(names))]  # so that names may hold anything
    at = names.index("text")
    renamed = kept.toDF(*plain[:-1])
    vector = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = vector.value
        for batch in slices(batches):
            scores = [score_text(weights, t.as_py(), bits) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], plain)

    return renamed.mapInArrow(run, renamed.withColumn(plain[-1], F.lit(0.0)).schema).toDF(*names)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, weights).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects, scores below THRESHOLD; all columns stay."""
    weights = fit_quality(docs, table(spark, sf_dir, "labels"))
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    kept = score_quality(docs, weights, name=name).where(F.col(name) >= THRESHOLD)
    return kept.drop(name)


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLE: dict[str, str] = {}
