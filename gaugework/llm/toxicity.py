"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, neighbouring pairs and pairs with one word between, hashed into
``2 ** BITS`` coordinates, each present or absent. A word is a run of letters, digits and
non-ASCII bytes with A-Z folded, so that ``Word``, ``word.`` and ``word***`` agree. FTRL-proximal
keeps a learning rate per coordinate, and its L1 term leaves only the coordinates with steady
evidence away from zero: the model is a short list of (coordinate, weight), never more than
``2 ** BITS`` entries, which is what makes it safe to broadcast.

Defined results: a null or empty text has the score of the intercept alone; repeated rows are
scored one by one; labels that are null or name no document are ignored; several labels of one
document count as toxic if any is; extra columns of any name are ignored; with no usable label
every score is 0.5 and, in a filter, every row stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import document_runs, mixed, narrowed, table, text_buffer, word_hashes

BITS = 20
#: At most so many labelled documents are learned from: those whose ids hash lowest.
TRAINING_ROWS = 16_000
PASSES = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 3.0, 1.0


@dataclass(frozen=True)
class Weights:
    """The coordinates that are not zero, their weights and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    out[0x80:] = False
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = False
    return out


def _folding() -> np.ndarray:
    out = np.arange(256)
    out[ord("A") : ord("Z") + 1] += 32
    return out


SEPARATORS, FOLDING = _separators(), _folding()


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, coordinate) for runs of documents; a feature
    that a document holds twice comes twice."""
    data, offsets = text_buffer(texts)
    for a, b in document_runs(offsets):
        part = data[offsets[a] : offsets[b]]
        h, doc, _, _ = word_hashes(part, offsets[a : b + 1] - offsets[a], SEPARATORS, FOLDING)
        near = doc[1:] == doc[:-1]
        far = doc[2:] == doc[:-2]
        pair = mixed(h[:-1] * np.uint64(3) + h[1:])[near]
        skip = mixed(h[:-2] * np.uint64(5) + h[2:] + np.uint64(1))[far]
        coordinate = (np.concatenate([h, pair, skip]) >> np.uint64(64 - BITS)).astype(np.int64)
        yield a, b, np.concatenate([doc, doc[:-1][near], doc[:-2][far]]), coordinate


def _learn(examples: list[tuple[np.ndarray, int]]) -> Weights:
    """One FTRL-proximal run over the examples in their order, ``PASSES`` times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    positives = sum(y for _, y in examples)
    intercept = float(np.log((positives + 1) / (len(examples) - positives + 1)))
    for _ in range(PASSES):
        for x, y in examples:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(
                np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + root) / ALPHA + L2)
            )
            p = 1 / (1 + np.exp(-np.clip(intercept + w.sum(), -30, 30)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] = nx + g * g
            intercept -= 0.002 * g
    kept = np.flatnonzero(np.abs(z) > L1)
    zk = z[kept]
    weight = -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(n[kept])) / ALPHA + L2)
    return Weights(kept, weight, intercept)


def labelled(labels: DataFrame, label: str, allowed: Column | None, rows: int) -> DataFrame:
    """(doc_id, y): one row per labelled document, at most ``rows`` of them, those whose ids
    hash lowest. Only ids and labels take part in the choice."""
    y = narrowed(labels, "doc_id", label).where(
        F.col("doc_id").isNotNull() & F.col(label).isNotNull()
    )
    if allowed is not None:
        y = y.where(allowed)
    y = y.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    rows: int = TRAINING_ROWS,
) -> Weights:
    """Learn from the labelled documents that ``allowed`` (a condition on doc_id) admits.

    The features are extracted by all tasks; the sequential part sees at most ``rows`` rows of
    feature numbers and returns the non-zero weights, which come to the driver.
    """
    chosen = labelled(labels, "toxic", allowed, rows)
    joined = narrowed(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for a, b, doc, coordinate in features(batch["text"]):
                key = np.unique(doc << BITS | coordinate)
                cuts = np.searchsorted(key, np.arange(b - a + 1) << BITS)
                key = (key & ((1 << BITS) - 1)).astype("<i4")
                out += [key[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["y"], pa.array(out, pa.binary())], ["doc_id", "y", "x"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*r,) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        # An order that follows from the rows alone: a task that is run again learns the same.
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, r[0], r[2]))
        w = _learn([(np.frombuffer(x, "<i4").astype(np.int64), y) for _, y, x in rows])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(w.index, -1), pa.int64()),
                pa.array(np.append(w.weight, w.intercept if rows else 0.0), pa.float64()),
            ],
            ["i", "w"],
        )

    found = (
        joined.mapInArrow(extract, "doc_id long, y int, x binary")
        .repartition(1)
        .mapInArrow(learn, "i long, w double")
        .toPandas()
    )
    index, weight = found["i"].to_numpy(np.int64), found["w"].to_numpy(float)
    own = index < 0
    order = np.argsort(index[~own])
    return Weights(index[~own][order], weight[~own][order], float(weight[own].sum()))


def score(documents: DataFrame, model: Weights, column: str = "score") -> DataFrame:
    """``documents`` with a probability in ``column``; whole texts, one pass, no shuffle."""
    schema = documents.drop(column).withColumn(column, F.lit(0.0)).schema
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = np.zeros(1 << BITS)
        dense[m.index] = m.weight
        for batch in batches:
            total = np.full(batch.num_rows, m.intercept)
            for a, _, doc, coordinate in features(batch["text"]):
                held = dense[coordinate] != 0
                key = np.unique(doc[held] << BITS | coordinate[held])
                np.add.at(total, a + (key >> BITS), dense[key & ((1 << BITS) - 1)])
            p = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())
            kept = [i for i, name in enumerate(batch.schema.names) if name != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), p],
                [*(batch.schema.names[i] for i in kept), column],
            )

    return documents.mapInArrow(apply, schema)


def learnable() -> Column:
    """The fold that labels may be learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"), learnable())
    return score(documents, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score 0.5 or more go. The labels learned from are those of
    the documents at hand in the learnable fold, as in :func:`op1_toxicity`."""
    model = fit(docs, table(spark, sf_dir, "labels"), learnable())
    if not len(model.index) and model.intercept == 0:
        return docs  # no usable label
    columns = docs.columns
    scored = score(docs, model, "__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*[F.col(f"`{c}`") for c in columns])
