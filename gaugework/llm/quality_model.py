"""Quality classifier: a byte-level convolutional network in numpy.

A text is a row of bytes, cut into overlapping chunks that cover all of it. Every byte has a
learned vector; filters of ``WIDTH`` bytes slide over a chunk, and the largest answer of each
filter is the chunk's feature. Over the chunks of a document the features are averaged and their
maximum is taken, and a logistic layer turns both into one probability. Because a filter's answer
is a sum over its places, embedding and filter multiply out to one table per place, and scoring
needs only look-ups and additions.

Training (Adam on the log loss; the gradient passes through the places of the maxima) runs in one
task on at most ``TRAINING_ROWS`` labelled documents, whole texts, those whose ids hash lowest.

Defined results: a null or empty text is one chunk of padding and gets that score; repeated rows
are scored one by one; labels that are null or name no document are ignored, several labels of one
document count as good if any is; without labels every score is 0.5; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import narrowed, table, text_buffer
from gaugework.llm.toxicity import labelled

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 5_000
CHUNK, STEP = 256, 192
WIDTH, STRIDE, VECTOR, FILTERS = 8, 2, 8, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
PADDING = 256
TOGETHER, PASSES, RATE = 16, 3, 0.01
#: Few documents are passed over more often, until so many steps are made.
LEAST_STEPS = 600
#: Chunks that one numpy step handles.
BLOCK = 512

Model = dict[str, np.ndarray]


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end of the document) of every chunk; one at least per document."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(size)), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, offsets[doc] + within * STEP, offsets[doc + 1]


def _bytes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = first[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.full(at.shape, PADDING, np.int64)
    seen = data[np.minimum(at, len(data) - 1)].astype(np.int64)  # 256 doesn't fit a byte
    return np.where(at < end[:, None], seen, PADDING)


def _tables(m: Model) -> np.ndarray:
    """(place in the filter, byte, filter): what a byte adds there."""
    return np.einsum("bv,kvf->kbf", m["bytes"], m["filters"]).astype(np.float32)


def _answers(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(chunk, place, filter) before the bias."""
    out = np.zeros((len(x), PLACES, FILTERS), np.float32)
    for k in range(WIDTH):
        out += tables[k].take(x[:, k : k + STRIDE * (PLACES - 1) + 1 : STRIDE], axis=0)
    return out


def _start(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    return {
        "bytes": r.normal(0, 0.5, (PADDING + 1, VECTOR)),
        "filters": r.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)),
        "bias": np.zeros(FILTERS),
        "mean": r.normal(0, 0.1, FILTERS),
        "most": r.normal(0, 0.1, FILTERS),
        "out": np.zeros(1),
    }


def _gradient(m: Model, texts: list[bytes], y: np.ndarray) -> Model:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, first, end = chunks(offsets)
    x, tables = _bytes(data, first, end), _tables(m)
    at = np.empty((len(x), FILTERS), np.int64)
    top = np.empty((len(x), FILTERS))
    for i in range(0, len(x), BLOCK):
        a = _answers(tables, x[i : i + BLOCK])
        at[i : i + BLOCK] = a.argmax(axis=1)
        top[i : i + BLOCK] = a.max(axis=1)
    h = np.maximum(top + m["bias"], 0)
    edges = np.searchsorted(doc, np.arange(len(texts)))
    count = np.diff(np.append(edges, len(doc)))[:, None]
    mean = np.add.reduceat(h, edges) / count
    most = np.maximum.reduceat(h, edges)
    p = 1 / (1 + np.exp(-np.clip(mean @ m["mean"] + most @ m["most"] + m["out"][0], -30, 30)))
    g = (p - y) / len(texts)
    best = h == most[doc]
    best &= np.cumsum(best, axis=0) - (np.cumsum(best, axis=0) - best)[edges][doc] == 1  # one each
    dh = (g[:, None] * m["mean"] / count)[doc] + np.where(best, (g[:, None] * m["most"])[doc], 0)
    dh[h <= 0] = 0
    dt = np.zeros((WIDTH, (PADDING + 1) * FILTERS))
    rows, lane = np.arange(len(x))[:, None], np.arange(FILTERS)
    for k in range(WIDTH):
        seen = x[rows, at * STRIDE + k] * FILTERS + lane
        dt[k] = np.bincount(seen.ravel(), dh.ravel(), dt.shape[1])
    dt = dt.reshape(WIDTH, PADDING + 1, FILTERS)
    return {
        "bytes": np.einsum("kbf,kvf->bv", dt, m["filters"]),
        "filters": np.einsum("kbf,bv->kvf", dt, m["bytes"]),
        "bias": dh.sum(axis=0),
        "mean": g @ mean,
        "most": g @ most,
        "out": np.array([g.sum()]),
    }


def learn(texts: list[bytes], y: np.ndarray) -> Model:
    """Adam over the documents in a fixed shuffled order, ``PASSES`` times at least."""
    m, r = _start(), np.random.default_rng(11)
    m["out"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    t = 0
    for _ in range(max(PASSES, -(-LEAST_STEPS * TOGETHER // len(texts)))):
        order = r.permutation(len(texts))
        for i in range(0, len(order), TOGETHER):
            t += 1
            pick = order[i : i + TOGETHER]
            for k, g in _gradient(m, [texts[j] for j in pick], y[pick]).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] -= RATE * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
    return m


def fit(
    documents: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    rows: int = TRAINING_ROWS,
) -> Model:
    """The network learned from the labelled documents that ``allowed`` admits; its arrays, a few
    thousand numbers, come to the driver."""
    chosen = labelled(labels, "quality", allowed, rows)
    joined = narrowed(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [
            (i, (t or "").encode(), y)
            for b in batches
            for i, t, y in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "y")), strict=True)
        ]
        found.sort()
        y = np.array([y for _, _, y in found], float)
        m = learn([t for _, t, _ in found], y) if found else {}
        names = sorted(m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([m[k].astype("<f8").tobytes() for k in names], pa.binary())],
            ["name", "value"],
        )

    found = joined.repartition(1).mapInArrow(train, "name string, value binary").collect()
    blank = {k: np.zeros_like(v) for k, v in _start().items()}  # says 0.5 to everything
    return blank | {k: np.frombuffer(bytes(v), "<f8").reshape(blank[k].shape) for k, v in found}


def probabilities(m: Model, texts: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    doc, first, end = chunks(offsets)
    tables, total = _tables(m), np.zeros((n, FILTERS))
    most = np.zeros((n, FILTERS))  # answers count from zero up
    for i in range(0, len(doc), BLOCK):
        part = slice(i, i + BLOCK)
        top = _answers(tables, _bytes(data, first[part], end[part])).max(axis=1)
        h = np.maximum(top + m["bias"], 0)
        edges = np.flatnonzero(np.diff(doc[part], prepend=-1))
        at = doc[part][edges]
        total[at] += np.add.reduceat(h, edges)
        most[at] = np.maximum(most[at], np.maximum.reduceat(h, edges))
    mean = total / np.bincount(doc, minlength=n)[:, None] if n else total
    z = mean @ m["mean"] + most @ m["most"] + m["out"][0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with a probability in ``column``; whole texts, one pass, no shuffle."""
    schema = documents.drop(column).withColumn(column, F.lit(0.0)).schema
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pa.array(probabilities(shared.value, batch["text"]), pa.float64())
            kept = [i for i, name in enumerate(batch.schema.names) if name != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), p],
                [*(batch.schema.names[i] for i in kept), column],
            )

    return documents.mapInArrow(apply, schema)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(documents, table(spark, sf_dir, "labels"), fold != 2)
    return score(documents, model).select(
        "doc_id",
        (fold == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
