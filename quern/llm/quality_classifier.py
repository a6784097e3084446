"""Document quality by hashed word n-grams and logistic regression, trained by follow-the-regularised-leader.

Features are n-grams (n = 1, 2) of words and of word shapes (letters to A or a, digits to 0, runs to one
character, other characters as they stand), and the pattern of words equal to one of the two before
them; all are hashed to ``DIMENSION`` places.  A feature's value is its share of the document's
n-grams of its family, so a document of any length is scored by a mean of weights.  FTRL-proximal runs
over a bounded sample of labelled rows (``TRAIN_ROWS``, smallest id hashes first); all rows are then
scored as sparse dot products.

A score reads the text alone.  Defined cases: null or wordless text has no feature and scores by the
bias; with no labelled row every score is 0.5.  Texts are read whole, long ones in pieces.  Repeated rows score alike and
teach once; an id with both labels teaches both; extra columns are ignored; labels that are null or not 0 or 1 are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

TRAIN_ROWS, EPOCHS = 4000, 4
DIMENSION = 1 << 18
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
#: A document's feature values of a family sum to this.
SCALE = 8.0

_U = np.uint64
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97
_RUNS = np.zeros(256, dtype=bool)
_RUNS[[65, 97, 48]] = True


def shape_hashes(data: np.ndarray, words: common.Words) -> np.ndarray:
    """The hash of each word's shape."""
    kind = _CLASS[data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[kind[1:]]
    keep[words.starts] = True
    moved = np.concatenate([[0], np.cumsum(keep)])
    return common.hash_spans(kind[keep], moved[words.starts], moved[words.ends])


def families(run: common.Run) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family its features' places and the rows' bounds in them."""
    h, bounds = common.word_hashes(run)
    shapes = np.concatenate([shape_hashes(piece.data, common.words_of(piece)) for piece in common.pieces(run)])
    counts = np.diff(bounds)
    pair_bounds = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
    inner = np.ones(max(len(h) - 1, 0), dtype=bool)
    crossing = bounds[1:-1]
    inner[crossing[(crossing > 0) & (crossing < len(h))] - 1] = False
    again = np.zeros(len(h), dtype=np.uint64)
    rows = np.repeat(np.arange(run.rows), counts)
    for back in (1, 2):
        again[back:] |= ((h[back:] == h[:-back]) & (rows[back:] == rows[:-back])).astype(np.uint64) << _U(back - 1)
    out = []
    for salt, (values, at) in enumerate([(h, bounds), (common.chain(h, 2)[inner], pair_bounds), (shapes, bounds), (common.chain(shapes, 2)[inner], pair_bounds), (again, bounds)], 1):
        places = common.mix(values ^ common.u64(salt * 0x9E3779B97F4A7C15)) >> _U(64 - (DIMENSION.bit_length() - 1))
        out.append((places.astype(np.int32), at))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, run: common.Run) -> np.ndarray:
        total = np.full(run.rows, self.bias)
        for places, bounds in families(run):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
            total += SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def sparse_rows(run: common.Run) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct places and values."""
    made = families(run)
    out = []
    for i in range(run.rows):
        places, values = [], []
        for at, bounds in made:
            part = at[bounds[i] : bounds[i + 1]]
            if len(part):
                distinct, n = np.unique(part, return_counts=True)
                places.append(distinct)
                values.append(SCALE * n / len(part))
        if not places:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        distinct, inverse = np.unique(np.concatenate(places), return_inverse=True)
        out.append((distinct, np.bincount(inverse, weights=np.concatenate(values)).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal, one row at a time in the given order; each class weighs the same in the bias' start."""
    z, n = np.zeros(DIMENSION), np.zeros(DIMENSION)
    bias, bias_n = 0.0, 0.0
    for _ in range(epochs):
        for places, values, label in rows:
            zs, ns = z[places], n[places]
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values + bias, -30, 30)))
            g = (p - label) * values
            z[places] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[places] = ns + g * g
            bias_n += (p - label) ** 2
            bias -= 0.1 * (p - label) / (1.0 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from a bounded sample of ``labels``' rows joined to their whole texts."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("places", pa.binary()), ("shares", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.runs(batch.column(2)):
                rows = sparse_rows(run)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(run.first, run.rows) for k in (0, 1)), pa.array([p.tobytes() for p, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                    schema=schema,
                )

    joined = common.labelled_sample(docs, labels, id_col, text_col, label_col, TRAIN_ROWS)
    got = joined.mapInArrow(over, "doc_id long, label int, places binary, shares binary").collect()
    got.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), bytes(r["places"])))
    return fit([(np.frombuffer(r["places"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in got])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (that the label is 1) and predicted of every whole text."""
    spark = docs.sparkSession
    common.prepare(spark)
    shipped = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows), pa.array(shipped.value.score(run))], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(over, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def filter_documents(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``least``."""
    spark = docs.sparkSession
    common.prepare(spark)
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.runs(batch.column(at)):
                yield batch.slice(run.first, run.rows).filter(pa.array(shipped.value.score(run) >= least))

    return docs.mapInArrow(over, docs.schema)
