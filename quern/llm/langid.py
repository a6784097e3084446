"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of letter n-grams (n = 1 to 4) present in both, over the geometric
mean of the numbers present in each; n-grams are hashed to ``DIMENSION`` places, each n to a range of
its own.  A bounded sample of labelled rows (``PER_LANG`` of each language, smallest id hashes first)
gives the landmarks (``LANDMARKS`` of each) of a Nystrom map, and one-versus-rest kernel ridge regression
on the mapped sample gives a weight per landmark and language.  All other rows are scored in batches:
presence matrix x landmark presence matrix x weights.

Every language of a label is learned: with many of them each has fewer rows and landmarks, but never fewer than
``LEAST_ROWS`` (if it has them) and ``LEAST_LANDMARKS``, so the model grows with their number, not with the table.

A prediction reads the text alone.  Defined cases: a null text, or one without a letter, is ``und`` with
score 0; so is every text if the table has no labelled row.  A text of any length is read whole, piece by piece.  Of
languages that score alike the first by name wins.  Repeated rows score alike and teach once; extra columns are ignored; an
empty table gives an empty result and no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common

UNKNOWN = "und"
#: Rows of each language in the sample and landmarks of each: so many, or an even share of so many in all, but never fewer than a least.
PER_LANG, ALL_ROWS, LEAST_ROWS = 160, 3000, 12
LANDMARKS, ALL_LANDMARKS, LEAST_LANDMARKS = 24, 480, 3
RIDGE = 1e-2
#: Hashed places of 1-, 2-, 3- and 4-grams.
PLACES = (1 << 9, 1 << 12, 1 << 14, 1 << 14)
DIMENSION = sum(PLACES)
#: Rows scored by one matrix product.
BATCH = 64

_U = np.uint64
_MULT = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93))
#: Letters: any byte of a multi-byte sequence, and A-Z, a-z.  Others stand for a word's border.
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def presence(run: common.Run) -> np.ndarray:
    """A row of zeros and ones for each text of a run."""
    out = np.zeros((run.rows, DIMENSION), dtype=np.float32)
    # A long text comes in overlapping pieces, so that no gram is cut and memory is that of a piece.
    step = common.RUN_BYTES
    if run.rows == 1 and len(run.data) > 2 * step:
        for lo in range(0, len(run.data), step):
            piece = run.data[lo : lo + step + len(PLACES) - 1]
            _mark(out, common.Run(0, piece, np.array([0, len(piece)], dtype=np.int64)))
    else:
        _mark(out, run)
    return out


def _mark(out: np.ndarray, run: common.Run) -> None:
    letters = _LETTER[run.data].astype(np.uint64)
    rows = np.repeat(np.arange(run.rows, dtype=np.int64) * DIMENSION, np.diff(run.offsets))
    ends = np.repeat(run.offsets[1:], np.diff(run.offsets))
    at = np.arange(len(letters))
    flat, gram, first = out.reshape(-1), np.zeros(len(letters), dtype=np.uint64), 0
    for n, places in enumerate(PLACES, 1):
        gram = gram[: len(letters) - n + 1] * _U(257) + letters[n - 1 :] + _U(1) if len(letters) >= n else gram[:0]
        # A gram of borders only says nothing.
        inside = (at[: len(gram)] + n <= ends[: len(gram)]) & (letters[: len(gram)] + letters[n - 1 :][: len(gram)] > 0)
        place = (gram[inside] * _MULT[n - 1]) >> _U(64 - (places.bit_length() - 1))
        flat[rows[: len(gram)][inside] + place.astype(np.int64) + first] = 1.0
        first += places


@dataclass
class Model:
    langs: list[str]
    #: Landmarks' presence (DIMENSION, m), over the root of each one's count, and weights (m, languages).
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the best language, and its share by a softmax of the regressions' values."""
        values = self.kernel(x) @ self.weights
        shares = np.exp(8.0 * (values - values.max(axis=1, keepdims=True)))
        best = values.argmax(axis=1)
        return best, np.clip(1.0 / shares.sum(axis=1), 0.0, 1.0)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Nystrom kernel ridge regression, one language against the rest."""
    names = sorted(set(langs))
    x = np.concatenate([presence(r) for r in common.runs(pa.array(texts, pa.string()))])
    y = np.array([names.index(v) for v in langs])
    marks_each = max(LEAST_LANDMARKS, min(LANDMARKS, ALL_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(y == k)[:marks_each] for k in range(len(names))])
    marks = (x[chosen] / np.sqrt(np.maximum(x[chosen].sum(axis=1, keepdims=True), 1.0))).T.copy()
    model = Model(names, marks, np.zeros((len(chosen), len(names)), dtype=np.float32))
    k_nm = model.kernel(x).astype(np.float64)
    values, vectors = np.linalg.eigh(k_nm[chosen])
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = k_nm @ root
    # Each language weighs the same, however many rows it has.
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    gram = (mapped * weight[:, None]).T @ mapped + RIDGE * np.eye(mapped.shape[1])
    target = (y[:, None] == np.arange(len(names))) * weight[:, None]
    model.weights = (root @ np.linalg.solve(gram, mapped.T @ target)).astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a bounded sample of the rows with a language; None if there are none."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    # A row a language.
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    # A share of the id hashes that holds some three times the rows needed; the smallest hashes of these are taken.
    span, each = 1 << 30, max(LEAST_ROWS, min(PER_LANG, ALL_ROWS // len(counts)))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(span))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(span, 64 + span * 3 * each // r["count"]))])[F.col("lang")]
    near = labelled.withColumn("place", place).where((F.col("place") < share) & F.col("text").rlike(r"\p{L}"))
    # Rows that are alike teach once, and a language has some three times PER_LANG others here, so the window's groups are bounded.
    near = near.dropDuplicates(["lang", "place", "id", "text"])
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text")))
    rows = near.where(F.col("rank") <= each).orderBy("lang", "rank").select("text", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    spark = docs.sparkSession
    common.prepare(spark)
    # Of fixed size: DIMENSION x landmarks.
    shipped = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("has_letter", pa.bool_())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                for run in common.runs(part.column(1)):
                    ids, letters = part.column(0).slice(run.first, run.rows), part.column(2).slice(run.first, run.rows)
                    if known is None:
                        best, score = [UNKNOWN] * run.rows, np.zeros(run.rows)
                    else:
                        index, score = known.predict(presence(run))
                        best = [known.langs[k] for k in index]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.string()), pa.array(score.astype(np.float64)), letters], schema=schema)

    has_letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), has_letter.alias("has_letter"))
    out = read.mapInArrow(over, "doc_id long, lang_pred string, score double, has_letter boolean")
    return out.select("doc_id", F.when(F.col("has_letter"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("has_letter"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def filter_documents(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text a language is found with a score of ``least``.

    Without a model (no labelled row) every text with a letter stays.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    lettered = docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return lettered
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                scores = [shipped.value.predict(presence(run))[1] for run in common.runs(part.column(at))]
                yield part.filter(pa.array(np.concatenate(scores) >= least))

    return lettered.mapInArrow(over, docs.schema)
