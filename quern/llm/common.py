"""What the corpus operators share: worker set-up, checkpoints, splits and vectorised word hashing.

Texts are handled as whole UTF-8 byte runs in numpy.  A run holds as many neighbouring rows of an
Arrow batch as fit in ``RUN_BYTES`` (a longer text stands alone).  Words of a long text are hashed piece by
piece, so beyond the text itself memory holds eight bytes a word of it.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_BYTES = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)

#: ``[^\x20\x09-\x0D]+`` over UTF-8 bytes: these six bytes never occur inside a longer sequence.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def each_byte(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of 256 bytes or truths, several times faster; not to be written to."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), dtype=table.dtype)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """See that ``checkpoint()`` has a folder, and let Python workers import this package.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where all runs in this one
    process (tests) and none is set, a temporary one is made; a cluster without one is an error.  On a cluster the
    package goes to the workers as a file, by way of that folder.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    alone = re.match(r"local(\[|$)", context.master) is not None
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not alone:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    env = context.environment
    if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH", "")) if x)
    if not alone and context.applicationId not in _shipped:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as files:
            for path in sorted((root / "quern").rglob("*.py")):
                files.write(path, path.relative_to(root))
        target = f"{context.getCheckpointDir()}/quern-{uuid.uuid4().hex}.zip"
        place = context._jvm.org.apache.hadoop.fs.Path(target)
        out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(packed.getvalue()))
        out.close()
        context.addPyFile(target)
        _shipped.add(context.applicationId)


def shared_table(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written to the checkpoint folder and read again: unlike after a checkpoint, its size is known.

    A join then broadcasts it if that size is under the session's limit, without moving the other side.
    ``few``: for tables much smaller than the input, in two files a core at most, not one a shuffle partition.  Without
    native libraries Spark starts a process to set each file's rights, and an executor counts twice while it does.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with a number, such that no column of ``df`` has it (in any case of letters)."""
    taken, k, made = {c.lower() for c in df.columns}, 0, name
    while made.lower() in taken:
        k += 1
        made = f"{name}_{k}"
    return made


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hashes of ``key``: a top-k, not a sort of all rows."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """doc_id, label (0 or 1) and whole text of at most ``limit`` different rows, those with the smallest id hashes.

    Labels are bounded before the join and its rows after it, so repeated rows of ``docs`` make no more of them.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").distinct()
    chosen = bounded_sample(usable, "doc_id", limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # At most ``limit`` ids and labels: a bounded side.
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").distinct()
    return joined.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label", F.xxhash64("text"), "text").limit(limit)


def u64(x: int) -> np.uint64:
    return _U(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Positions of a word whose letter values are looked up; later ones are computed.
_NEAR = 64


def _letter_values(position: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each letter at each position of a word."""
    return mix(((position.astype(np.uint64) << _U(8)) | letter) * _MULT + _U(0x2545F4914F6CDD1D))


_VALUES = _letter_values(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256, dtype=np.uint64), _NEAR))


@dataclass
class Run:
    """Neighbouring rows: ``data`` has their bytes; row ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def runs(column: pa.Array | pa.ChunkedArray, limit: int = RUN_BYTES) -> Iterator[Run]:
    """The rows of a string column as runs of at most ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = int(offsets[first]), int(offsets[last])
        yield Run(first, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


@dataclass
class Words:
    """Words of a run: ``[starts, ends)`` in its bytes, and ``bounds[i]:bounds[i + 1]`` those of row i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def spans(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal stretches where ``inside`` holds, cut at the rows' ends."""
    n = len(inside)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def words_of(run: Run) -> Words:
    return spans(each_byte(WORD_BYTE, run.data), run.offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand; spans rise and do not overlap.

    Each byte at each position has a random number of its own, and a span's hash is the sum of its bytes'
    numbers: no algebra between positions that a repetitive text could meet, as a polynomial has.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    if 2 * total < len(data):
        # Few bytes of many: the spans' own are brought together first.
        bounds = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(lengths, out=bounds[1:])
        starts, ends, data = bounds[:-1], bounds[1:], data[np.arange(total) + np.repeat(starts - bounds[:-1], lengths)]
    # Each byte's place in its span; those between spans count on, and are left out of the sums.
    first, n = int(starts[0]), len(data)
    position = np.arange(n - first, dtype=np.int32)
    position -= np.repeat((starts - first).astype(np.int32), np.diff(np.append(starts, n)))
    letter = data[first:]
    far = np.flatnonzero(position >= _NEAR) if int(np.diff(np.append(starts, n)).max()) > _NEAR else ()
    index = np.minimum(position, _NEAR - 1)
    index <<= 8
    index |= letter
    sums = np.zeros(n - first + 1, dtype=np.uint64)
    values = _VALUES.take(index)
    if len(far):
        values[far] = _letter_values(position[far], letter[far].astype(np.uint64))
    np.cumsum(values, out=sums[1:])
    return mix(sums[ends - first] - sums[starts - first] + lengths.astype(np.uint64) * _MULT)


def pieces(run: Run, limit: int | None = None) -> Iterator[Run]:
    """A run in pieces of some ``limit`` bytes (``RUN_BYTES``), each ending before a space where there is one.

    Only a run of one long text comes in several; its words are those of the pieces in turn (a longer word stands whole),
    so what is computed byte by byte needs memory for a piece, not for the text.
    """
    limit = limit or RUN_BYTES
    if len(run.data) <= 2 * limit or run.rows > 1:
        yield run
        return
    first, n = 0, len(run.data)
    while first < n:
        last = min(first + limit, n)
        while last < n:
            spaces = np.flatnonzero(~WORD_BYTE[run.data[last : last + 4096]])
            if len(spaces):
                last += int(spaces[0])
                break
            last = min(last + 4096, n)
        yield Run(run.first, run.data[first:last], np.array([0, last - first], dtype=np.int64))
        first = last


def word_hashes(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a run, and the rows' bounds in them."""
    made = []
    for piece in pieces(run):
        words = words_of(piece)
        made.append((hash_spans(each_byte(LOWER_BYTE, piece.data), words.starts, words.ends), words.bounds))
    if len(made) == 1:
        return made[0]
    h = np.concatenate([h for h, _ in made])
    return h, np.array([0, len(h)], dtype=np.int64)


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` neighbouring hashes (windows may cross rows)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix(out + u64(width * int(_MULT)))


def strings(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]
