"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

A bounded sample of labelled rows (``TRAIN_ROWS``, smallest id hashes first) gives a weighted lexicon: the
words, and stems of ``STEMS`` letters that longer words begin with (written with a star), whose document frequency under the label stands out: log-odds of at least ``MIN_ODDS`` even two
standard errors lower, and at least ``MIN_DOCS`` documents that no stronger word explains (or a
share of ``COMMON`` of the label's documents).
Features: densities and counts of lexicon words, their nearness to second-person words, shares of
capitals and of punctuation marks, rate of obfuscated words (lexicon words once digits and signs are
read as letters and separators dropped), and length.  Trees are grown by histograms on four fifths of
the sample, each quarter of it under the lexicon of the others; pool-adjacent-violators on the last fifth makes scores
probabilities.

A score reads the text alone.  Defined cases: null or wordless text has zero features and its score is
what the model gives for them; with no labelled row, or one label only, every score is the labels'
share (0 without any).  Texts are read whole, long ones in pieces.  Of equal odds the first word by name counts first.  Repeated
rows score alike and teach once; an id with both labels teaches both; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common

#: Labelled rows learned from; least log-odds and documents of a lexicon word, share that always counts; rows too few to set some aside; parts that
#: take their lexicon from the others.
TRAIN_ROWS, MIN_ODDS, MIN_DOCS, COMMON, FEW, CROSSED = 12_000, 2.5, 8, 0.05, 250, 4
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
STEMS = (4, 5, 6)
#: A word at most this many words from a second-person word is near it.
NEAR = 3
#: Second-person words of the languages met most.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro tuyo"
#: Signs read as letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_U = np.uint64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_READ = common.LOWER_BYTE.copy()
for _sign, _letter in LOOKALIKES.items():
    _READ[ord(_sign)] = ord(_letter)
FEATURES = ("density", "weight_density", "log_hits", "distinct_words", "max_weight", "near_second_person", "second_person", "capitals", "capital_words", "marks", "exclamations", "obfuscated", "log_obfuscated", "log_words")


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(common.hash_spans(data, np.array([0]), np.array([len(data)]))[0])


@dataclass
class Lexicon:
    """Sorted hashes and their weights; stems have a lexicon of their own inside."""

    hashes: np.ndarray
    weights: np.ndarray
    stems: Lexicon | None = None

    @staticmethod
    def of(weights: dict[str, float]) -> Lexicon:
        def table(pairs: list[tuple[int, float]]) -> Lexicon:
            pairs.sort()
            return Lexicon(np.array([h for h, _ in pairs], dtype=np.uint64), np.array([v for _, v in pairs], dtype=np.float64))

        out = table([(word_hash(w), v) for w, v in weights.items() if not w.endswith("*")])
        out.stems = table([(word_hash(w[:-1]), v) for w, v in weights.items() if w.endswith("*")])
        return out

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Each hash's weight, 0 if it is not in the lexicon."""
        if not len(self.hashes) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)


_second = Lexicon.of(dict.fromkeys(SECOND_PERSON.split(), 1.0))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def stem_weights(data: np.ndarray, tokens: common.Words, lexicon: Lexicon) -> np.ndarray:
    """Each token's strongest stem."""
    out = np.zeros(len(tokens.starts))
    if lexicon.stems is None or not len(lexicon.stems.hashes):
        return out
    lower = common.LOWER_BYTE[data]
    begins = (data & 0xC0) != 0x80
    letters_before = np.concatenate([[0], np.cumsum(begins)])
    letter_at = np.concatenate([np.flatnonzero(begins), [len(data)]])
    first, last = letters_before[tokens.starts], letters_before[tokens.ends]
    for k in STEMS:
        some = np.flatnonzero(last - first > k)
        h = common.hash_spans(lower, tokens.starts[some], letter_at[first[some] + k])
        out[some] = np.maximum(out[some], lexicon.stems.look_up(h))
    return out


def measure(run: common.Run, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' sums (in the order that ``features`` reads them), strongest weights, and their different lexicon words as (row, hash)."""
    data, bytes_of = run.data, run.offsets
    tokens = common.spans(_LETTER[data], bytes_of)
    h = common.hash_spans(common.LOWER_BYTE[data], tokens.starts, tokens.ends)
    weight = np.maximum(lexicon.look_up(h), stem_weights(data, tokens, lexicon))
    hit, rows = weight > 0, tokens.rows()
    you = np.flatnonzero(_second.look_up(h) > 0)
    near = np.zeros(len(h), dtype=bool)
    if len(you):
        hits = np.flatnonzero(hit)
        for shift in (-1, 0):
            at = np.clip(np.searchsorted(you, hits) + shift, 0, len(you) - 1)
            near[hits] |= (np.abs(you[at] - hits) <= NEAR) & (rows[you[at]] == rows[hits])
    words = common.words_of(run)

    # Words read with signs as letters, and without whatever is no letter then.
    read = _READ[data]
    kept = _LETTER[read]
    moved = np.concatenate([[0], np.cumsum(kept)])
    plain_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    starts, ends = moved[words.starts], moved[words.ends]
    inner = (plain_letters[words.ends] - plain_letters[words.starts]) < (words.ends - words.starts)
    some = np.flatnonzero(inner & (ends - starts >= 3))
    hidden = np.zeros(len(words.starts))
    if len(some):
        # The last sign may be a mark: read the word also without its outer signs.
        squeezed = read[kept]
        hidden[some] = lexicon.look_up(common.hash_spans(squeezed, starts[some], ends[some])) > 0
        # A plain lexicon word with marks around it hides nothing.
        token_hits = np.concatenate([[0], np.cumsum(hit)])
        first = np.searchsorted(tokens.starts, words.starts[some])
        last = np.searchsorted(tokens.starts, words.ends[some])
        hidden[some] *= (token_hits[last] - token_hits[first]) == 0
    upper = _UPPER[data]
    upper_sums = np.concatenate([[0], np.cumsum(upper)])
    shouted = (tokens.ends - tokens.starts >= 3) & (upper_sums[tokens.ends] - upper_sums[tokens.starts] == tokens.ends - tokens.starts)

    strongest = np.zeros(run.rows)
    at = np.flatnonzero(hit)
    np.maximum.at(strongest, rows[at], weight[at])
    pairs = np.unique(np.stack([rows[at].astype(np.uint64), h[at]]), axis=1)
    spoken = np.zeros(len(h), dtype=bool)
    spoken[you] = True
    sums = [per_row(x, tokens.bounds) for x in (hit, weight, near, spoken, shouted)] + [per_row(hidden, words.bounds)]
    sums += [per_row(x, bytes_of) for x in (upper, _LETTER[data], _MARK[data], data == 33)]
    return np.stack([*sums, np.diff(words.bounds), np.diff(tokens.bounds), np.diff(bytes_of)], axis=1).astype(float), strongest, pairs


def features(run: common.Run, lexicon: Lexicon) -> np.ndarray:
    """The rows' features, in the order of ``FEATURES``; a long text is measured in pieces (nearness does not cross them)."""
    parts = [measure(piece, lexicon) for piece in common.pieces(run)]
    sums = np.sum([p[0] for p in parts], axis=0)
    strongest = np.max([p[1] for p in parts], axis=0)
    pairs = parts[0][2] if len(parts) == 1 else np.unique(np.concatenate([p[2] for p in parts], axis=1), axis=1)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=run.rows).astype(float)
    hits, weights, near, you, shouted, obscured, upper, letters, marks, calls, n_words, n_tokens, size = sums.T
    n, t, letters, size = np.maximum(n_words, 1), np.maximum(n_tokens, 1), np.maximum(letters, 1), np.maximum(size, 1)
    columns = (
        hits / t, weights / t, np.log1p(hits), distinct, strongest, near / np.maximum(hits, 1), you / t, upper / letters, shouted / t,
        marks / size, calls / size, obscured / n, np.log1p(obscured), np.log1p(n_words),
    )
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """Complete trees of ``DEPTH``: per tree the features and thresholds of its inner nodes, and its leaves."""

    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, threshold, leaves in self.splits:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > threshold[node])
            out += leaves[node - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting of the logistic loss with histogram splits."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    forest = Forest(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Rare non-zero values have a bin of their own, which quantiles would not see.
    edges = [np.unique(np.concatenate([[0.0] if c.min() >= 0 else [], e, np.quantile(c[c > 0], [0.25, 0.5, 0.75]) if (c > 0).any() else []])) for c, e in zip(x.T, edges, strict=True)]
    binned = np.stack([np.searchsorted(e, c, side="left") for c, e in zip(x.T, edges, strict=True)], axis=1)
    width = max(len(e) for e in edges) + 1
    raw = np.full(len(x), forest.base)
    inner, leaves_n = 2**DEPTH - 1, 2**DEPTH
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, w = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-6)
            for f in range(x.shape[1]):
                key = at * width + binned[:, f]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                ws = np.bincount(key, w, count * width).reshape(count, width).cumsum(1)
                total_g, total_w = gs[:, -1:], ws[:, -1:]
                gain = gs**2 / (ws + 1) + (total_g - gs) ** 2 / (total_w - ws + 1) - total_g**2 / (total_w + 1)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    won = gain[np.arange(count), k]
                    better = won > best
                    best[better] = won[better]
                    feature[first + np.flatnonzero(better)] = f
                    threshold[first + np.flatnonzero(better)] = edges[f][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        values = -RATE * np.bincount(leaf, g, leaves_n) / (np.bincount(leaf, w, leaves_n) + 1)
        forest.splits.append((feature, threshold, values))
        raw += values[leaf]
    return forest


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising knots (score, probability), to be read by linear interpolation."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([v, 1.0, s, 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2, m2 = blocks.pop()
            v1, n1, s1, m1 = blocks[-1]
            blocks[-1] = [v1 + v2, n1 + n2, (s1 * m1 + s2 * m2) / (m1 + m2), m1 + m2]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    forest: Forest
    knots: np.ndarray
    levels: np.ndarray

    def score(self, run: common.Run) -> np.ndarray:
        if not self.forest.splits:
            return np.full(run.rows, float(self.levels[0]))
        return np.clip(np.interp(self.forest.raw(features(run, self.lexicon)), self.knots, self.levels), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words whose document frequency under label 1 stands out, with their log-odds; ``sample`` is bounded, so its words are."""
    tally = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = tally.get(1, 0), tally.get(0, 0)
    if not positives or not negatives:
        return {}
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))

    def stems(k: int) -> Column:
        return F.transform(F.filter(tokens, lambda t: F.length(t) > k), lambda t: F.concat(F.substring(t, 1, k), F.lit("*")))

    split = F.array_distinct(F.concat(tokens, *map(stems, STEMS)))
    counts = sample.select("label", F.explode(split).alias("word")).where("length(word) > 1").groupBy("word").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("a") >= MIN_DOCS)
    odds = lambda k, of: F.log((k + 0.5) / (F.lit(of) - k + 0.5))
    b = F.col("n") - F.col("a")
    weighed = counts.withColumn("odds", odds(F.col("a"), positives) - odds(b, negatives)).withColumn("low", F.col("odds") - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (b + 0.5)))
    rows = weighed.where(F.col("low") >= MIN_ODDS).orderBy(F.desc("low"), "word").collect()
    odds_of = {r["word"]: float(r["odds"]) for r in rows}
    common_words = {r["word"] for r in rows if r["a"] >= COMMON * positives}
    # Words that only go along with stronger ones (in copies of one text, say) explain no further document.
    holding = sample.where("label = 1").select(F.array_intersect(split, F.lit(list(odds_of) or [""])).alias("words")).collect()
    within: dict[str, list[int]] = {}
    for k, r in enumerate(holding):
        for word in r["words"]:
            within.setdefault(word, []).append(k)
    explained, lexicon = set(), {}
    for word in odds_of:
        new = [k for k in within.get(word, ()) if k not in explained]
        if word in common_words or len(new) >= MIN_DOCS:
            lexicon[word] = odds_of[word]
            explained.update(new)
    return lexicon


def _measured(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, in an order of its own."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.runs(batch.column(2)):
                x = [row.tobytes() for row in features(run, lexicon)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(run.first, run.rows) for k in (0, 1)), pa.array(x, pa.binary())], schema=schema)

    got = sample.select("doc_id", "label", "text").mapInArrow(over, "doc_id long, label int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["label"], bytes(r["x"])))
    if not got:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.stack([np.frombuffer(r["x"], np.float64) for r in got]), np.array([r["label"] for r in got], dtype=float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of ``labels``' rows joined to their whole texts.

    A fifth of the sample, by a hash of the text, calibrates and teaches nothing else.  The trees learn from features of each
    quarter of the rest under a lexicon of the other three, so that no row's words were chosen by its own label; the
    lexicon of all the rest scores.
    """
    common.prepare(docs.sparkSession)
    # By the text, so that copies stand on one side.
    fold = F.pmod(F.xxhash64(F.lower(F.coalesce("text", F.lit(""))), F.lit(5)), F.lit(10))
    sample = common.labelled_sample(docs, labels, id_col, text_col, label_col, TRAIN_ROWS).withColumn("fold", fold).checkpoint()
    tally = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = tally.get(1, 0), tally.get(0, 0)
    if not ones or not zeros:
        return Model(Lexicon.of({}), Forest(), np.zeros(1), np.array([1.0 if ones else 0.0]))
    # With a handful of rows nothing can be set aside.
    few = ones + zeros < FEW
    rest = sample if few else sample.where("fold >= 2")
    lexicon = Lexicon.of(learn_lexicon(rest))
    part = F.col("fold") % CROSSED
    crossed = [_measured(rest.where(part == k), Lexicon.of(learn_lexicon(rest.where(part != k)))) for k in range(CROSSED)]
    x, y = np.concatenate([c[0] for c in crossed]), np.concatenate([c[1] for c in crossed])
    forest = grow(x, y)
    held, truth = _measured(rest if few else sample.where("fold < 2"), lexicon)
    if not len(truth):
        held, truth = _measured(rest, lexicon)
    knots, levels = isotonic(forest.raw(held), truth)
    return Model(lexicon, forest, knots, levels)


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
