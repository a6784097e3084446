"""Document scores by masked pseudo-likelihood under a bidirectional window network.

A lower-cased word is a path of three choices: its class (one of the ``SINGLES`` most frequent words, or one
of ``RANGES`` classes of word endings) and, below a class of endings, two digits of its hash.  The network
reads the ``SIDE`` words on each side of the masked word (embeddings, one hidden layer) and predicts each
choice given those before it: a softmax over classes, one over the first digit given the class, one over the
second given both.  Each softmax starts from the corpus shares of its choices, so the network learns how
the words around move them.  What is left, the word's share among those of equal digits, comes from the corpus
counts (``BUCKETS`` hashed places).  A document's log-likelihood is the sum over its words of

    log P(class | both sides) + log P(digit 1 | class, both sides) + log P(digit 2 | digit 1, class, both sides) + log share

and the probabilities of all words sum to 1 in every context.

Training runs in numpy on every document, once.  Documents are dealt by a hash of id and text to ``ROUNDS``
rounds and in each to shards of some ``SHARD_ROWS``; a shard's documents are read in the order of their
hashes.  Every shard runs stochastic steps from the round's start, and the shards' parameters are averaged by
their numbers of words, in a tree of sums over shard numbers.  So the model depends on the documents, not on
how their table is partitioned.  Nothing that grows with the corpus comes to the driver: it holds the counts
(of fixed size) and one set of parameters.

Defined cases: null or wordless text has 0 tokens, log-likelihood 0 and no mean.  Texts are read whole;
windows end at a document's ends.  Repeated rows score alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

#: Classes of word endings, classes of single words, values of a digit, places that share both digits.
RANGES, SINGLES, DIGIT, TAILS = 32, 64, 64, 8
CLASSES, NODES, LEAVES = SINGLES + RANGES, RANGES * DIGIT, RANGES * DIGIT * DIGIT
BUCKETS = LEAVES * TAILS
SIDE, VOCABULARY, WIDTH, HIDDEN = 2, 8192, 12, 16
ROUNDS, SHARD_ROWS, BATCH, CHUNK, RATE = 2, 4096, 2048, 1 << 16, 0.1
SEED = 7
#: Parameters travel in pieces of this many numbers; sums join this many shards at a time.
PIECE, FAN_IN = 1 << 14, 16
#: Bytes of text hashed at a time: what is computed a byte stays in a core's cache.
RUN_BYTES = 1 << 18
#: Words scored by one matrix product; scores that exp may take as they are.
BLOCK, MOST_SCORE = 2048, 60.0

_U = np.uint64


def buckets_of(run: common.Run) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket, and the rows' bounds."""
    made = []
    for piece in common.pieces(run):
        data = common.each_byte(common.LOWER_BYTE, piece.data)
        words = common.words_of(piece)
        h = common.hash_spans(data, words.starts, words.ends)
        if len(h):
            last = data[words.ends - 1].astype(np.uint64)
            before = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
            ending = common.mix(last * _U(256) + before) % _U(RANGES)
            per = BUCKETS // RANGES
            h = ending * _U(per) + h % _U(per)
        made.append((h.astype(np.int32), words.bounds))
    if len(made) == 1:
        return made[0]
    buckets = np.concatenate([b for b, _ in made])
    return buckets, np.array([0, len(buckets)], dtype=np.int64)


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets, and as bucket -1 that of the texts with a word."""
    counts, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for run in common.runs(batch.column(0), RUN_BYTES):
            buckets, bounds = buckets_of(run)
            rows += int(np.count_nonzero(np.diff(bounds)))
            counts += np.bincount(buckets, minlength=BUCKETS)
    some = np.concatenate([[-1], np.flatnonzero(counts)])
    values = np.concatenate([[rows], counts[some[1:]]])
    for lo in range(0, len(some) if rows else 0, 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(some[lo : lo + 100_000].astype(np.int32)), pa.array(values[lo : lo + 100_000])], schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64())]))


@dataclass
class Vocabulary:
    """The corpus' log shares: of the classes, of digit 1 in its class, of digit 2 in its node, of a bucket in its leaf."""

    classes: np.ndarray
    first: np.ndarray
    second: np.ndarray
    tails: np.ndarray
    #: The single class of a bucket, or -1.
    single: np.ndarray

    @staticmethod
    def of(buckets: np.ndarray, n: np.ndarray) -> Vocabulary:
        # A bucket never counted (in another corpus) counts as half a word.
        counts = np.full(BUCKETS, 0.5)
        counts[buckets] = n
        single = np.full(BUCKETS, -1, dtype=np.int8)
        top = buckets[np.lexsort((buckets, -n))][:SINGLES]
        single[top] = np.arange(len(top))
        alone = np.zeros(SINGLES)
        alone[: len(top)] = counts[top]
        counts[top] = 0.0
        leaves = np.maximum(counts.reshape(LEAVES, TAILS).sum(1), 1e-9)
        nodes = leaves.reshape(NODES, DIGIT).sum(1)
        ranges = nodes.reshape(RANGES, DIGIT).sum(1)
        both = np.maximum(np.concatenate([alone, ranges]), 1e-9)
        log = lambda part, whole: np.log(part / whole).astype(np.float32)
        tails = np.log(np.maximum(counts, 1e-300) / np.repeat(leaves, TAILS))
        tails[top] = 0.0
        return Vocabulary(log(both, both.sum()), log(nodes.reshape(RANGES, DIGIT), ranges[:, None]), log(leaves.reshape(NODES, DIGIT), nodes[:, None]), tails.astype(np.float32), single)


class Network:
    """Embeddings (the last one for beyond the ends), hidden layer, and for each choice its output, as one flat array."""

    SHAPES = ((VOCABULARY + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (RANGES, HIDDEN), (HIDDEN, DIGIT), (NODES, HIDDEN), (HIDDEN, DIGIT))
    #: Places in SHAPES that are read by row: only the rows met are moved.
    SPARSE = (0, 5, 7)

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = np.array(flat, dtype=np.float32)
        self.parts, at = [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            self.parts.append(self.flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def start() -> Network:
        rng = np.random.default_rng(SEED)
        return Network(np.concatenate([(rng.standard_normal(int(np.prod(s))) * (0.1 if len(s) == 2 else 0.0)) for s in Network.SHAPES]))


@dataclass
class Forward:
    """A batch's activations: its rows below a class of endings and their classes and nodes, and each choice's hidden values and scores (up to a row's constant).

    The first hidden values end in a column of ones, for the biases of the classes.
    """

    below: np.ndarray
    ranges: np.ndarray
    nodes: np.ndarray
    inputs: np.ndarray
    hidden: list[np.ndarray]
    scores: list[np.ndarray]


@dataclass
class Choices:
    """The three choices of words: class, digit 1, digit 2 (the digits only where the class is one of endings)."""

    classes: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def of(buckets: np.ndarray, vocabulary: Vocabulary) -> Choices:
        single = vocabulary.single.take(buckets)
        return Choices(np.where(single >= 0, single, SINGLES + buckets // (BUCKETS // RANGES)), buckets // (DIGIT * TAILS) % DIGIT, buckets // TAILS % DIGIT)

    def take(self, at) -> Choices:
        return Choices(self.classes[at], self.first[at], self.second[at])


def forward(network: Network, vocabulary: Vocabulary, context: np.ndarray, chosen: Choices) -> Forward:
    embed, w1, b1, w2, b2, e2, u2, e3, u3 = network.parts
    # Rows by take(), many times faster than by [].
    x = embed.take(context, axis=0).reshape(len(context), -1)
    pre = x @ w1
    pre += b1
    below = np.flatnonzero(chosen.classes >= SINGLES)
    ranges = chosen.classes.take(below).astype(np.int64) - SINGLES
    nodes = ranges * DIGIT + chosen.first.take(below)
    part = pre.take(below, axis=0)
    whole = np.ones((len(context), HIDDEN + 1), dtype=np.float32)
    np.tanh(pre, out=whole[:, :HIDDEN])
    hidden = [whole]
    for rows in (e2.take(ranges, axis=0), e3.take(nodes, axis=0)):
        rows += part
        hidden.append(np.tanh(rows, out=rows))
    scores = [whole @ np.concatenate([w2, (b2 + vocabulary.classes)[None]]), hidden[1] @ u2, hidden[2] @ u3]
    scores[1] += vocabulary.first.take(ranges, axis=0)
    scores[2] += vocabulary.second.take(nodes, axis=0)
    for s, out, extra in zip(scores, (w2, u2, u3), (float(np.abs(b2).max()), 0.0, 0.0), strict=True):
        # Hidden values lie in [-1, 1] and log shares below 0, so scores seldom can be too large for exp.
        if np.abs(out).sum(axis=0).max() + extra > MOST_SCORE:
            s -= s.max(axis=1, keepdims=True)
    return Forward(below, ranges, nodes, x, hidden, scores)


_ONES = np.ones(max(CLASSES, DIGIT), dtype=np.float32)


def _sums(values: np.ndarray) -> np.ndarray:
    """Row sums, as a product: many times faster than a sum along short rows."""
    return values @ _ONES[: values.shape[1]]


def _places(values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Where each row's wanted value stands in the flat array."""
    return np.arange(0, values.size, values.shape[1]) + want


def log_likelihood(network: Network, vocabulary: Vocabulary, context: np.ndarray, chosen: Choices) -> np.ndarray:
    """The log-probability of each word's three choices."""
    made = forward(network, vocabulary, context, chosen)
    out = np.zeros(len(context))
    for k, (at, want) in enumerate(((slice(None), chosen.classes), (made.below, chosen.first.take(made.below)), (made.below, chosen.second.take(made.below)))):
        scores = made.scores[k]
        found = scores.reshape(-1).take(_places(scores, want))
        out[at] += found - np.log(_sums(np.exp(scores, out=scores)))
    return out


def _by_row(ids: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows met, and the sums of ``values`` by row; a count a column is many times faster than adding row by row."""
    met = np.zeros(size, dtype=bool)
    met[ids] = True
    rows = np.flatnonzero(met)
    place = np.empty(size, dtype=np.int64)
    place[rows] = np.arange(len(rows))
    at = place.take(ids)
    return rows, np.array([np.bincount(at, weights=column, minlength=len(rows)) for column in values.astype(np.float64).T], dtype=np.float32).T


def step(network: Network, vocabulary: Vocabulary, context: np.ndarray, chosen: Choices, squares: list[np.ndarray]) -> None:
    """One Adagrad step on the mean loss of a batch."""
    embed, w1, b1, w2, b2, e2, u2, e3, u3 = network.parts
    made = forward(network, vocabulary, context, chosen)
    below, n = made.below, np.float32(len(context))
    back, onto = [], []
    for scores, want, out, h in zip(made.scores, (chosen.classes, chosen.first.take(below), chosen.second.take(below)), (w2, u2, u3), made.hidden, strict=True):
        # A row's slopes are (exp - sum where wanted) / (n * sum); the division is left to the narrow sides of the products.
        np.exp(scores, out=scores)
        sums = _sums(scores)
        scores.reshape(-1)[_places(scores, want)] -= sums
        share = (1.0 / (n * sums))[:, None]
        onto.append((h * share).T @ scores)
        h = h[:, :HIDDEN]
        slope = scores @ out.T
        slope *= share
        slope *= 1.0 - h * h
        back.append(slope)
    whole = back[0]
    whole[below] += back[1] + back[2]
    into = (whole @ w1.T).reshape(-1, WIDTH)
    grads = {1: made.inputs.T @ whole, 2: whole.sum(0), 3: onto[0][:HIDDEN], 4: onto[0][HIDDEN], 6: onto[1], 8: onto[2]}
    for k, grad in grads.items():
        squares[k] += grad**2
        network.parts[k] -= RATE * grad / (np.sqrt(squares[k]) + 1e-6)
    met = ((0, context.reshape(-1), into), (5, made.ranges, back[1]), (7, made.nodes, back[2]))
    for k, ids, values in met:
        rows, grad = _by_row(ids, values, len(network.parts[k]))
        square = squares[k].take(rows, axis=0)
        square += grad**2
        squares[k][rows] = square
        np.sqrt(square, out=square)
        square += 1e-6
        grad *= RATE
        grad /= square
        network.parts[k][rows] = network.parts[k].take(rows, axis=0) - grad


def padded(buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words with ``SIDE`` ends before, between and after the rows, and each word's place in them."""
    at = np.arange(len(buckets)) + SIDE * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    out = np.full(len(buckets) + SIDE * len(bounds), VOCABULARY, dtype=np.int32)
    out[at] = (common.mix(buckets.astype(np.uint64)) % _U(VOCABULARY)).astype(np.int32)
    return out, at


def around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the words around those at some places."""
    return ids.take(at[:, None] + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)]))


class Learner:
    """One shard's network, trained on its documents as they come, in chunks of some ``CHUNK`` words."""

    def __init__(self, shard: int, start: np.ndarray, vocabulary: Vocabulary) -> None:
        self.shard, self.vocabulary, self.network = shard, vocabulary, Network(start)
        self.squares = [np.full(s, 1e-4, dtype=np.float32) for s in Network.SHAPES]
        self.rng = np.random.default_rng([SEED, shard])
        self.held: list[np.ndarray] = []
        self.words = self.waiting = 0

    def add(self, buckets: np.ndarray) -> None:
        if len(buckets):
            self.held.append(buckets)
            self.waiting += len(buckets)
        if self.waiting >= CHUNK:
            self.learn()

    def learn(self) -> None:
        if not self.held:
            return
        buckets = np.concatenate(self.held)
        ids, at = padded(buckets, np.concatenate([[0], np.cumsum([len(x) for x in self.held])]))
        self.words, self.waiting, self.held = self.words + len(buckets), 0, []
        # A long document's words come in several parts, each mixed within itself.
        for lo in range(0, len(buckets), 2 * CHUNK):
            order = lo + self.rng.permutation(min(2 * CHUNK, len(buckets) - lo))
            for cut in range(0, len(order), BATCH):
                some = order[cut : cut + BATCH]
                step(self.network, self.vocabulary, around(ids, at[some]), Choices.of(buckets[some], self.vocabulary), self.squares)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.learn()
        if self.words:
            yield _pieces(self.network.flat, self.shard, float(self.words))


_PIECES = "part long, piece int, weight double, numbers binary"


def _pieces(network: np.ndarray, part: int, weight: float) -> pa.RecordBatch:
    cut = [network[lo : lo + PIECE].astype(np.float32).tobytes() for lo in range(0, len(network), PIECE)]
    schema = pa.schema([("part", pa.int64()), ("piece", pa.int32()), ("weight", pa.float64()), ("numbers", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([weight] * len(cut)), pa.array(cut, pa.binary())], schema=schema)


def average(table: pa.Table) -> pa.Table:
    """The weighted mean of one piece over at most FAN_IN partial means, in the order of their parts."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    weights = table.column("weight").to_numpy()[order]
    numbers = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in table.column("numbers")])[order]
    mean = (numbers * weights[:, None]).sum(0) / max(weights.sum(), 1e-12)
    return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN]), "piece": table.column("piece")[:1], "weight": pa.array([float(weights.sum())]), "numbers": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network

    def score(self, run: common.Run) -> tuple[np.ndarray, np.ndarray]:
        """Words and log-likelihood of each row."""
        buckets, bounds = buckets_of(run)
        # The tails of single words are 0.
        values = self.vocabulary.tails.take(buckets).astype(np.float64)
        ids, at = padded(buckets, bounds)
        for lo in range(0, len(buckets), BLOCK):
            some = slice(lo, lo + BLOCK)
            values[some] += log_likelihood(self.network, self.vocabulary, around(ids, at[some]), Choices.of(buckets[some], self.vocabulary))
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Corpus counts and the network, from all of ``docs``."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = texts.select("text").mapInArrow(count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS + 1 rows.
    got = counts.toArrow()
    buckets, n = got.column("bucket").to_numpy().astype(np.int64), got.column("n").to_numpy()
    vocabulary = Vocabulary.of(buckets[buckets >= 0], n[buckets >= 0])
    network = Network.start()
    rows = int(n[buckets < 0].sum())
    shards = max(1, -(-rows // (ROUNDS * SHARD_ROWS)))
    place = F.xxhash64(F.col("doc_id").cast("string"), "text")
    dealt = texts.where(F.length("text") > 0).withColumn("place", place)
    for turn in range(ROUNDS if rows else 0):
        shipped = spark.sparkContext.broadcast((vocabulary, network.flat))

        def learn(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            known, start = shipped.value
            learner = None
            for batch in batches:
                shard = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi > lo and (learner is None or learner.shard != shard[lo]):
                        if learner is not None:
                            yield from learner.finish()
                        learner = Learner(int(shard[lo]), start, known)
                    for run in common.runs(batch.column(1).slice(lo, hi - lo), RUN_BYTES):
                        found, bounds = buckets_of(run)
                        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                            learner.add(found[a:b])
            if learner is not None:
                yield from learner.finish()

        mine = dealt.where(F.pmod("place", F.lit(ROUNDS)) == turn).withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
        mine = mine.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "doc_id", "text")
        sums = mine.select("shard", "text").mapInArrow(learn, _PIECES).checkpoint()
        parts = shards
        while parts > 1:
            group = F.floor(F.col("part") / F.lit(FAN_IN))
            sums = sums.groupBy("piece", group.alias("group")).applyInArrow(average, _PIECES)
            parts = -(-parts // FAN_IN)
        found = sorted(sums.collect(), key=lambda r: r["piece"])
        if found:
            network = Network(np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in found]))
    return Model(vocabulary, network)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean a token, of every whole text."""
    spark = docs.sparkSession
    common.prepare(spark)
    shipped = spark.sparkContext.broadcast((model.vocabulary, model.network.flat))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shipped.value
        known = Model(vocabulary, Network(flat))
        for batch in batches:
            for run in common.runs(batch.column(1), RUN_BYTES):
                n, total = known.score(run)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows), pa.array(n.astype(np.int64)), pa.array(total)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(over, "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
