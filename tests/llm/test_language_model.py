"""The language model against plain sums over words and contexts, and under other partitionings."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quern.llm import common, lm

EN = "the quick brown fox jumps over the lazy dog and then it runs back home to sleep".split()
SCHEMA = "doc_id long, text string"


def corpus(n=300):
    rng = random.Random(11)
    return [(i, " ".join(rng.choice(EN) for _ in range(rng.randint(0, 90)))) for i in range(n)] + [(n, None), (None, "a word without an id"), (None, "another one")]


def softmax(x):
    x = np.exp(x - x.max())
    return x / x.sum()


def plain_log_likelihood(model, words):
    """Word by word, with a full distribution at each choice, from the parameters as they stand."""
    embed, w1, b1, w2, b2, e2, u2, e3, u3 = (p.astype(np.float64) for p in model.network.parts)
    v, total = model.vocabulary, 0.0
    buckets = [int(lm.buckets_of(next(common.runs(pa.array([w]))))[0][0]) for w in words]
    ids = [int(common.mix(np.array([b], dtype=np.uint64))[0] % np.uint64(lm.VOCABULARY)) for b in buckets]
    for i, bucket in enumerate(buckets):
        near = [ids[k] if 0 <= k < len(ids) else lm.VOCABULARY for k in (i - 2, i - 1, i + 1, i + 2)]
        pre = np.concatenate([embed[k] for k in near]) @ w1 + b1
        classes = softmax(np.tanh(pre) @ w2 + b2 + v.classes)
        single = int(v.single[bucket])
        if single >= 0:
            total += np.log(classes[single])
            continue
        leaf = bucket // lm.TAILS
        node = leaf // lm.DIGIT
        group = node // lm.DIGIT
        first = softmax(np.tanh(pre + e2[group]) @ u2 + v.first[group])
        second = softmax(np.tanh(pre + e3[node]) @ u3 + v.second[node])
        total += np.log(classes[lm.SINGLES + group]) + np.log(first[node % lm.DIGIT]) + np.log(second[leaf % lm.DIGIT]) + v.tails[bucket]
    return total


def test_scores_against_a_plain_sum_over_words(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = lm.train(frame)
    texts = {i: t for i, t in rows if i is not None}
    for r in lm.score(frame, model).collect():
        if r["doc_id"] is not None:
            words = (texts[r["doc_id"]] or "").split()
            assert r["n_tokens"] == len(words) and abs(r["log_likelihood"] - plain_log_likelihood(model, words)) < 1e-3


def test_the_words_of_a_context_share_one():
    """Over all words that the buckets can hold, the probabilities in one context sum to 1, after training too."""
    run = next(common.runs(pa.array([" ".join(f"w{i % 90}" for i in range(4000))])))
    buckets, _ = lm.buckets_of(run)
    some, n = np.unique(buckets, return_counts=True)
    vocabulary = lm.Vocabulary.of(some, n)
    learner = lm.Learner(0, lm.Network.start().flat, vocabulary)
    learner.add(buckets)
    learner.learn()
    context, total = np.array([[3, 77, lm.VOCABULARY, 12]]), 0.0
    for lo in range(0, lm.BUCKETS, 1 << 16):
        every = np.arange(lo, lo + (1 << 16), dtype=np.int32)
        found = lm.log_likelihood(learner.network, vocabulary, np.repeat(context, len(every), axis=0), lm.Choices.of(every, vocabulary))
        total += np.exp(found + np.where(vocabulary.single[every] >= 0, 0.0, vocabulary.tails[every])).sum()
    # The single words' own buckets; their mass below a class of endings is gone.
    assert abs(total - 1) < 1e-3


def test_a_step_follows_the_slope():
    """The loss falls along the numeric gradient's direction, for some parameters of each part."""
    rng = np.random.default_rng(2)
    buckets = rng.integers(0, lm.BUCKETS, 400).astype(np.int32)
    some, n = np.unique(buckets[:200], return_counts=True)
    vocabulary = lm.Vocabulary.of(some, n)
    context = rng.integers(0, 50, (400, 2 * lm.SIDE))
    chosen = lm.Choices.of(buckets, vocabulary)
    base = lm.Network.start()
    moved = lm.Network(base.flat)
    lm.step(moved, vocabulary, context, chosen, [np.full(s, 1.0, dtype=np.float32) for s in lm.Network.SHAPES])
    loss = lambda flat: -lm.log_likelihood(lm.Network(flat), vocabulary, context, chosen).mean()
    at = 0
    for k, shape in enumerate(lm.Network.SHAPES):
        size = int(np.prod(shape))
        change = (base.parts[k] - moved.parts[k]).reshape(-1) / lm.RATE
        for i in np.argsort(-np.abs(change))[:2]:
            up, down = base.flat.copy(), base.flat.copy()
            up[at + i] += 0.02
            down[at + i] -= 0.02
            numeric = (loss(up) - loss(down)) / 0.04
            assert abs(numeric - change[i]) < 0.05 * abs(numeric) + 1e-3, (k, numeric, change[i])
        at += size


def test_a_step_moves_every_part_as_plain_slopes_do():
    """One step in double precision, with each softmax's slopes written out and summed row by row."""
    rng = np.random.default_rng(3)
    buckets = rng.integers(0, lm.BUCKETS, 300).astype(np.int32)
    buckets[:100] = buckets[0]
    vocabulary = lm.Vocabulary.of(*np.unique(buckets[:250], return_counts=True))
    context, chosen = rng.integers(0, 40, (300, 2 * lm.SIDE)), lm.Choices.of(buckets, vocabulary)
    moved = lm.Network(lm.Network.start().flat)
    lm.step(moved, vocabulary, context, chosen, [np.full(s, 1e-4, dtype=np.float32) for s in lm.Network.SHAPES])
    old = [p.astype(np.float64) for p in lm.Network.start().parts]
    embed, w1, b1, w2, b2, e2, u2, e3, u3 = old
    grads = [np.zeros_like(p) for p in old]
    for near, kind, first, second in zip(context, chosen.classes, chosen.first, chosen.second, strict=True):
        x, into = embed[near].reshape(-1), np.zeros(lm.HIDDEN)
        pre, group = x @ w1 + b1, int(kind) - lm.SINGLES
        node = group * lm.DIGIT + int(first)
        levels = [(None, None, w2, 3, b2 + vocabulary.classes, kind)]
        if group >= 0:
            levels += [(5, group, u2, 6, vocabulary.first[group], first), (7, node, u3, 8, vocabulary.second[node], second)]
        for part, row, out, k, share, want in levels:
            h = np.tanh(pre + (old[part][row] if part else 0.0))
            slope = softmax(h @ out + share)
            slope[want] -= 1.0
            slope /= len(context)
            grads[k] += np.outer(h, slope)
            back = (out @ slope) * (1 - h * h)
            into += back
            if part:
                grads[part][row] += back
            else:
                grads[4] += slope
        grads[1] += np.outer(x, into)
        grads[2] += into
        np.add.at(grads[0], near, (w1 @ into).reshape(len(near), -1))
    for new, before, grad in zip(moved.parts, old, grads, strict=True):
        want = before - lm.RATE * grad / (np.sqrt(1e-4 + grad**2) + 1e-6)
        assert np.abs(new - want).max() < 1e-5


def test_hashing_holds_what_a_core_keeps_near():
    """Beyond the counts, a batch of 2 MB is hashed in little memory: what is computed a byte, some 30 bytes, used to leave the cache."""
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"word{(i + k) % 97}" for k in range(300)) for i in range(1000)])], ["text"])
    list(lm.count_buckets(iter([batch])))
    tracemalloc.start()
    try:
        found = list(lm.count_buckets(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 2_000_000 and sum(sum(b.column(1).to_pylist()) for b in found) == 1000 + 300_000
    # The counts, and those of a run that are added to them.
    assert most < 2 * 8 * lm.BUCKETS + 40 * lm.RUN_BYTES


def test_bytes_looked_up_at_once():
    data = np.random.default_rng(4).integers(0, 256, 5000).astype(np.uint8)
    for table in (common.LOWER_BYTE, common.WORD_BYTE):
        for some in (data, data[1::2], data[:0]):
            got = common.each_byte(table, some)
            assert got.dtype == table.dtype and np.array_equal(got, table[some])


def test_partitions_do_not_move_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_ROWS", 40)
    rows = corpus()
    found = []
    for parts in (1, 5, 17):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        found.append({r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(frame, lm.train(frame)).collect() if r["doc_id"] is not None and r["n_tokens"]})
    for other in found[1:]:
        assert max(abs(found[0][k] - other[k]) for k in found[0]) < 1e-6


def test_a_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
    run = next(common.runs(pa.array([text])))
    whole = lm.buckets_of(run)
    monkeypatch.setattr(common, "RUN_BYTES", 5000)
    cut = lm.buckets_of(run)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True)) and sum(1 for _ in common.pieces(run)) > 50


def test_a_far_repeat_of_two_letters_is_no_collision():
    """A Thue-Morse word and its complement, which collide under every polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    h, _ = common.word_hashes(next(common.runs(pa.array(["".join("ab"[b] for b in bits) + " " + "".join("ba"[b] for b in bits)]))))
    assert h[0] != h[1]
