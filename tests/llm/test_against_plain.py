"""Classifiers against plain loops over letters, words and rows; bounds of their samples; all languages learned."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import common, langid, quality_classifier, quality_rules, toxicity

TEXTS = ["The quick brown fox, THE dog!", "", "  ", "ß é où ñandú x1y2", "a", "one one two one one", "Hello   world\tyou idiot", "ABC abc 123 ###", "x" * 50]


def run_of(texts):
    return next(common.runs(pa.array(texts, pa.string())))


def letter(b):
    return b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0


def plain_presence(text):
    data = [letter(b) for b in text.encode()]
    places, first = set(), 0
    for n, size in enumerate(langid.PLACES, 1):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if gram[0] + gram[-1] == 0:
                continue
            value = 0
            for b in gram:
                value = (value * 257 + b + 1) % (1 << 64)
            places.add(first + (value * int(langid._MULT[n - 1]) % (1 << 64) >> (64 - (size.bit_length() - 1))))
        first += size
    return places


def test_presence_kernel_against_sets_of_grams():
    x = langid.presence(run_of(TEXTS))
    assert [set(np.flatnonzero(row)) for row in x] == [plain_presence(t) for t in TEXTS]
    model = langid.fit(TEXTS[:1] * 3 + TEXTS[3:4] * 3 + TEXTS[5:7], ["en"] * 3 + ["de"] * 3 + ["xx"] * 2)
    marks = [set(np.flatnonzero(column)) for column in model.landmarks.T]
    for text, row in zip(TEXTS, x, strict=True):
        mine = plain_presence(text)
        kernel = [len(mine & m) / np.sqrt(max(len(mine), 1)) / np.sqrt(max(len(m), 1)) for m in marks]
        values = np.array(kernel) @ model.weights
        best, score = model.predict(row[None, :])
        assert np.isclose(values.max(), values[best[0]], atol=1e-4) and np.isclose(score[0], 1 / np.exp(8 * (values - values.max())).sum(), atol=1e-3)


def test_a_long_text_is_read_in_pieces_by_every_classifier(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Wort", "word", "mot", "you", "idiot", "###", "abc1", "Idiot!"]) for _ in range(9000))
    run = run_of([text])
    lexicon = toxicity.Lexicon.of({"idiot": 3.0})
    whole = langid.presence(run), quality_classifier.Model(np.arange(quality_classifier.DIMENSION) % 7 / 10, 0.1).score(run), toxicity.features(run, lexicon)
    monkeypatch.setattr(common, "RUN_BYTES", 3000)
    cut = langid.presence(run), quality_classifier.Model(np.arange(quality_classifier.DIMENSION) % 7 / 10, 0.1).score(run), toxicity.features(run, lexicon)
    assert np.array_equal(whole[0], cut[0]) and np.allclose(whole[1], cut[1])
    near = toxicity.FEATURES.index("near_second_person")
    assert np.allclose(np.delete(whole[2], near), np.delete(cut[2], near)) and abs(whole[2][0, near] - cut[2][0, near]) < 0.02


def test_every_language_is_learned(spark):
    rng = random.Random(2)
    rows = []
    for k in range(130):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(30)), f"l{k:03}") for i in range(8 if k else 200)]
    rows += [(99, rows[0][1], "l000")] * 50
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 130 and model.landmarks.shape[1] >= 130 * langid.LEAST_LANDMARKS
    best, _ = model.predict(np.concatenate([langid.presence(r) for r in common.runs(pa.array([r[1] for r in rows]))]))
    assert np.mean([model.langs[b] == r[2] for b, r in zip(best, rows, strict=True)]) > 0.95


def plain_shape(word):
    kinds = [b if b < 128 and not chr(b).isalnum() else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 for b in word.encode()]
    return bytes(b for i, b in enumerate(kinds) if not i or b != kinds[i - 1] or b not in (65, 97, 48))


def hash_of(words):
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return common.hash_spans(data, ends - np.array([len(w) for w in words]), ends)


def test_quality_scores_against_a_plain_sum():
    rng = np.random.default_rng(3)
    model = quality_classifier.Model(rng.standard_normal(quality_classifier.DIMENSION), 0.3)
    got = model.score(run_of(TEXTS))
    for text, score in zip(TEXTS, got, strict=True):
        words = text.split()
        total = 0.3
        if words:
            h, shapes = hash_of([bytes(common.LOWER_BYTE[np.frombuffer(w.encode(), np.uint8)]) for w in words]), hash_of([plain_shape(w) for w in words])
            pairs = lambda x: [common.chain(x[i : i + 2], 2)[0] for i in range(len(x) - 1)]
            again = [(i > 0 and h[i] == h[i - 1]) + 2 * (i > 1 and h[i] == h[i - 2]) for i in range(len(h))]
            for salt, family in enumerate([list(h), pairs(h), list(shapes), pairs(shapes), again], 1):
                for value in family:
                    place = int(common.mix(np.array([value], dtype=np.uint64) ^ common.u64(salt * 0x9E3779B97F4A7C15))[0]) >> (64 - (quality_classifier.DIMENSION.bit_length() - 1))
                    total += quality_classifier.SCALE * model.weights[place] / len(family)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_ftrl_against_a_dictionary():
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        places = sorted(rng.sample(range(40), 6))
        rows.append((np.array(places, np.int32), np.array([rng.random() for _ in places], np.float32), int(rng.random() < 0.2 + 0.6 * (3 in places))))
    model = quality_classifier.fit(rows, 3)
    c = quality_classifier
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= c.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * c.L1) / ((c.BETA + np.sqrt(n[i])) / c.ALPHA + c.L2)

    for _ in range(3):
        for places, values, label in rows:
            w = [weight(i) for i in places]
            p = 1 / (1 + np.exp(-(sum(a * float(b) for a, b in zip(w, values, strict=True)) + bias)))
            for i, v, wi in zip(places, values, w, strict=True):
                g = (p - label) * float(v)
                sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / c.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * wi, n.get(i, 0.0) + g * g
            bias_n += (p - label) ** 2
            bias -= 0.1 * (p - label) / (1 + np.sqrt(bias_n))
    assert abs(model.bias - bias) < 1e-5 and all(abs(model.weights[i] - weight(i)) < 1e-4 for i in z)
    assert np.count_nonzero(model.weights) <= len(z)


def test_toxic_features_against_plain_counts():
    lexicon = toxicity.Lexicon.of({"idiot": 3.0, "moron": 2.0})
    texts = ["you are an idiot and a MORON, idiot!", "an 1d10t", "", "You!! nothing here", "far from you it is said that some idiot came"]
    x = toxicity.features(run_of(texts), lexicon)
    at = {name: k for k, name in enumerate(toxicity.FEATURES)}
    assert np.allclose(x[:, at["log_hits"]], np.log1p([3, 0, 0, 0, 1])) and x[:, at["distinct_words"]].tolist() == [2, 0, 0, 0, 1] and x[:, at["max_weight"]].tolist() == [3, 0, 0, 0, 3]
    assert np.allclose(x[:, at["density"]], [3 / 8, 0, 0, 0, 1 / 10]) and np.allclose(x[:, at["weight_density"]], [8 / 8, 0, 0, 0, 3 / 10])
    assert np.allclose(x[:, at["near_second_person"]], [1 / 3, 0, 0, 0, 0]) and np.allclose(x[:, at["second_person"]], [1 / 8, 0, 0, 1 / 3, 1 / 10])
    assert np.allclose(x[:, at["log_words"]], np.log1p([8, 2, 0, 3, 10])) and x[1, at["log_obfuscated"]] > 0 and np.allclose(x[:, at["capital_words"]], [1 / 8, 0, 0, 0, 0])
    assert np.allclose(x[:, at["exclamations"]], [1 / 36, 0, 0, 2 / 18, 0])


def test_trees_and_calibration():
    rng = np.random.default_rng(6)
    x = rng.random((600, 4))
    y = (x[:, 1] + 0.5 * (x[:, 2] > 0.5) > 0.8).astype(float)
    forest = toxicity.grow(x[:400], y[:400])
    raw = forest.raw(x[400:])
    assert ((raw > 0) == (y[400:] > 0)).mean() > 0.93
    # One tree by hand.
    feature, threshold, leaves = forest.splits[0]
    for row in x[:20]:
        node = 0
        for _ in range(toxicity.DEPTH):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        one = toxicity.Forest(0.0, [forest.splits[0]]).raw(row[None, :])[0]
        assert one == leaves[node - (2**toxicity.DEPTH - 1)]
    scores, truth = rng.random(200), rng.integers(0, 2, 200).astype(float)
    knots, levels = toxicity.isotonic(scores, truth)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    order = np.argsort(scores)
    ranked = truth[order]
    # Max-min formula of the isotonic regression.
    fit = [max(min(ranked[i : k + 1].mean() for k in range(j, 200)) for i in range(j + 1)) for j in range(0, 200, 23)]
    assert set(np.round(fit, 9)) <= set(np.round(levels, 9))


def test_samples_are_bounded_after_the_join(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} of many") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id long, quality int")
    assert common.labelled_sample(docs, labels, "doc_id", "text", "quality", 30).count() == 30
    assert common.labelled_sample(docs, labels, "doc_id", "text", "quality", 1000).count() == 400
    assert common.labelled_sample(docs.limit(0), labels, "doc_id", "text", "quality", 30).count() == 0


def test_estimates_against_plain_concentration_steps(spark):
    """Every group's estimate and verdicts against numpy's, from the same three starts."""
    rng = np.random.default_rng(9)
    rows = []
    for g, n in enumerate((300, 90, 12, 1)):
        x = rng.standard_normal((n, 4)) * [0.5, 0.02, 0.05, 0.03] + [6 + g, 0.1, 0.1, 0.05]
        x[: n // 12] += [0, 2, 0, 1]
        rows += [(g, *map(float, a), 0.04, 0.0004, 0.001, 0.001) for a in x]
    frame = spark.createDataFrame(rows, "group long, x0 double, x1 double, x2 double, x3 double, v0 double, v1 double, v2 double, v3 double").repartition(3)
    common.prepare(spark)
    got = {r["group"]: r for r in quality_rules.estimates_of(frame).collect()}
    data = np.array(rows)
    for g in range(4):
        x, floor = data[data[:, 0] == g][:, 1:5], np.array([0.04, 0.0004, 0.001, 0.001])
        n = len(x)
        lower = lambda v, p: np.sort(v, axis=0)[max(int(np.ceil(p * len(v))), 1) - 1]
        med = lower(x, 0.5)
        s = np.sqrt((1.4826 * lower(np.abs(x - med), 0.5)) ** 2 + floor)
        z = (x - med) / s
        signs = z / np.sqrt(np.maximum((z**2).sum(1, keepdims=True), 1e-18))
        best = None
        for c in (np.eye(4), np.cov(np.tanh(z).T, bias=True) if n > 1 else np.zeros((4, 4)), signs.T @ signs / n):
            of = np.sqrt(np.outer(np.diag(c), np.diag(c)))
            r = np.where(of > 1e-12, 0.9 * c / np.where(of > 1e-12, of, 1), 0.0)
            np.fill_diagonal(r, 1.0)
            m, cov, was = med, r * np.outer(s, s), None
            for step in range(20):
                d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
                near = x[d <= np.sort(d)[int(np.ceil(quality_rules.COVERED * n)) - 1]]
                m = near.mean(0)
                cov = np.cov(near.T, bias=True).reshape(4, 4) * quality_rules.CONSISTENCY + np.diag(floor)
                det = np.linalg.slogdet(cov)[1]
                if step >= quality_rules.TRIAL and abs(det - was) < quality_rules.STILL:
                    break
                was = det
            best = min(best or (np.inf,), (det, step, tuple(m), cov.tolist()), key=lambda t: t[0])
        r = got[g]
        assert r["n"] == n and np.allclose([r[f"m{i}"] for i in range(4)], best[2], atol=0.02)
        assert np.allclose([r[f"c{i}{i}"] for i in range(4)], np.diag(best[3]), rtol=0.1)
    cut = spark.range(1).select(quality_rules.cutoff(F.lit(1000))).first()[0]
    assert abs(np.exp(-cut / 2) * (1 + cut / 2) * 1000 / quality_rules.LEVEL - 1) < 1e-6
