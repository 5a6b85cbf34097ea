import math
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import LOWER, SCHEMA, blank_words, corpus, fold, frame
from pyspark.sql import functions as F

from weekrank.llm import maxent, shards


def test_base_against_brute_force_and_model_beats_it(spark):
    rows = corpus(6, n=80, vocabulary=60)
    tokens = [[*blank_words((r[1] or "").translate(LOWER)), None] for r in rows]
    held = [fold("" if r[0] is None else r[0], 10) == 0 for r in rows]
    counts = Counter(t for own, out in zip(tokens, held) if not out for t in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), out, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
                  for r, own, out in zip(rows, tokens, held))
    found = maxent.score(frame(spark, rows), ~maxent.held_out()).collect()
    got = sorted((str(r.doc_id), not r.learn, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_shares_sum_to_one():
    weights = np.random.default_rng(0).normal(0, 1, (maxent.SLOTS + 1, maxent.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(maxent.log_shares(weights, np.arange(30).reshape(3, 10))).sum(axis=1), 1, atol=1e-5)


def test_empty_and_nothing_to_learn(spark):
    assert maxent.score(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    got = maxent.score(frame(spark, [(1, "a b", None, None, None), (2, None, None, None, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]


def test_counts_reach_the_shards_both_ways(spark):
    docs = frame(spark, corpus(7, n=60, vocabulary=80))
    want = sorted((repr(r.doc_id), r.learn, r.n_known, r.base_score, r.score) for r in maxent.score(docs, ~maxent.held_out()).collect())
    for most in (0, 20):
        got = sorted((repr(r.doc_id), r.learn, r.n_known, r.base_score, r.score) for r in maxent.score(docs, ~maxent.held_out(), most_common=most).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-6)


def test_shards_keep_numbers_instead_of_rows_per_word():
    texts = ["B a b\ta", None, "c é A"]
    word, slot, sizes = maxent.numbered(pa.table({"text": pa.array(texts), "learn": [True, True, False]}))
    tokens = [*"baba", "", "", "c", "é", "a", ""]
    assert word.column("word").take(pa.array(slot)).to_pylist() == tokens and sizes.tolist() == [5, 1, 4]
    assert {r["word"]: r["n"] for r in word.to_pylist()} == {"a": 2, "b": 2, "": 2, "c": 0, "é": 0}


def test_gradients_against_every_context():
    rng = np.random.default_rng(1)
    words = pa.array([str(i) for i in range(50)] + [""])
    tokens = maxent.Tokens(words, rng.integers(0, 51, 400), np.array([1, 2, 97, 300]))
    for scale in (0, 1, 30):
        weights = rng.normal(0, scale, (maxent.SLOTS + 1, maxent.CLASSES)).astype(np.float32)
        features = tokens.features()
        z = weights[features].astype(float).sum(axis=0) + weights[maxent.SLOTS]
        error = -np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        error[np.arange(400), tokens.classes[tokens.slot]] += 1
        want = np.zeros((maxent.SLOTS, maxent.CLASSES))
        for kind in features:
            np.add.at(want, kind, error)
        assert np.allclose(maxent._gradients(tokens, weights)[0].T, want, atol=1e-4)


def layered(tokens, held, shared):
    """Log10 probability of every text: counts of all words after all contexts on `shared`, the share of a word without context."""
    after, contexts = Counter(), Counter()

    def places(own):
        for i, t in enumerate(own):
            one, two = own[i - 1] if i else "", own[i - 2] if i > 1 else ""
            yield t, [("skip", two), ("prior", one), ("pair", two, one)]

    for own, out in zip(tokens, held):
        for t, found in places(own) if not out else ():
            contexts.update(found)
            after.update((f, t) for f in found)
    scores = []
    for own in tokens:
        total = 0
        for t, found in places(own):
            p = shared[t]
            for f, firm in zip(found, (10000, 3000, 8)):
                p = (after[f, t] + firm * p) / (contexts[f] + firm)
            total += math.log10(p)
        scores.append(total)
    return scores


def test_score_counts_every_word_after_every_context(spark, monkeypatch):
    rows = corpus(9, n=60, vocabulary=50)
    rows = [r for r in rows if r[0] is not None]
    tokens = [[*blank_words((r[1] or "").translate(LOWER)), None] for r in rows]
    held = [fold(r[0], 10) == 0 for r in rows]
    counts = Counter(t for own, out in zip(tokens, held) if not out for t in own)
    kind = {t: int(maxent.classes_of(maxent.hashes_of(pa.array([t or ""])))[0]) for own in tokens for t in own}
    totals, kinds = Counter(), Counter()
    for t, n in counts.items():
        totals[kind[t]] += n
        kinds[kind[t]] += 1
    every = sum(totals.values()) + 0.1 * maxent.CLASSES
    # Without rounds all contexts have the classes' own shares.
    shared = {t: (totals[k] + 0.1) / every * (counts[t] + 0.1) / (totals[k] + 0.1 * (kinds[k] + 1)) for t, k in kind.items()}
    want = sorted((r[0], s) for r, s in zip(rows, layered(tokens, held, shared)))
    for counted in (1 << 21, 500):  # one bucket, and many
        monkeypatch.setattr(maxent, "COUNTED", counted, raising=False)
        got = sorted((r.doc_id, r.score) for r in maxent.score(frame(spark, rows), ~maxent.held_out(), rounds=0).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5)


def test_texts_that_come_twice_are_scored_apart(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.permutation(400)) for _ in range(150)]  # the same words in all
    rows = [(i, t, None, None, None) for i, t in enumerate(texts + texts[:20])]
    got = {r.doc_id: r for r in maxent.score(frame(spark, rows), F.lit(True)).collect()}
    twice = {*range(20), *range(150, 170)}
    # Well apart: by 0.1 a token.
    assert min(got[i].score for i in twice) > max(r.score for i, r in got.items() if i not in twice) + 0.1 * 401
    assert np.ptp([r.base_score for r in got.values()]) < 1e-6


def test_planes_of_any_width():
    for width in (1, 3, 4, 5, 8):
        for x in ([], [0], [(1 << 8 * width - 1) + 1, 3, 0]):
            packed = pa.array([shards.planes(np.array(x, np.uint64), width)], pa.binary())[0]
            assert shards.numbers(packed, width).tolist() == x
