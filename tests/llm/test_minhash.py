from collections import defaultdict

import numpy as np
from helpers import SCHEMA, corpus, frame, low_words

from weekrank.llm import minhash, words


def shingles(text):
    own = low_words(text)
    return frozenset(tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i][0])
    return sorted(((r[0], min((x for x in members[top(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr), len(members)


def test_groups_against_brute_force(spark):
    rows = corpus(4, n=80)
    want, count = brute(rows)
    got = minhash.groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == want
    kept = minhash.keep_one(frame(spark, rows))
    assert kept.count() == count and set(kept.columns) >= {"label", "score", "n_chars"}


def test_weighted_agreement():
    rng = np.random.default_rng(0)
    elements = words.mix(np.arange(1, 61, dtype=np.uint64))
    x, y = rng.uniform(0.1, 3, 60), rng.uniform(0.1, 3, 60)
    sign = minhash.signatures(np.concatenate([elements, elements]), np.concatenate([x, y]), np.array([0, 60, 120]), 2000)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.groups(empty).count() == minhash.keep_one(empty).count() == 0


def test_a_bucket_of_similar_texts_keeps_its_pairs(spark):
    # Thousands of texts at 0.75 with one template, and pairs of them at 0.8 and more that hardly meet the ends.
    rng = np.random.default_rng(6)
    template = " ".join(f"t{i}" for i in range(174))

    def own(k):
        return " ".join(f"w{i}" for i in rng.integers(0, 10 ** 9, k))

    texts = [template + " " + own(28) for _ in range(3000)]
    for i in range(0, 240, 2):
        head, tail = texts[i].rsplit(" ", 22)[0], own(22)
        texts[i + 1] = head + " " + tail
    got = {r.doc_id: r.class_id for r in minhash.groups(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    sets = [shingles(t) for t in texts[:242]]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.81 and 0.7 < len(sets[240] & sets[241]) / len(sets[240] | sets[241]) < 0.78
    assert got == {i: i - 1 if i < 240 and i % 2 else i for i in range(3000)}


def test_pairs_that_are_too_different_are_not_verified(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2**62, 2**62, 300)
    sets = []
    for i in range(60):  # most pairs of copies share all but their own changes, and stay below the threshold
        changed = rng.permutation(300)[:rng.choice([5, 15, 25, 32])]
        grams = base.copy()
        grams[changed] = rng.integers(-2**62, 2**62, len(changed))
        sets.append((i, i % 50, np.unique(grams).tolist()))
    sets += [(100, 100, base[:3].tolist()), (101, 101, base[:3].tolist()), (102, 102, base[:240].tolist()), (103, 103, base.tolist() + list(range(5000)))]
    frame = spark.createDataFrame(sets, "name long, root long, grams array<long>")
    got = {(r.a, r.b) for r in minhash._rest(frame, 0.8).collect()}
    shares = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, r, x in sets for b, s, y in sets if a < b and r != s}
    assert {p for p, share in shares.items() if share >= 0.8} <= got
    assert not any(shares[p] < 0.7 for p in got)


def test_bits_of_a_set(spark):
    rng = np.random.default_rng(6)
    sets = [(1, []), (2, [7]), (3, rng.integers(-2**62, 2**62, 5000).tolist())]
    for r in minhash._with_bits(spark.createDataFrame(sets, "name long, grams array<long>")).collect():
        n = sum(bin(r[f"b{i}"] & (1 << 64) - 1).count("1") for i in range(minhash.BITS // 64))
        assert n + r.spare == len(sets[r.name - 1][1]) and n <= minhash.BITS
