import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, collected, corpus, frame, low_words

from weekrank.llm import block_search, common, queries

ITEMS = "item_id long, text string"


def brute(rows, items, k=20):
    docs = [(r[0], Counter(low_words(r[1]))) for r in rows if low_words(r[1])]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in docs:
            m = 100 - 25 + (25 * sum(counts.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * counts[t]) // (1000 * counts[t] + 12 * m))
                        for t in low_words(text) if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=repr)


def case(seed, n=120):
    rng = random.Random(seed)
    rows = corpus(seed, n=n, vocabulary=150)
    words = [w for r in rows if r[1] for w in low_words(r[1])]
    rows += [(5000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), None, None, None) for i in range(300)]
    rows += [(6000 + i, "Tie Tie breaks", None, None, None) for i in range(50)] + [(None, "tie tie breaks", None, None, None)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(25)]
    return rows, items + [(100, None), (101, ""), (102, "tie"), (103, "nowhere_at_all"), (104, " ".join(words[:300]).upper()), (105, "x X x y")]


@pytest.mark.parametrize("shard_bytes,query_terms", [(block_search.SHARD_BYTES, 1 << 20), (3000, 40)])
def test_against_brute_force(spark, shard_bytes, query_terms):
    rows, items = case(2)
    got = block_search.rank(frame(spark, rows), spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes, query_terms=query_terms)
    assert collected(got) == brute(rows, items)


def test_repeated_items_few_documents_and_empty_tables(spark):
    rows, items = case(3)
    docs = frame(spark, rows)
    twice = block_search.rank(docs, spark.createDataFrame([items[0], items[0]], ITEMS), k=3)
    assert collected(twice) == sorted(2 * brute(rows, [items[0]], 3), key=repr)
    none = spark.createDataFrame([], SCHEMA)
    assert block_search.rank(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert block_search.rank(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert block_search.rank(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)]), spark.createDataFrame(items, ITEMS)).count() == 0


def shard_of(texts, n=None):
    array = pa.array(texts, pa.string())
    pairs = list(block_search.term_pieces(array))
    owner, hashes = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    return block_search.Shard.build(pa.array(range(len(texts)), pa.int64()), owner, hashes, len(texts), len(owner)), owner, hashes


def test_blocks_are_rejected_before_they_are_unpacked():
    rng = np.random.default_rng(1)
    texts = [" ".join(["common"] * int(rng.integers(1, 3)) + (["rare"] if i % 500 == 0 else []) + [f"w{i}"]) for i in range(20000)]
    shard, _, _ = shard_of(texts)
    hashes = np.sort(np.array([x[1][0] for x in (next(block_search.term_pieces(pa.array([t]))) for t in ("common", "rare"))], np.uint64))
    df = [int(shard.begin[shard.firsts[i + 1]] - shard.begin[shard.firsts[i]]) for i in np.searchsorted(shard.terms, hashes)]
    weights = np.array([block_search.weight(20001, d) or 1 for d in df])
    seen = block_search.Counts()
    docs, scores = shard.search(hashes, weights, 5, 1, seen)
    exact, plain = shard.search(hashes, weights, 20000, 1)
    assert list(docs) == list(exact[:5]) and list(scores) == list(plain[:5])
    assert seen.skipped > seen.unpacked


def test_a_shard_survives_packing_and_long_texts_are_cut_between_words():
    rng = random.Random(3)
    texts = [" ".join(f"Wörd{int(rng.paretovariate(0.5)) % 5000}" for _ in range(rng.choice([0, 3, 400]))) for _ in range(300)]
    texts += ["many " * 70000 + "end", "x" * 50000]
    shard, owner, hashes = shard_of(texts)
    row = shard.row(7).to_pylist()[0]
    back = block_search.Shard.read({k: pa.py_buffer(v) if isinstance(v, bytes) else v for k, v in row.items()}, len(texts), len(owner))
    want = Counter(zip(hashes.tolist(), owner.tolist()))
    got = {}
    for i, term in enumerate(back.terms):
        docs, tf = back.unpack(np.arange(back.firsts[i], back.firsts[i + 1]))
        got.update({(int(term), int(d)): int(t) for d, t in zip(docs, tf)})
    assert got == want and max(want.values()) == 70000
    cut = list(block_search.term_pieces(pa.array(texts), most=1000))
    assert len(cut) > 50 and np.array_equal(np.concatenate([c[1] for c in cut]), hashes) and np.array_equal(np.concatenate([c[0] for c in cut]), owner)


def test_the_query(spark, tmp_path):
    rows, items = case(4, n=60)
    rows = [r for r in rows if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_lexical_search(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and common.SETTINGS
    assert collected(got) == brute(rows, items)
