import numpy as np
from helpers import collected, corpus, fold, frame

from weekrank.llm import quality as Q


def split(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def network(seed=1):
    rng = np.random.default_rng(seed)
    return Q.Network(rng.normal(0, 1, (Q.WIDTH, Q.CLASSES, Q.FILTERS)).astype(np.float32), rng.normal(0, 1, Q.FILTERS).astype(np.float32),
                     rng.normal(0, 1, 2 * Q.FILTERS), 0.1, np.ones(2 * Q.FILTERS))


def plain_features(net, text):
    """Chunk by chunk and filter by filter."""
    codes = [int(Q.CLASS_OF[b]) for b in text]
    block = Q.CHUNK // 8
    padded = codes + [0] * (-(-(len(codes) + Q.WIDTH - 1) // block) * block - len(codes)) + [0] * Q.WIDTH
    pooled = []
    for k in range(max(1, int(np.ceil((len(codes) - Q.CHUNK) / Q.STRIDE)) + 1)):
        end = min(k * Q.STRIDE + Q.CHUNK, len(padded) - Q.WIDTH - (Q.WIDTH - 1))
        z = [sum(net.filters[i][padded[p + i]] for i in range(Q.WIDTH)) for p in range(k * Q.STRIDE, end)]
        pooled.append(np.maximum(np.max(z, axis=0) + net.bias, 0))
    return np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])


def test_features_cover_the_whole_text():
    net, rng = network(), np.random.default_rng(0)
    texts = ["".join(chr(c) for c in rng.integers(32, 300, n)) for n in (0, 1, 5, 63, 64, 65, 500, 512, 513, 900, 1281, 3000)]
    got = net.features(*split(texts))
    for row, text in zip(got, texts):
        assert np.allclose(row, plain_features(net, text.encode()), atol=1e-4)


def test_held_out_accuracy_and_no_leak(spark):
    rows = [r for r in corpus(4, 60) if r[0] is not None]
    good = [(i, f"the words of text {i} go on and on " * 8, "en", "s", 1) for i in range(200, 320)]
    bad = [(i, f"BUY!! NOW!! {i}!! " * 9, "en", "s", 1) for i in range(320, 440)]
    docs = frame(spark, rows + good + bad)
    labels = spark.createDataFrame([(i, int(i < 320), "x") for i in range(200, 440)] + [(None, 1, "x"), (5, None, "x"), (6, 7, "x")],
                                   "doc_id long, quality int, score string")
    net = Q.train(docs, labels)
    out = {r.doc_id: r.score for r in Q.score(docs, net).collect()}
    assert all((out[i] >= Q.THRESHOLD) == (i < 320) for i in range(200, 440) if fold(i, 5) == 0)
    assert all(0 <= p <= 1 for p in out.values()) and 36 in out and 33 in out
    # Labels of the held-out fold are never read.
    lied = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in Q.score(docs, Q.train(docs, lied)).collect()}
    assert again == out


def test_edge_cases(spark):
    rows = corpus(5, 20)
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = Q.train(docs, none)
    assert {r.score for r in Q.score(docs, net).collect()} == {0.5}
    assert Q.score(docs.limit(0), net).collect() == []
    scored = Q.score(docs, network())
    assert scored.count() == len(rows) and scored.columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert collected(scored.select("doc_id", "text"))[:3] == collected(docs.select("doc_id", "text"))[:3]


def test_the_driver_holds_little_for_a_fit_and_gives_it_back(spark, monkeypatch):
    import tracemalloc

    texts = [bytes(row) for row in np.random.default_rng(3).integers(32, 127, (2000, 4000)).astype(np.uint8)]
    tracemalloc.start()
    Q.fit(texts, np.arange(2000) % 2, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * 8_000_000  # one byte for a sign; with eight the signs alone were 64 MB
    calls = []
    monkeypatch.setattr(Q.common, "release", lambda: calls.append(1))
    rows = [r for r in corpus(4, 60) if r[0] is not None]
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)], "doc_id long, quality int")
    Q.train(frame(spark, rows), labels)
    assert calls == [1]
