import random

from helpers import blank_words, collected, corpus, frame, SCHEMA

from weekrank.llm import phrase_dedup, repeats, suffix_dedup

LAST = 2 ** 63 - 1


def brute_bytes(rows, size):
    first, texts = {}, []
    for row in rows:
        data, doc = (row[1] or "").encode(), LAST if row[0] is None else row[0]
        texts.append((row[0], doc, data))
        for i in range(len(data) - size + 1):
            key = data[i:i + size]
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for name, doc, data in texts:
        gone = set()
        for i in range(len(data) - size + 1):
            if first[data[i:i + size]] < (doc, i):
                gone.update(range(i, i + size))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((name, len(data), len(gone), spans, bytes(b for i, b in enumerate(data) if i not in gone)))
    return sorted(out, key=repr)


def brute_words(rows, size):
    first, out = {}, []
    for row in rows:
        own, doc = blank_words(row[1]), LAST if row[0] is None else row[0]
        for i in range(len(own) - size + 1):
            key = tuple(own[i:i + size])
            first[key] = min(first.get(key, doc), doc)
    for row in rows:
        own, doc, gone = blank_words(row[1]), LAST if row[0] is None else row[0], set()
        for i in range(len(own) - size + 1):
            if first[tuple(own[i:i + size])] < doc:
                gone.update(range(i, i + size))
        out.append((row[0], len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=repr)


def test_bytes_against_brute_force(spark):
    rows = corpus(1)
    got = collected(suffix_dedup.dedup(frame(spark, rows)))
    assert [(a, b, c, d, bytes(e)) for a, b, c, d, e in got] == brute_bytes(rows, 100)


def test_words_against_brute_force(spark):
    rows = corpus(2)
    assert collected(phrase_dedup.dedup(frame(spark, rows))) == brute_words(rows, 50)


def test_empty_tables_and_whole_characters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup(empty).count() == phrase_dedup.dedup(empty).count() == suffix_dedup.remove(empty).count() == 0
    base = "é" * 3 + "".join(random.Random(5).choices("abcdefghijklmnop", k=150))
    left = suffix_dedup.remove(frame(spark, [(1, "ê" + base, None, None, None), (2, "è" + base + "!", None, None, None), (3, None, None, None, None)]))
    assert [(r.doc_id, r.text) for r in left.orderBy("doc_id").collect()] == [(1, "ê" + base), (2, "è!"), (3, None)]


def test_hot_grams_are_not_gathered(spark, monkeypatch):
    # A line shorter than a window in every text, with other surroundings, and some longer passages around it.
    rng = random.Random(8)

    def prose(k):
        return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(k))

    line, around = prose(16), (prose(40), prose(40))
    texts = [f"{prose(30)} {around[0] if i % 7 == 0 else prose(40)} {line} {around[1] if i % 5 == 0 else prose(40)} {prose(9)}" for i in range(60)]
    rows = [(i * 2, t, None, None, None) for i, t in enumerate(texts)] + corpus(3, n=30)
    rng.shuffle(rows)
    monkeypatch.setattr(repeats, "HOT_STRETCHES", 3)
    for module in (suffix_dedup, phrase_dedup):
        resolve = module.resolve

        def small(contents, docs, starts, grams, *rest, resolve=resolve):
            assert max(grams.tolist().count(g) for g in set(grams.tolist())) <= 3
            return resolve(contents, docs, starts, grams, *rest)
        monkeypatch.setattr(module, "resolve", small)
    got = collected(suffix_dedup.dedup(frame(spark, rows)))
    assert [(a, b, c, d, bytes(e)) for a, b, c, d, e in got] == brute_bytes(rows, 100)
    assert collected(phrase_dedup.dedup(frame(spark, rows))) == brute_words(rows, 50)


def test_equal_windows_have_their_minimiser_at_one_place_in_shards_of_any_size(monkeypatch):
    import numpy as np

    from weekrank.llm import words

    rng = np.random.default_rng(2)
    passage = rng.integers(0, 3, 400)

    def places(values, at, start):
        positions, hashes = words.grams(values, at, 8)
        starts, chosen = words.anchors(hashes, positions, at, 8, 50)
        by = dict(zip(starts.tolist(), (positions[chosen] - starts).tolist()))
        return [by[start + i] for i in range(351)]

    small = places(passage, np.array([0, 400]), 0)
    before, after = rng.integers(0, 3, 30_000), rng.integers(0, 3, 5_000)
    large = np.concatenate([before, passage, after])
    for chunk in (words.CHUNK, 1000, 30_100):
        monkeypatch.setattr(words, "CHUNK", chunk)
        assert places(large, np.array([0, 17, len(large)]), len(before)) == small


def test_common_prefixes_against_the_bytes():
    import numpy as np

    from weekrank.llm import suffixes

    rng = np.random.default_rng(6)
    data = np.concatenate([np.tile(rng.integers(0, 256, 70), 4), rng.integers(0, 2, 500), np.zeros(30, np.int64), np.full(30, 255)]).astype(np.uint8)
    raw = data.tobytes()
    order, place = suffixes.suffix_array(suffixes.packed(data), suffixes.WORD)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    got = suffixes.common_prefixes(data, order, place, 100)
    for i in range(1, len(raw)):
        a, b = raw[order[i - 1]:][:100], raw[order[i]:][:100]
        assert got[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_bytes_are_read_only_of_stretches_that_meet_others(spark, monkeypatch):
    from weekrank.llm import common

    rng, tables = random.Random(9), []

    def stored(df, *partition, plain=common.stored):
        out = plain(df, *partition)
        if "content" in out.df.columns:
            tables.append(out.df.filter("content IS NOT NULL").count())
        return out
    monkeypatch.setattr(common, "stored", stored)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    copies = [(i, text, None, None, None) for i in range(6)]
    for module in (suffix_dedup, phrase_dedup):
        tables.clear()
        got = collected(module.dedup(frame(spark, copies)))
        assert tables and sum(tables) == 0  # equal stretches only
        assert [r[2] > 0 for r in got] == [False] + [True] * 5
        # A sign in the middle is another: the stretches around it are compared by their bytes.
        tables.clear()
        rows = [*copies, (7, text[:1500] + "X" + text[1501:], None, None, None)]
        got = collected(module.dedup(frame(spark, rows)))
        assert sum(tables) > 0
        if module is suffix_dedup:
            assert [(a, b, c, d, bytes(e)) for a, b, c, d, e in got] == brute_bytes(rows, 100)
        else:
            assert got == brute_words(rows, 50)
