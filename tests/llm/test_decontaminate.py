from helpers import collected, corpus, frame, low_words

from weekrank.llm import decontaminate


def items_of(rows):
    base = low_words(next(r[1] for r in rows if r[1] and len(r[1]) > 400))
    return [("a", " ".join(base[3:30])), ("b", "X"), ("c", None), ("d", ""), ("e", " ".join(base[20:24])), (None, "x x"),
            ("f", " ".join(base[5:15])), ("a", " ".join(base[3:30])), ("g", "no such words here"), ("h", "x, y! Z x")]


def brute(rows, items):
    windows = {}
    for name, text in items:
        own = low_words(text)
        size = min(10, len(own))
        if name is not None and size:
            for i in range(len(own) - size + 1):
                windows.setdefault(tuple(own[i:i + size]), set()).add(name)
    out = []
    for row in rows:
        own, hit, found = low_words(row[1]), set(), set()
        for size in range(1, 11):
            for i in range(len(own) - size + 1):
                names = windows.get(tuple(own[i:i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((row[0], len(own), tuple(map(tuple, spans)), tuple(sorted(found))))
    return sorted(out, key=repr)


def got(spark, rows, items, **options):
    df = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string"), **options)
    return sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    items = items_of(rows)
    assert got(spark, rows, items) == brute(rows, items)


def test_several_blocks_agree(spark):
    rows = corpus(1, 30)
    items = items_of(rows)
    assert got(spark, rows, items, block_bytes=120) == brute(rows, items)


def test_empty_tables(spark):
    rows = corpus(2, 20)
    assert got(spark, [], items_of(rows)) == []
    assert got(spark, rows, []) == brute(rows, [])


def test_removal_keeps_everything_else(spark):
    rows = [(1, "Keep this. One two three four five six seven eight nine ten! And that", "en", "s", 1), (2, None, None, None, None),
            (3, "clean", "en", "s", 5)]
    items = [("i", "one two three four five six seven eight nine ten")]
    df = decontaminate.remove(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string"))
    assert collected(df.select("doc_id", "text")) == [(1, "Keep this. ! And that"), (2, None), (3, "clean")]
    assert "text_key" in df.columns


def test_removal_in_several_blocks_judges_the_texts_as_they_came(spark):
    words = [f"w{i}" for i in range(40)]
    items = [("c", " ".join(words[5:20])), ("d", " ".join(words[12:28])), ("e", "none of these"), ("f", " ".join(words[25:30]))]
    rows = [(1, " ".join(words), "en", "s", 1), (2, None, None, None, None), (3, "", None, None, None), (4, "clean text", None, None, None), *corpus(7, 30)]
    tests = spark.createDataFrame(items + items_of(rows), "item_id string, text string")
    docs = frame(spark, rows).selectExpr("*", "'mine' AS runs")
    one = collected(decontaminate.remove(docs, tests).select("doc_id", "text", "runs"))
    many = collected(decontaminate.remove(docs, tests, block_bytes=100).select("doc_id", "text", "runs"))
    assert one == many and ("mine" in one[0])
    assert (1, " ".join(words[:5]) + "  " + " ".join(words[30:]), "mine") in many
