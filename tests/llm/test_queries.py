"""Every registered query, as it is registered, against a plain version of what it has to return."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, SCHEMA, blank_words, collected, corpus, fold, low_words, sha
from test_decontaminate import brute as plain_contamination
from test_decontaminate import items_of
from test_repeats import brute_bytes, brute_words
from tokenizers import Tokenizer

from weekrank.llm import queries


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """Tables with copies, ties, nulls, very long texts and columns whose names clash."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in corpus(11, n=70) if r[0] is not None]
    rows = list(dict.fromkeys(rows)) + [(900, "All Rights Reserved, cc BY; cc by-nc 4.0 General Public License", "en", "s", 1), (901, "<|endoftext|> É x", None, None, None),
                                        (902, "long " * 30_000, "en", "s", 1), (903, "%", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS h", "'clash' AS score", "'clash' AS text_key").repartition(4).write.parquet(f"{path}/documents.parquet")
    items = items_of(rows)
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(len(r[1] or "") > 300), 0) for r in rows if r[0] % 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def rows_of(df, *columns):
    return collected(df.select(*columns))


def test_op3(spark, case):
    path, rows, _ = case
    tokenizer, want = Tokenizer.from_file(queries.WORD_BPE), []
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert rows_of(queries.op3_bpe_encode_decode(spark, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op4_and_op6(spark, case):
    path, rows, _ = case
    words = [(a, b, c, sha(kept)) for a, b, c, kept in brute_words(rows, 50)]
    assert rows_of(queries.op4_substring_dedup(spark, path), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(words, key=repr)
    strings = [(a, b, c, d, sha(kept)) for a, b, c, d, kept in brute_bytes([r for r in rows if r[0] != 902], 100)]
    got = [r for r in rows_of(queries.op6_suffix_array_dedup(spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") if r[0] != 902]
    assert got == sorted(strings, key=repr)


def test_op5(spark, case):
    path, rows, _ = case
    sets = {}
    for row in rows:
        own = low_words(row[1])
        sets[row[0]] = {tuple(own[i:i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert rows_of(queries.op5_minhash_near_dedup(spark, path), "doc_id", "class_id") == sorted([(i, top(i)) for i in sets], key=repr)


def test_op7(spark, case):
    path, rows, _ = case
    got = queries.op7_quality_classifier(spark, path).collect()
    assert {r.doc_id: r.held_out for r in got} == {r[0]: fold(r[0], 5) == 0 for r in rows} and len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # Copies have one score: nothing but the text goes in.
    by = {}
    for r in got:
        by.setdefault(next(x[1] for x in rows if x[0] == r.doc_id) or "", set()).add(round(r.score, 6))
    assert all(len(v) == 1 for v in by.values())


def test_op8(spark, case):
    path, rows, _ = case
    phrases, want = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}, []
    for row in rows:
        own, starts, labels = low_words(row[1]), [], set()
        for phrase, label in phrases.items():
            parts = phrase.split()
            found = [i for i in range(len(own)) if own[i:i + len(parts)] == parts]
            starts += found
            labels |= {label} if found else set()
        want.append((row[0], len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    got = queries.op8_license_scans(spark, path)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    for r in got.collect():
        names = r.labels.split(",") if r.labels else []
        assert names == sorted(set(names)) and set(r.base_labels.split(",") if r.base_labels else []) <= set(names) and 0 <= r.score <= 1


def test_op9(spark, case):
    path, rows, items = case
    want = [(doc, n, sum(b - a for a, b in spans), len(names), sha(",".join(names)), bool(spans)) for doc, n, spans, names in plain_contamination(rows, items)]
    got = queries.op9_benchmark_decontamination(spark, path)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def test_op10(spark, case):
    path, rows, _ = case
    tokens = {r[0]: [*blank_words((r[1] or "").translate(LOWER)), None] for r in rows}
    counts = Counter(t for i, own in tokens.items() if fold(i, 10) for t in own)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, path).collect()}
    assert set(got) == set(tokens)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(own), sum(counts[t] > 0 for t in own), n)
        assert np.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rtol=1e-9) and r.score < 0


def test_op2(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 16))
    x[200:400] = x[20]  # a third of the rows are one vector
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'clash' AS score").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op2_nearest_neighbours(spark, str(tmp_path)).toPandas()
    exact, hits = x @ x.T, 0
    assert set(got["query_id"]) == set(range(0, 600, 20))
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        others = np.delete(np.arange(600), q)
        best = others[np.lexsort((others, -exact[q, others]))][:20]
        assert list(part["rank"]) == list(range(1, 21)) and np.allclose(part["score"], exact[q, part["vec_id"]], rtol=1e-12)
        hits += len(set(best) & set(part["vec_id"]))
    assert hits >= 0.9 * 30 * 20


def test_op1(spark, tmp_path):
    urls = ["https://a.example.org/es/x?y", "http://EXAMPLE.org/en/1#z", "x://b.org", "http://sub.com/fr/a", "http://com/de/", "http://com/d", "no scheme", "", None, "http://orgx/", "a://example.org/es"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'clash' AS host").write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for i, url in enumerate(urls):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host):])[0], host.translate(LOWER)
        fit = [(len(r), r, v) for r, v in queries.URL_RULES if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        want.append((i, host, path, rule, verdict))
    assert rows_of(queries.op1_url_filters(spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
