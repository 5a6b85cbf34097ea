import random

import pytest
from helpers import LOWER, SCHEMA, collected, corpus, frame, sha

from weekrank.llm import exact_dedup, queries


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    out = []
    for r in rows:
        text = (r[1] or "").translate(LOWER)
        keep = max((i for i in groups[text] if i is not None), default=None)
        out.append((r[0], keep, len(groups[text]), r[0] == keep, sha(text)))
    return sorted(out, key=repr)


def hard():
    """Copies in other cases, near copies of one length and one beginning, many repeated rows, nulls and long texts."""
    rng, base = random.Random(4), "Ärger In The Same Beginning " * 20
    rows = corpus(4, n=60)
    rows += [(1000 + i, base + rng.choice(["ABC", "abc", "abd", "ABÇ", "abç"]), None, None, None) for i in range(200)]
    rows += [(2000 + i, "hot" if i % 2 else "HOT", "en", "s", 3) for i in range(300)] + [(2000, "HOT", "en", "s", 3)] * 3
    rows += [(None, "no id at all", None, None, None)] * 2 + [(3000, None, None, None, None), (3001, "", None, None, None)]
    rows += [(4000 + i, "word " * 60000 + str(i // 2), None, None, None) for i in range(4)]
    rows += [(5000 + i, x, None, None, None) for i, x in enumerate(["É", "é", "ß", "SS", "ss", "\x00A", "\x00a", "İ", "i̇"])]
    return rows


def test_against_brute_force(spark):
    rows = hard()
    assert collected(exact_dedup.dedup(frame(spark, rows), digests=True)) == brute(rows)


@pytest.mark.parametrize("prefix", [1, 5])
def test_full_hashes_only_where_a_group_has_several_rows(spark, prefix):
    rows = hard()
    got, want = exact_dedup.dedup(frame(spark, rows), prefix=prefix).collect(), brute(rows)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((r[:4] for r in want), key=repr)
    alone = [r for r in got if r.text_sha256 is None]
    assert alone and all(r.group_size == 1 for r in alone)
    assert all(r.text_sha256 for r in got if r.group_size > 1)


def test_bits_that_clash_only_cost_time(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS", 8)
    rows = hard()
    assert collected(exact_dedup.dedup(frame(spark, rows), digests=True)) == brute(rows)


def test_empty_table_and_the_query(spark, tmp_path):
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [r for r in corpus(5, n=40) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_exact_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collected(got) == brute(rows)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
