import corpus_pipeline
from helpers import SCHEMA, corpus, low_words
from test_decontaminate import brute as plain_contamination
from test_repeats import brute_bytes
from tokenizers import Tokenizer

from weekrank.llm import queries


def check_groups(before, now):
    """Of texts with a similarity of 0.8 or more one stays; a text that is like no other stays."""
    def shingles(text):
        own = low_words(text)
        return {tuple(own[i:i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()
    sets, kept = {r.doc_id: shingles(r.text) for r in before.collect()}, {r.doc_id for r in now.collect()}

    def like(a, b):
        return sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(like(a, b) for a in kept for b in kept if a < b)
    assert all(i in kept for i in sets if not any(like(i, j) for j in sets if j != i))


def test_stages_in_order_and_round_trip(spark, tmp_path):
    rows = [r for r in corpus(8, n=60) if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS _quality", "'mine' AS _own", "'mine' AS runs")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passage = " ".join(next(r[1] for r in rows if r[1] and len(r[1]) > 400).split()[3:30])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer, now = Tokenizer.from_file(queries.WORD_BPE), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{number}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{number}")
        assert {r.doc_id for r in now.collect()} <= {r.doc_id for r in before.collect()}
        assert name == "bpe" or now.columns == before.columns
        if name == "near_dedup":
            check_groups(before, now)
        if name == "repeats":
            want = {r[0]: r[4] for r in brute_bytes([tuple(r) for r in before.select("doc_id", "text").collect()], 100)}
            assert all((r.text or "").encode() == want[r.doc_id] or not want[r.doc_id].isascii() for r in now.collect())
        if name == "benchmark":
            hits = {r[0]: r[2] for r in plain_contamination([tuple(r) for r in before.collect()], [("1", passage)])}
            texts = {r.doc_id: r.text for r in before.collect()}
            assert any(hits.values()) and all((r.text != texts[r.doc_id]) == bool(hits[r.doc_id]) for r in now.collect())
    text = {r.doc_id: r.text for r in before.collect()}
    for r in now.collect():
        assert r.ids == tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids
