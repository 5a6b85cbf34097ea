import random
import re

import public_tokenizers
import pytest
from helpers import SCHEMA, collected, corpus, frame
from tokenizers import Tokenizer

from weekrank.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's 3½ o'clock <|endoftext|> don'T <|START|> x", "ｆｕｌｌ ①② İstanbul ΑΣ ς", "é à̖ Å", "日本語 テスト 🙂🙂🏽 ‍", "'s's'll", "<|startoftext|><|endoftext|>",
       "tab\tnew\nline nbsp　wide", "ͅᾳ ﬁ ǅ", "\x00\x01", "हिन्दी ไทย العربية", "a" * 3000, "²³ ⅷ ⅷ١", "ẞß Ǆ", "x y\u0085z"]


@pytest.mark.parametrize("most_common", [bpe.COMMON, 40, 0])
def test_same_as_the_tokenizer(spark, monkeypatch, most_common):
    monkeypatch.setattr(bpe, "SHARD_BYTES", 8000)
    rows = corpus(3) + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], ids, tokenizer.decode(ids, skip_special_tokens=False)))
    got = bpe.decode(bpe.encode(frame(spark, rows), PATH, most_common), bpe.pieces(spark, PATH))
    assert collected(got) == sorted(want, key=repr)


def test_decoding_while_encoding_is_the_same(spark):
    docs, table = frame(spark, corpus(4)), bpe.pieces(spark, PATH)
    assert collected(bpe.encode(docs, PATH, table=table)) == collected(bpe.decode(bpe.encode(docs, PATH), table))
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, table=table).columns == ["doc_id", "ids", "decoded"]


def test_common_words_stay_within_their_number(spark):
    table = spark.createDataFrame([(f"w{i}", 1 + i // 10, [i]) for i in range(1000)] + [("x" * 40, 10 ** 6, [1])], "word string, n long, ids array<int>")
    for most in (0, 5, 100, 999, 1000, 5000):
        got = bpe.common_words(table, most).collect()
        assert len(got) <= most and (most < 1000 or len(got) == 1000) and all(len(r.word) <= bpe.LONG for r in got)


def test_ids_without_a_piece_and_null_lists(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, piece string")
    rows = spark.createDataFrame([(1, [1, 2, 9]), (2, None), (3, []), (4, [9])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, table).orderBy("doc_id").collect()] == ["a b", "", "", ""]


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), PATH), bpe.pieces(spark, PATH)).count() == 0


def test_plain_texts_are_split_as_by_the_library():
    splitter = bpe.splitter(PATH)
    signs = [chr(i) for low, high in ((0, 0x250), (0x400, 0x460), (0x2010, 0x2028), (0x20AC, 0x20AD)) for i in range(low, high)]
    rng = random.Random(3)
    texts = [f"a{s}b1 {s}{s} 'S{s}'s" for s in signs] + ["".join(rng.choices(signs, k=40)) for _ in range(500)]
    for text in texts:
        normal = splitter.full.normalizer.normalize_str(text)
        assert splitter.words(text) == [normal[a:b] for _, (a, b) in splitter.full.pre_tokenizer.pre_tokenize_str(normal)]
    # Nearly all texts take the expression of written-out classes.
    assert isinstance(splitter.quick, re.Pattern) and splitter.quick.findall("naïve été, x1'll\xa0ok") == ["naïve", "été", ",", "x", "1", "'ll", "ok"]
    assert bpe._written_out(r" ?\p{L}+") is None


def test_a_worker_keeps_no_memory_of_an_encoder():
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return next(int(line.split()[1]) for line in file if line.startswith("Anonymous:")) / 1024

    rng, sizes = random.Random(5), []
    for task in range(7):
        words = [f"{task}{rng.randrange(10 ** 12):x}" for _ in range(20_000)]
        bpe.encoder(PATH).ids(words)
        bpe.forget()
        sizes.append(held())
    assert sizes[-1] - sizes[1] < 40


def test_words_have_the_ids_of_the_whole_tokenizer():
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(6)
    words = sorted({"".join(rng.choices("abcdeinorst", k=rng.randint(1, 14))) for _ in range(20_000)} | {"日本語", "été", "'s", "🙂", "7", "<|endoftext|>"})
    assert bpe.encoder(PATH).ids(words) == [tokenizer.encode(word, add_special_tokens=False).ids for word in words]
