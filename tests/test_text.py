import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekrank.functions import nested, text


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v")).alias("o")).collect())]


def test_trim_all_strips_unicode_space(spark):
    assert one(spark, ["\t a b \n", " x ", " y", "", None], text.trim_all) == ["a b", "x", "y", "", None]


def test_canonical_key(spark):
    values = ["  Straße  X ", "ＡＢＣ", "a \tb", "PLAIN", "é", "é", None, "NA", "None", "\x1c a \x1f b"]
    assert one(spark, values, text.canonical_key) == [
        "strasse x", "abc", "a b", "plain", "é", "é", None, "na", "none", "a b"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=12), min_size=20, max_size=20))
def test_canonical_key_property(spark, names):
    want = [" ".join(unicodedata.normalize("NFKC", n).split()).casefold() for n in names]
    assert one(spark, names, text.canonical_key) == want


@pytest.mark.parametrize("given_, want", [
    ("A feat. B", "A"), ("A [live]", "A"), ("A X B", "A"), ("A", "A"), (" A ft. B feat. C", "A ft. B"), ("A Ft. B [x]", "A"),
    ("feat. B", "feat. B"), ("A [x] feat. B", "A [x]")])
def test_clean_credit(spark, given_, want):
    assert one(spark, [given_], text.clean_credit) == [want]


BUCKETS = {
    "pop": "other", "indie pop": "pop", "power pop": "rock", "pop punk": "rock", "garage rock": "electronic_dance",
    "witch house": "electronic_dance", "rap metal": "hip_hop_rap", "k-rap": "hip_hop_rap", "french rap": "hip_hop_rap",
    "therapy": "hip_hop_rap", "k-rock": "rock", "post-rock": "rock", "post-hardcore": "metal_hard", "k-pop": "world_regional",
    "j-r&b": "rnb_soul", "reggaeton": "latin", "reggae": "other", "trip hop": "other", "drum and bass": "other",
    "soundtrack": "classical_art", "forró": "latin", " POP": "other", "spoken word": "other", "R&B": "rnb_soul"}


def test_bucket_of(spark):
    got = one(spark, [*BUCKETS, None], text.bucket_of)
    assert dict(zip(BUCKETS, got)) == BUCKETS and got[-1] == "other"


def test_lists_and_mode(spark):
    assert one(spark, ["Rock, , Pop ", "", None], text.split_list) == [["rock", "pop"], [], []]
    arrays = [["rock", "other"], ["rock", "rock", "hip"], [], ["b", "a", "b", "a"]]
    assert one(spark, arrays, text.array_mode, "array<string>") == ["other", "rock", None, "a"]


def test_nested(spark):
    tags = spark.createDataFrame([([("a", 1), ("b", 3), ("c", 3)],), ([],), (None,)], "t array<struct<name:string,count:long>>")
    assert [r[0] for r in tags.select(nested.top_by_count(F.col("t"))).collect()] == ["b", None, None]
    images = spark.createDataFrame([([("s", "x"), ("l", "y")],), ([("l", "")],)], "t array<struct<size:string,`#text`:string>>")
    assert [r[0] for r in images.select(nested.text_of(F.col("t"), "size", "l")).collect()] == ["y", None]


def test_credit_cut_after_a_no_break_space(spark):
    df = spark.createDataFrame([("Ann feat. Bob",), ("Ann [live]",)], "c string")
    assert [r[0] for r in df.select(text.clean_credit(F.col("c"))).collect()] == ["Ann", "Ann"]
