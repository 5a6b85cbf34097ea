"""The corpus pipeline: quality, near-duplicates, repeated strings, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank.llm import bpe, common, decontaminate, minhash, quality, queries, suffix_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality reaches the threshold."""
    common.configure(spark)
    whole = common.table(spark, sf_dir, "documents")
    network = quality.train(whole, common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "quality")
    return quality.score(docs, network, name).filter(F.col(name) >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    common.configure(spark)
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that occur earlier."""
    common.configure(spark)
    return suffix_dedup.remove(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text they decode to."""
    common.configure(spark)
    return bpe.encode(docs, queries.WORD_BPE, table=bpe.pieces(spark, queries.WORD_BPE))


STAGES = [("quality", keep_good), ("near_dedup", keep_one_of_each), ("repeats", cut_repeats), ("benchmark", cut_benchmark), ("bpe", encode)]

#: SQL cannot express the classifier, the signatures or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        written = common.stored(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return docs
