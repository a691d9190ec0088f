"""A corpus pipeline: language, near-duplicates, decontamination, mixing and sharding.

Each stage takes ``(spark, docs, sf_dir)`` with ``docs`` a stored table that has the columns of ``documents``, and works
on every row that the stage before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import decontam, langid, mixing, sharding, simhash
from loomtrace.llm.common import spool, table, unused

#: Documents of which less than this share of n-grams is usual in the best language are in none that is known.
LEAST_LANGUAGE = 0.3
#: Texts with fewer n-grams are too short to be judged by that share.
LEAST_GRAMS = 20
N_SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters go, and those in no known language if long enough to tell."""
    lang, score, grams = unused(docs, "__lang", "__score", "__grams")
    judged = langid.identify(docs, langid.learn(docs.where(langid.learnable())), lang, score)
    low = F.col(score) < LEAST_LANGUAGE
    # Only texts below the share are counted.
    counted = judged.where(F.col(lang) != langid.UNDETERMINED).withColumn(grams, langid.count_n_grams(F.when(low, F.col("text"))))
    return counted.where(~low | (F.col(grams) < LEAST_GRAMS)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shuffled order: the columns of ``documents``, ``shard`` and ``slot``.

    Rows are numbered by id and by a hash of all columns, so only rows equal in all of them change places in a rerun.
    """
    (row,) = unused(docs, "__row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    return sharding.deal(keyed, ["doc_id", row], N_SHARDS).select(*docs.columns, "shard", "slot")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Language filters, fingerprints and tiles are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each result stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
