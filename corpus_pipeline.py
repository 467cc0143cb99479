"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept. ``run`` writes each stage's
rows in the shared checkpoint folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, neardup, packing, quality, substrings
from larkspur.llm.frames import materialize, unused

#: Documents with a lower probability of being good go.
MIN_QUALITY = 0.5


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars following the text where there is such a column."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, doesn't reject.

    Null and empty texts have a score like others, long ones are read whole;
    equal texts go or stay together; an empty table stays empty; without labels
    all stay. All columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = unused("_score", *docs.columns)
    scored = quality.classify(docs, *quality.train(docs, labels), score=score)
    return scored.where(F.col(score) >= MIN_QUALITY).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Documents without words, and those with a null doc_id, stay; repeated ids go
    or stay together; of ties the smallest doc_id stays; texts are compared
    whole; an empty table stays empty. All columns stay, whatever their names.
    """
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has.

    Earlier: smaller doc_id, null last; equal ids in any fixed order. Null texts
    become empty, texts that lose all their words stay as rows; long ones are
    read whole; an empty table stays empty. n_chars follows the text; all other
    columns stay, whatever their names.
    """
    return _as_documents(substrings.deduplicate(docs), docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item.

    Null and empty texts share none; equal texts go or stay together; texts are
    read whole; empty tables on either side change nothing. All columns stay,
    whatever their names.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.clean(docs, items)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are one end id; long ones are cut; repeated rows are
    packed as often as they are there; an empty table gives no row. Only doc_id
    stays of the other columns.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_distinct),
    ("substrings", cut_repeats),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: SQL can't express the classifier, nor this packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
