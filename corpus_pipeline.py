"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents.  An empty table stays empty in every stage, with the same columns;
texts of any length are read whole; columns of other names, also those that an
operator uses itself, come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, common, exact_dedup, mixing, near_dedup
from docloom.llm import toxicity as toxic

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of 0.7 or more go, all copies alike.

    Null and empty texts have the score of a text without features; without labels of
    both classes nothing goes.
    """
    weights = toxic.train(docs, common.table(spark, sf_dir, "labels"))
    name = "_score" + "_" * max(map(len, docs.columns))  # no column has it
    return toxic.with_score(docs, weights, name).where(F.col(name) < toxic.REJECT_AT).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and one row where it is repeated.

    Null and empty texts are equal.  Rows without doc_id go where an equal text has one;
    of equal ones that all lack it, one stays: the smallest by all columns.
    """
    return exact_dedup.one_of_each(docs, exact_dedup.dedup(docs, exact_dedup.half(docs["doc_id"])))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest doc_id stays.

    Near duplicates share 80 % of their five-word or 85 % of their three-word shingles.
    Texts without words are linked with nothing and stay, as do rows without doc_id,
    which no group can name.
    """
    dropped = near_dedup.near_duplicates(docs, near_dedup.EITHER).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(common.settled(dropped), docs["doc_id"] == F.col("_id"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out, kept or repeated once to meet their sources' targets.

    A null source is a source; a null text has no words and is taken with its hash cell,
    twice at most; a source without any words loses its rows.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids; round_trips says that decoding gave the text.  Null texts have no ids."""
    return bpe.encode_checked(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared checkpoint folder.

    A stage's files are removed once the next stage is written, the last one's when the
    application ends.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.remove(spark, before)
        before = path
    return docs
