"""A corpus pipeline: language identification, toxicity, near duplicates, packing, each over all that the stage before kept.

Defined cases for every stage: an empty table gives an empty result; texts of any length are read whole; all columns of
the documents pass as they are, whatever their names, until the last stage, which reads the id and the text only.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import jaccard, langid, packing, toxicity
from strandlake.llm.common import read_table, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identified language.

    Null and empty texts, and those without a letter, have none. Repeated rows are decided alike; a null id or language is
    not learned from. Of equally likely languages the first by name counts.
    """
    return langid.keep_identified(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic.

    A null or empty text has the score of no words. Repeated rows are decided alike; a score of just one half is toxic. Without
    usable labels nothing goes.
    """
    return toxicity.keep_civil(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Documents without words are nobody's copies and stay, as do those with a null id. Rows that repeat the least id of their
    group all stay.
    """
    return jaccard.keep_one(docs, size=5, t=Fraction(4, 5))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens.

    A null or empty text is the end id alone; repeated rows are packed each; pieces of equal length are ranked by id and place.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("language ID", language), ("toxicity", civility), ("n-gram Jaccard join", near_duplicates), ("packing", windows)]

#: SQL cannot train the two models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written as Parquet and read again for the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
