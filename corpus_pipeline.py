"""Corpus pipeline: quality, near duplicates, repeated passages, mixing, encoding.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, lsh_forest, mixing, quality, suffix_dedup
from larkspur.llm.common import new_path, scratch
from larkspur.llm.queries import VOCABULARY_RANKS, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the importance sample, of as many as are more likely target than not; the models come from the labels table.

    Null and empty texts weigh what the labels' odds say, rows equal in id and text go together, null ids count; an empty table gives an empty one.
    """
    return quality.keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of the smallest doc_id.

    Null and wordless texts are groups of their own, of rows equal in id and text one stays, rows of a null id all stay; an empty table gives an empty one.
    """
    return lsh_forest.drop_near_duplicates(docs.select(*COLUMNS), n=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what 200-byte strings cover that start more than once; whole characters stay.

    Null texts stay null, repeated rows of 200 bytes or more lose their text, every row stays; an empty table gives an empty one.
    """
    return suffix_dedup.deduplicated(docs.select(*COLUMNS), length=200)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks drawn to the sources' targets: a row for each document and pass with the words drawn of it.

    Documents without words are kept once, a null source is a source, rows of one id under two sources are two documents; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digests of the ids and of what they decode to: a row for each row; a null text is an empty one; an empty table gives an empty one."""
    return bpe.bpe_encode(docs, vocabulary(VOCABULARY_RANKS))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: No stage's rows can be told in SQL: importance weights come from fitted models, and mixing draws pseudorandom blocks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result written to the shared folder and read again; what a stage writes on its way goes with it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark)
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
