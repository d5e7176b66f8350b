"""Queries opN_<name> over the tables for these operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import bpe, licences, lsh_forest, media, mixing, quality, sharding, suffix_dedup, token_counts, topk

#: Where the public vocabulary files lie; a parameter of every operator that needs one.
VOCABULARY_JSON, VOCABULARY_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and tags of every document: base places as the contract has them; labels also of further notices and of tags' expressions; permitted says whether all of
    these expressions, evaluated with and, or and with, can be met by permissive licences (true where there is none). A null text has no words; repeated rows stay; an empty table gives an empty one."""
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["kind"] == "base")
    words = F.transform(base, lambda m: m["word"])
    own = F.transform(base, lambda m: m["label"])
    tagged = F.flatten(F.transform("expressions", lambda e: F.split(e["licences"], ",")))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), joined(own).alias("base_labels"), joined(F.concat(F.transform("matches", lambda m: m["label"]), tagged)).alias("labels"), "score", F.forall("expressions", lambda e: e["permitted"]).alias("permitted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document as the library gives them, and the longest prefix within 512. A null text is an empty one; repeated rows stay; an empty table gives an empty one."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY_JSON), limit=512)


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by two-word shingles at 0.8 or more. A null or wordless text is linked with nothing, rows of one id fall into the classes of their own texts; an empty
    table gives an empty one."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes, equal texts together (law `bytes`). A null text goes with empty ones, repeated rows get slots of their own; an empty
    table gives an empty one."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, by their digests. A null text is an empty one; repeated rows stay; an empty table gives an empty one."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY_RANKS), with_ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated strings of 200 bytes go. A null text is an empty one, repeated rows are copies of each other; an empty table gives an empty one."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("spans")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer inner products of every hundredth vector with all others; ties to the smaller id. Null vectors and ones with null or non-finite components take no part; an
    empty table gives an empty one."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so the media column is made from pages: a picture of each page's whole visible text."""
    return media.image_copies(media.page_pictures(table(spark, sf_dir, "pages")), "page_id", "image")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document. A null text has no words, a null source is a source, repeated rows are documents of their own; an empty table gives an empty one."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the importance sample, of as many as are more likely target than not. A null text is an empty one, rows equal in id and text go together; an empty table gives an
    empty one."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7}


OP7 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.c) = len(q.c)
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
