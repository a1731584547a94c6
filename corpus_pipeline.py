"""A corpus pipeline of five stages: quality, exact duplicates, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import byte_bpe, exact_dedup, mixing, quality, simhash_dedup
from tidewright.llm.common import Scratch, spread, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled rows of docs that are not held out.

    Null and empty texts score the share of good labels, so that they stay where most labelled rows are good; without labels
    of both classes every document has that one score. Repeated rows are judged alike, a score at the threshold stays, long
    texts are scored whole, an empty table stays empty, and further columns of docs are kept, whatever their names.
    """
    rows = spread(docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(rows, model).where("predicted = 1").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts, which are compared whole.

    Null counts as the empty text; a row with a null id stays only where its group has no other; rows that repeat a kept id
    and text stay together. Further columns of docs are kept, and an empty table stays empty.
    """
    return exact_dedup.exact_duplicates(docs, keep="largest").where("kept").select(*docs.columns)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose sets of five-word shingles are alike by 0.8 or more.

    Texts without a word, null ones too, are alike; shorter texts are one shingle. Rows with a null id stay, rows that repeat a
    kept id stay with it. Further columns of docs are kept, and an empty table stays empty.
    """
    return simhash_dedup.one_of_each(docs, words=5, similarity=0.8)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every draw of a document, in the order of the output shards.

    A null source is a source of its own; null and empty texts have size 0 and are drawn as their place in the permutation has
    it; rows equal in id and size are drawn together. Further columns of docs are kept, and an empty table stays empty.
    """
    return mixing.mixed_rows(docs).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document instead of its text, with digests of the ids and of what they decode to.

    A null text has no ids. Rows are coded alone, repeated ones too, and long texts whole; columns of the added names are
    replaced, all others stay, and an empty table stays empty.
    """
    return byte_bpe.coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", simhash_near_duplicates),
    ("mixing", mixing_sources),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL expresses neither the classifier nor the fingerprints; tests hold both dedup stages against brute force, the others to their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written below the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
