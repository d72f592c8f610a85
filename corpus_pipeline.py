"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before. All but the last return the
columns of documents. In the mix a document stands as often as it is taken. The near-copy stage takes
five-word shingles and a similarity of 0.8.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstat.llm import bpe, exact, jaccard, mixing, toxicity
from lumenstat.llm.queries import TOKENIZERS
from lumenstat.llm.shared import Scratch, table

#: Tells rows of one id apart where decisions are joined back.
ROW_KEY = "xxhash64(coalesce(text, ''))"

#: The mix depends on random numbers, the toxicity chain on a trained model: no SQL gives run()'s rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go. Null and empty texts stay; rows that repeat go or stay together; an empty table stays empty."""
    return toxicity.clean_only(docs, toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest doc_id stays, once where it repeats; null ids rank lowest."""
    scratch = Scratch(spark)
    index = exact.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    decisions = scratch.finish(exact.deduplicated(docs, index, scratch))
    index.drop()
    return exact.keep_first_copies(docs, decisions)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays. Texts without words and rows without an id are near nothing, but that null ids go where a row with an id is their near copy."""
    scratch = Scratch(spark)
    found = jaccard.joined(docs, scratch, width=5, percent=80, carry=((ROW_KEY, "row_key"),))
    return jaccard.keep_one(docs, scratch.finish(found.select("doc_id", "component_id", "row_key")), ROW_KEY, "row_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix takes it, 0 to 3 times. Texts without words are taken 0 times; a null source is one of its own."""
    scratch = Scratch(spark)
    found = mixing.mixed(docs, scratch, carry=((ROW_KEY, "row_key"),))
    return mixing.repeated(docs, scratch.finish(found.select("doc_id", "row_key", "copies")), ROW_KEY, "row_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text of every row, repeats too; null texts count as empty."""
    return bpe.encoded(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir).select(F.col("*")), f"stage{k}")
    return scratch.finish(docs)
