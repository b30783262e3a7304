"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, piece encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import DOCUMENT_COLUMNS, read, shared_folder
from rankloom.llm.jaccardjoin import keep_one
from rankloom.llm.linetemplates import drop_recurring_lines
from rankloom.llm.mixing import mixed_copies, word_count
from rankloom.llm.pieces import encode
from rankloom.llm.quality import quality_rules
from rankloom.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the n-gram ratio go; the trusted part is what labels call good."""
    trusted = read(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules(docs, trusted, carried=DOCUMENT_COLUMNS).filter("kept").select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents that had words and have none left go with them."""
    return drop_recurring_lines(docs).filter((F.col("n_dropped") == 0) | (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id."""
    return keep_one(docs).select(*DOCUMENT_COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes out as often as the mix takes it."""
    return mixed_copies(docs, importance=F.log(word_count(F.col("text")) + 2)).select(*DOCUMENT_COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mixture, one row per copy."""
    return encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", piece_encoding),
]

# hashed n-gram models, MinHash and piece merges are not for SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs

