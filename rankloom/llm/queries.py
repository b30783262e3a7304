"""The registered query of every operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import conversations, discriminant, exactcopies, jaccardjoin, licenses, linetemplates, mixing, pagetext, pieces, quality, sketches, tokenfiles, whitening
from rankloom.llm.common import read
from rankloom.plans.registry import Catalog

CATALOG = Catalog()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@CATALOG.query("op1_pareto_mix")
def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    importance = F.log(mixing.word_count(F.col("text")) + 2)
    return mixing.pareto_mix(docs, importance=importance).drop("content", "rank_value", "source")


@CATALOG.query("op2_license_scan")
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, folder, "documents"))


@CATALOG.query("op4_bottom_k")
def op4_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.fingerprint_edits(read(spark, folder, "documents"))


@CATALOG.query("op3_ngram_ratio")
def op3_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    trusted = read(spark, folder, "labels").filter("quality = 1")
    return quality.quality_rules(read(spark, folder, "documents"), trusted)


@CATALOG.query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.token_table(read(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@CATALOG.query("op6_discriminant")
def op6_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return discriminant.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


@CATALOG.query("op8_main_text")
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pagetext.main_text(read(spark, folder, "pages"))


@CATALOG.query("op10_line_templates")
def op10_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return linetemplates.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "n_chars", "text")


@CATALOG.query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccardjoin.jaccard_classes(read(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "keeper")


@CATALOG.query("op7_piece_lattice")
def op7_piece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(read(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


_EXACT_COPIES = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents),
groups as (select content, min(doc_id) as keep_id, count(*) as group_size from texts group by content)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256
from texts join groups using (content)
"""


@CATALOG.query("op11_exact_copies", _EXACT_COPIES)
def op11_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exactcopies.exact_copies(read(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


@CATALOG.query("op12_block_whitening")
def op12_block_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(read(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@CATALOG.query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repairs(conversations.damaged(read(spark, folder, "conversations")))
