"""Exact copies of whole texts, told apart by full content, with no group in one task.

Copies are combined in three steps, each of which groups by digest *and*
content: within a map task (Spark's partial aggregate), within a salt of a
digest, and over the salt winners of a digest. A salt is the number of the map
task modulo the number of salts, so a text that every one of m tasks holds
reaches a salt group m / salts times and the last step ``salts`` times.

The rows then learn their group by a join on the digest, without their texts.
Where one digest stands for several contents, which a sound digest never
shows, its rows are joined on digest and content instead.

Defined cases: a null text counts as empty; a null id is larger than any other;
of rows alike in id and normalised text exactly one stays; an empty table gives
an empty result; further columns of any name are ignored, or handed on by
``drop_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANK_CLASS, cut, partitions, row_hash


def normalised(text: Column) -> Column:
    """The text with every run of blanks replaced by one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK_CLASS}+", " ")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def combine(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size) of rows (id, digest, content): local, salted, then over the salts."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "content")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    )
    # placed by digest alone, so that the contents of one digest meet in a task
    winners = salted.repartition(partitions(rows.sparkSession), "digest")
    return winners.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("size").alias("group_size"))


def exact_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256_hex,
    normalise: Callable[[Column], Column] = normalised, salts: int | None = None,
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of every row: the smallest id of equal normalised texts stays.

    ``digest`` only places rows; equality is that of the normalised texts.
    ``salts`` is the square root of the number of shuffle partitions unless given.
    """
    salts = salts or max(2, math.isqrt(partitions(docs.sparkSession)))
    content = normalise(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("id"), content.alias("content")).withColumn("digest", digest(F.col("content")))

    merged = combine(rows, salts)
    groups = cut(merged.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    shared = groups.filter("contents > 1").select("digest")

    # rows alike in id count together, so that one of them can stay
    named = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("alike"))
    found = named.join(groups.filter("contents = 1").drop("contents"), "digest")
    if not shared.isEmpty():
        doubtful = rows.join(shared, "digest", "left_semi")
        apart = doubtful.groupBy("digest", "content", "id").agg(F.count(F.lit(1)).alias("alike"))
        found = found.unionByName(apart.join(combine(doubtful, salts), ["digest", "content"]).drop("content"))

    place = F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))
    return found.withColumn("place", place).select(
        F.col("id").alias(id_column), "keep_id", "group_size",
        ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest",
    )


def drop_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256_hex,
    normalise: Callable[[Column], Column] = normalised, salts: int | None = None,
) -> DataFrame:
    """The rows that stay, with all their columns; of rows alike in id and text the one of the smallest row hash."""
    salts = salts or max(2, math.isqrt(partitions(docs.sparkSession)))
    whole = docs.select(
        F.struct("*").alias("row"), F.col(id_column).alias("id"), normalise(F.col(text_column)).alias("content"), row_hash(*docs.columns).alias("tie")
    ).withColumn("digest", digest(F.col("content")))
    winners = combine(whole.select("id", "digest", "content"), salts).drop("group_size")
    same = (whole["digest"] == winners["digest"]) & (whole["content"] == winners["content"]) & whole["id"].eqNullSafe(winners["keep_id"])
    one = whole.join(winners, same, "left_semi").groupBy("digest", "content", "id").agg(F.min_by("row", "tie").alias("row"))
    return one.select("row.*")
