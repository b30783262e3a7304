"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the sorted array of the k smallest 48-bit hashes of a text's
distinct shingles. Sketches of parts merge to the sketch of the whole, and two
sketches give estimates of resemblance, containment and distinct shingles.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import BLANK_CLASS, cut, let, partitions

WIDTH = 5
K = 128
_BITS = 48


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def shingle_hashes(hashed: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words of an array column of word hashes; a shorter text is one run."""
    run = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(hashed, i + k) for k in range(width)]), 64 - _BITS)
    few = F.when(F.size(hashed) > 0, F.array(run(F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(hashed) <= width, few).otherwise(F.transform(F.sequence(F.lit(0), F.size(hashed) - width), run))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def with_sketch(docs: DataFrame, text: str, name: str, *, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds the sketch of a text column; null and empty texts have the empty sketch."""
    hashed = F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w))
    return docs.withColumn(name, let(hashed, lambda h: bottom(shingle_hashes(h, width), k)))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def merge_parts(parts: DataFrame, key: str, sketch: str, *, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts, however many.

    Ranks are limited to k inside every task before the shuffle, so a key
    with a third of all parts sends k rows a task.
    """
    each = parts.select(key, F.explode(sketch).alias("hash")).groupBy(key, "hash").agg(F.lit(1).alias("one"))
    best = each.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).filter(F.col("place") <= k)
    return best.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    full = (k - 1) * float(1 << _BITS) / F.element_at(sketch, -1)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: shared hashes among the k smallest of both. Two empty sketches: 1; one: 0."""
    share = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; an empty a is contained in all."""
    union = distinct_count(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def printed(sketch: Column) -> Column:
    """The sketch as text: base64 of six bytes a hash."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 12, "0")), "")))


def in_ranges(docs: DataFrame) -> DataFrame:
    """Adds _range and _ghost to doc_id and text: ascending ranges of ids, each ending in a copy of the row that follows it.

    Ranges are quantiles of a sketch of all ids, four ranges a partition, so
    no task holds more than a few ranges however the ids lie. The first row
    of each range (one row a range) is copied behind the range before it; the
    last range is followed by the first. Null ids come first, ties go by text.
    """
    wanted = 4 * partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 10 * wanted).alias("cuts")).first()["cuts"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))))
    first = ranged.groupBy("_range").agg(F.min(F.struct("doc_id", "text")).alias("_first"))
    ring = Window.orderBy("_range")
    beginning = F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = cut(first.select("_range", F.coalesce(F.lead("_first").over(ring), beginning).alias("_other"))).select("_other.doc_id", "_other.text", "_range", F.lit(True).alias("_ghost"))
    return ranged.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def with_next(ranged: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<column> of the row that follows; rows are shuffled once, by range."""
    over = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")
    followed = ranged.withColumn("_next", F.lead(F.struct(*[F.col(c) for c in carried])).over(over)).filter(~F.col("_ghost"))
    return followed.select(*[c for c in ranged.columns if c not in ("_range", "_ghost")], *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])


def fingerprint_edits(docs: DataFrame, *, k: int = K, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, kept_share.

    The edited text ends in the beginning of the next document in place of
    its own last quarter. Null texts count as empty; two empty texts are alike
    (1). An empty table gives no rows; a table of one row is followed by itself.
    """
    ranged = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    pairs = with_next(with_sketch(ranged, "text", "sketch", k=k, width=width), ["text", "sketch"])
    size = F.length("text")
    tail = F.floor(size / 4).cast("int")
    edited = pairs.withColumn("n_chars", size.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), size - tail), F.substring("next_text", F.lit(1), tail)))
    sketched = with_sketch(edited, "edited", "edited_sketch", k=k, width=width)
    return sketched.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"), containment(F.col("edited_sketch"), F.col("sketch"), k).alias("kept_share"),
    )
