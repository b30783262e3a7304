"""Quality rules: hashed n-gram likelihood ratios between a trusted part and the whole corpus.

A text is cut into runs of word characters and runs of signs; its n-grams (one
and two tokens) fall into 2^bits buckets. Two multinomials over the buckets,
one of the trusted documents and one of all documents, give every document a
mean log likelihood ratio per n-gram. Documents below a fixed threshold, or
failing the base rules, are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, IS_BLANK, byte_classes, bytes_of, limit_batches, runs, span_hashes, windows, word_hashes

BITS = 16
THRESHOLD = -0.35
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_TOKENS = byte_classes(bytes(b for b in range(256) if b not in BLANKS and b not in _SIGNS), _SIGNS)
_SYMBOL = byte_classes(b"#*$%&|<>") == 1


def ngram_buckets(data: bytes, bits: int = BITS) -> np.ndarray:
    """Bucket of every token and of every pair of neighbouring tokens."""
    starts, ends = runs(_TOKENS[np.frombuffer(data, np.uint8)])
    if not len(starts):
        return np.empty(0, np.int64)
    single = span_hashes(data, starts, ends)
    return (np.concatenate([single, windows(single, 2)]) >> np.uint64(64 - bits)).astype(np.int64)


def base_statistics(data: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a text."""
    buffer = np.frombuffer(data, np.uint8)
    solid = ~IS_BLANK[buffer]
    words = word_hashes(data)
    n_words = len(words)
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line.strip(BLANKS):
            repeated += line in seen
            seen.add(line)
    covered = repeat_cover(words)
    failed = n_words < 10 or 100 * covered > 20 * n_words
    return n_words, int(np.count_nonzero(solid & ((buffer & 0xC0) != 0x80))), int(np.count_nonzero(_SYMBOL[buffer])), repeated, covered, failed


def repeat_cover(words: np.ndarray, width: int = 5) -> int:
    """How many words stand in a window of ``width`` words that the text has twice or more."""
    found = windows(words, width)
    ordered = np.sort(found)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(found, twice)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + len(found)] |= again
    return int(np.count_nonzero(covered))


def bucket_counts(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> DataFrame:
    """Per bucket: n-grams of all documents (``raw``) and of two halves of the trusted ones that pass the base rules.

    Every task adds its documents up and sends its buckets once, so what is
    shuffled beside the texts is bounded by tasks times buckets.
    """
    limit_batches(docs.sparkSession)
    # null ids get keys that match nothing and do not meet in one task
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.xxhash64("text").cast("string")))
    good = trusted.select(F.col("doc_id").cast("string").alias("_key")).filter(F.col("_key").isNotNull()).distinct().withColumn("_good", F.pmod(F.xxhash64(F.lit(3), "_key"), F.lit(2)).cast("int") + 1)
    flagged = docs.select("text", key.alias("_key")).join(good.hint("shuffle_hash"), "_key", "left").select("text", F.coalesce("_good", F.lit(0)).alias("good"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        raw, *target = np.zeros((3, 1 << bits), np.int64)
        for batch in batches:
            for data, good in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = ngram_buckets(data, bits)
                np.add.at(raw, found, 1)
                if good and not base_statistics(data)[5]:
                    np.add.at(target[good - 1], found, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(a[used]) for a in (raw, *target)]], ["bucket", "raw", "first", "second"])

    counted = flagged.mapInArrow(count, "bucket long, raw long, first long, second long")
    return counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "first", "second")])


def log_ratios(counts: DataFrame, bits: int = BITS, weight: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of every bucket, less what trusted texts have on average; 2^bits numbers, whatever the corpus.

    The target is smoothed toward the raw distribution by ``weight`` n-grams a
    bucket in use, so a bucket seldom seen says little. The average is taken
    over each half of the trusted texts with the ratios of the other half; so
    0 is what a good text has that was not trusted itself, also where one
    text or a group of copies makes up much of the corpus. Without trusted
    n-grams all ratios are 0.
    """
    raw, first, second = np.zeros((3, 1 << bits))
    for row in counts.collect():
        raw[row["bucket"]], first[row["bucket"]], second[row["bucket"]] = row["raw"], row["first"], row["second"]
    if not (first.sum() + second.sum()):
        return np.zeros(1 << bits)
    chance = (raw + weight) / (raw.sum() + weight * len(raw))
    pull = weight * np.count_nonzero(raw)

    def ratios(target: np.ndarray) -> np.ndarray:
        return np.log((target + pull * chance) / (target.sum() + pull)) - np.log(chance)

    crossed = [float((ratios(a) * b).sum() / b.sum()) for a, b in ((first, second), (second, first)) if b.sum()]
    return ratios(first + second) - float(np.mean(crossed))


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def quality_rules(docs: DataFrame, trusted: DataFrame, *, bits: int = BITS, threshold: float = THRESHOLD, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carried`` columns, the base statistics, base_failed, kept, llr.

    ``trusted`` names documents by doc_id; those that fail the base rules are
    not trusted. A null or empty text has no words, fails and is not kept.
    Without trusted documents the ratio is 0 everywhere and the base rules
    decide. Equal rows get equal rows; extra columns are ignored.
    """
    ratios = log_ratios(bucket_counts(docs, trusted, bits), bits)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for data in bytes_of(batch.column("text")):
                base = base_statistics(data)
                found = ngram_buckets(data, bits)
                llr = round(float(ratios[found].mean()), 9) if len(found) else 0.0
                rows.append((*base, not base[5] and llr >= threshold, llr))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], *[pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]], [*carried, *[c.split()[0] for c in SCORED.split(", ")]]
            )

    needed = docs.select(*dict.fromkeys([*carried, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    return needed.mapInArrow(score, f"{kinds}, {SCORED}")
