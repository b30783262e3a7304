"""Helpers that the operators of this subpackage share: readers, lineage cuts, hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import kept, shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Words of the contracts: runs of anything but these six bytes.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write what several later steps read to the shared folder; a lost executor then costs no recomputation."""
    return kept(df)


def stored(df: DataFrame) -> DataFrame:
    """Write rows as Parquet to the shared folder and read them back, where later steps read only a part of them."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def limit_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python task at once to 16 MB of rows (or one row), as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_hash(*columns: str):
    """64 bits that stand for the row's content, for telling rows of one id apart."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- hashes of words inside Arrow tasks -----------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
_LONG_WORD = 1 << 16
_powers = np.ones(1, np.uint64)


def byte_classes(*groups: bytes) -> np.ndarray:
    """256 class numbers: 0 for bytes in no group, else the number of the group."""
    out = np.zeros(256, np.uint8)
    for number, group in enumerate(groups, 1):
        out[list(group)] = number
    return out


IS_BLANK = byte_classes(BLANKS) == 1


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of one class that is not 0."""
    if not len(classes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    turns = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    starts = np.concatenate([[0], turns])
    ends = np.concatenate([turns, [len(classes)]])
    kept = classes[starts] != 0
    return starts[kept], ends[kept]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of bytes, the same wherever the span stands.

    Prefix sums of byte times power give all spans of a piece at once; pieces
    of about a megabyte keep memory flat over very long texts.
    """
    out = np.empty(len(starts), np.uint64)
    buffer = np.frombuffer(data, np.uint8)
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    for k in long:
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    at, size = 0, len(starts)
    skipped = set(long.tolist())
    while at < size:
        if at in skipped:
            at += 1
            continue
        stop = int(np.searchsorted(ends, starts[at] + _PIECE, side="right"))
        stop = max(at + 1, min([stop, *[k for k in skipped if k > at]]))
        base = int(starts[at])
        piece = buffer[base : int(ends[stop - 1])].astype(np.uint64) + np.uint64(1)
        powers = _power_table(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * powers[: len(piece)], dtype=np.uint64, out=sums[1:])
        first, last = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[last] - sums[first]) * powers[len(piece) - first]
        # the factor is a power of the piece's length; take it out again
        out[at:stop] *= _inverse_power(len(piece))
        at = stop
    return mix(out)


_BASE_INVERSE = pow(int(_BASE), -1, 1 << 64)


def _inverse_power(exponent: int) -> np.uint64:
    return np.uint64(pow(_BASE_INVERSE, exponent, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = runs((~IS_BLANK[np.frombuffer(data, np.uint8)]).view(np.uint8))
    return span_hashes(data, starts, ends)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring hashes, in order."""
    size = len(hashes) - width + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k in range(width):
        total = total * _BASE + hashes[k : k + size]
    return mix(total)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one run of all its words."""
    words = word_hashes(data)
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(windows(words, min(width, len(words))))


def bytes_of(column) -> Iterator[bytes]:
    """UTF-8 bytes of every text of an Arrow column, null as empty."""
    import pyarrow as pa

    for value in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""
