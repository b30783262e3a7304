"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk toward a multiple of the
identity. A document's score is the logistic of the log density difference,
worked out from Mahalanobis distances with Cholesky factors that are computed
once on the driver and sent to the tasks (two triangles of a few hundred
numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, IS_BLANK, byte_classes, bytes_of, cut, limit_batches, runs, span_hashes
from rankloom.llm.quality import repeat_cover

FEATURES = (
    "words", "word_length", "word_spread", "capitals", "symbols", "exclamations", "digits", "stops", "blanks", "lines", "distinct", "top_word", "same_as_last", "repeats", "line_copies",
)
_COUNTED = byte_classes(bytes(range(65, 91)), b"#*$%&|<>~^=+@", b"!?", b"0123456789", b".,;:", BLANKS)
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 0xC2 for b in range(256)])


def statistics(data: bytes) -> np.ndarray:
    """The transformed statistics of a text, all 0 for one without words.

    Counts are logs, shares are logits pulled away from 0 and 1 by two
    hundredths, so that a share of 0 is the same point at every length.
    """
    buffer = np.frombuffer(data, np.uint8)
    solid = ~IS_BLANK[buffer]
    starts, ends = runs(solid.view(np.uint8))
    n = len(starts)
    if not n:
        return np.zeros(len(FEATURES))
    counts = np.bincount(_COUNTED[buffer], minlength=7)
    # capitals of two bytes: U+00C0 to U+00DE
    accented = int(np.count_nonzero((buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E)))
    points = int(np.count_nonzero((buffer & 0xC0) != 0x80))
    letters = int(np.count_nonzero(_LETTER[buffer]))
    hashes = span_hashes(data, starts, ends)
    ordered = np.sort(hashes)
    turns = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    most = int(np.diff(np.concatenate([turns, [n]])).max())
    lengths = ends - starts
    lines = [line for line in data.split(b"\n") if line.strip(BLANKS)]

    def logit(part: float, whole: float) -> float:
        share = min(part / max(whole, 1), 1.0)
        return float(np.log((share + 0.02) / (1.02 - share)))

    return np.array([
        np.log1p(n), np.log(lengths.mean()), np.log1p(lengths.std()), logit(counts[1] + accented, letters), logit(counts[2], points), logit(counts[3], points), logit(counts[4], points),
        logit(counts[5], points), logit(counts[6], points), logit(len(lines), n), logit(len(turns), n), logit(most, n), logit(int(np.count_nonzero(hashes[1:] == hashes[:-1])), n),
        logit(repeat_cover(hashes), n), logit(len(lines) - len(set(lines)), len(lines)),
    ])


def with_statistics(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    limit_batches(docs.sparkSession)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = [np.round(statistics(data), 6).tolist() for data in bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(values, pa.list_(pa.float64()))], [*carried, "stats"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    return docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(measure, f"{kinds}, stats array<double>")


class Discriminant:
    """A fitted model: standardisation, and per class prior, mean and Cholesky factor of the shrunk covariance."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float) -> None:
        total = sum(s[0] for s in sums.values())
        self.ready = all(sums[c][0] > 1 for c in (0, 1)) if set(sums) >= {0, 1} else False
        self.share = (sums[1][0] / total if 1 in sums else 0.0) if total else 0.5
        if not self.ready:
            return
        mean = sum(s[1] for s in sums.values()) / total
        second = sum(s[2] for s in sums.values()) / total
        self.centre, self.scale = mean, np.sqrt(np.maximum(np.diag(second) - mean**2, 1e-6))
        self.parts = []
        for label in (0, 1):
            n, first, products = sums[label]
            own = first / n
            spread = (products / n - np.outer(own, own)) / np.outer(self.scale, self.scale)
            shrunk = (1 - shrinkage) * spread + shrinkage * max(np.trace(spread) / len(spread), 1e-6) * np.eye(len(spread))
            factor = np.linalg.cholesky(shrunk)
            self.parts.append(((own - mean) / self.scale, factor, float(np.log(np.diag(factor)).sum()), float(np.log(n / total))))

    def log_odds(self, stats: np.ndarray) -> np.ndarray:
        """Log density difference and priors, class 1 over class 0, of the rows of a matrix."""
        scaled = (stats - self.centre) / self.scale
        found = []
        for own, factor, half_log_det, prior in self.parts:
            apart = np.linalg.solve(factor, (scaled - own).T)
            found.append(prior - half_log_det - 0.5 * (apart**2).sum(axis=0))
        return found[1] - found[0]

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the share of class 1 for all where a class is missing."""
        if not self.ready or not len(stats):
            return np.full(len(stats), self.share)
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(stats), -30.0, 30.0)))


def fit(labelled: DataFrame, label: str, shrinkage: float) -> Discriminant:
    """Class sums of the statistics and of their products, added up on Spark in one pass over all labelled rows."""
    size = len(FEATURES)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    at = lambda i: F.col("stats")[i]
    rows = labelled.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.sum(at(i)) for i in range(size)]).alias("first"), F.array(*[F.sum(at(i) * at(j)) for i, j in pairs]).alias("products")).collect()
    sums = {}
    for row in rows:
        products = np.zeros((size, size))
        for (i, j), v in zip(pairs, row["products"], strict=True):
            products[i, j] = products[j, i] = v
        sums[row[label]] = (float(row["n"]), np.array(row["first"]), products)
    return Discriminant(sums, shrinkage)


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, shrinkage: float = 0.1, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Rows whose crc32(doc_id as text) is divisible by ``folds`` are held out of
    the fit (a null id counts as the empty text, crc32 0). Only the text goes
    into a score: null and empty texts have statistics of 0 and a score too.
    Conflicting labels of one id: the largest counts; null labels are left
    out. Without rows of both classes every score is the share of class 1
    (0.5 without any label).
    """
    # the table of statistics is slim; texts are read once
    stats = cut(with_statistics(docs).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0))
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    model = fit(stats.filter(~F.col("held_out")).join(marked, "doc_id").filter(F.col(label).isin(0, 1)), label, shrinkage)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            matrix = np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(FEATURES))
            scores = np.round(model.score(matrix), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
