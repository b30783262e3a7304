"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of word shingles are one class. Classes meet in
the buckets of MinHash bands. For a pair, MinHash values are compared a few at
a time; once the posterior probability that the similarity reaches the
threshold falls below a tolerance, the pair is dropped. What is left is
verified on the shingle sets.

Pairs never leave a task as rows where groups are large. Small buckets give
pairs, which are pruned; large buckets give a star. Both join classes to
candidate groups, and each group is compared block by block: a task holds two
blocks of bounded size and returns, per class, the number of linked documents
and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bytes_of, cut, limit_batches, partitions, row_hash, shingles

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 7, 48
STEP = 48
TOLERANCE = 1e-6
SMALL = 32
BLOCK_BYTES = 12 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = (_rng.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)


def signature(found: np.ndarray) -> bytes:
    """16 bits of each MinHash of a set of 64-bit hashes."""
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(folded), 512):
        values = folded[start : start + 512, None] * _FACTORS[None, :] + _SHIFTS[None, :]
        # the product alone keeps the order of neighbouring values; this breaks it
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(low, values.min(axis=0), out=low)
    low ^= low >> np.uint32(16)
    return (low & np.uint32(0xFFFF)).astype("<u2").tobytes()


def _log_binomial(n: int, k: int, t: float) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(t) + (n - k) * log(1 - t)


@lru_cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal MinHash values out of ``compared`` at which a pair lives on.

    With a uniform prior the posterior of the similarity after m matches is
    Beta(m + 1, compared - m + 1); it reaches the threshold with the
    probability that a binomial of compared + 1 draws is at most m.
    """
    reach = 0.0
    for m in range(compared + 1):
        reach += np.exp(_log_binomial(compared + 1, m, threshold))
        if reach >= tolerance:
            return m
    return compared


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of two matrices of signatures may be similar enough: one flag per pair of rows."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for start in range(0, a.shape[1], STEP):
        matches = matches + (a[alive, start : start + STEP] == b[alive, start : start + STEP]).sum(axis=1, dtype=np.int32)
        lives = matches >= least_matches(min(start + STEP, a.shape[1]), threshold, tolerance)
        alive, matches = alive[lives], matches[lives]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, content, cls, n, sig of every document; cls stands for the set of shingles."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cls, n, sigs = [], [], []
            for data in bytes_of(batch.column("text")):
                found = shingles(data, width)
                cls.append(int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64)))
                n.append(len(found))
                sigs.append(signature(found) if len(found) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "content", "cls", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "content", "text").mapInArrow(measure, f"doc_id {kind}, content long, cls long, n long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def band(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cls = np.array(batch.column("cls"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(len(cls), -1)
            keys = np.empty((len(cls), BANDS), np.int64)
            for k in range(BANDS):
                part = np.ascontiguousarray(sig[:, k * ROWS : (k + 1) * ROWS])
                keys[:, k] = [np.int64(np.uint64(xxhash.xxh3_64_intdigest(row.tobytes(), k)).view(np.int64)) for row in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls, BANDS)), pa.array(keys.ravel())], ["cls", "key"])

    return classes.select("cls", "sig").mapInArrow(band, "cls long, key long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for the nodes of the edges (a, b).

    Large-star and small-star steps by turns: every node is linked to the
    smallest of its neighbours until nothing changes. Each step is a minimum
    per node, taken before the shuffle, and a join; each round is written.
    """

    def star(both: DataFrame) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u")

    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down)
        ends = small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(ends.filter("a <> b").distinct())
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == last:
            break
        last = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _intersections(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (rows[k], columns[k]).

    Few pairs are intersected one by one. For many, shared shingles become
    columns of 0/1 matrices, and products of column chunks add up.
    """
    if len(rows) < 40 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(rows, columns, strict=True)], np.int64)
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    sizes = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(shared), 2048):
        chunk = shared[start : start + 2048]

        def grid(sets: list[np.ndarray], chunk: np.ndarray = chunk) -> np.ndarray:
            out = np.zeros((len(sets), len(chunk)), np.float32)
            for k, s in enumerate(sets):
                part = s[np.searchsorted(s, chunk[0]) : np.searchsorted(s, chunk[-1], side="right")]
                at = np.searchsorted(chunk, part)
                out[k, at[chunk[at] == part]] = 1.0
            return out

        sizes += grid(a) @ grid(b).T
    return np.rint(sizes[rows, columns]).astype(np.int64)


def _compare(left: dict, right: dict | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the links between two blocks, or inside one."""
    other = left if right is None else right
    found_rows, found_columns = [], []
    chunk = max(1, (1 << 21) // max(1, len(other["n"])))
    for start in range(0, len(left["n"]), chunk):
        n = left["n"][start : start + chunk]
        near = (np.minimum(n[:, None], other["n"][None, :]) >= threshold * np.maximum(n[:, None], other["n"][None, :]) - 1e-9)
        if right is None:
            near &= np.arange(len(other["n"]))[None, :] > np.arange(start, start + len(n))[:, None]
        i, j = np.nonzero(near)
        i += start
        # in portions, since every pair takes its signatures along
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            keep = surviving(left["sig"][p], other["sig"][q], threshold, tolerance)
            found_rows.append(p[keep])
            found_columns.append(q[keep])
    rows = np.concatenate(found_rows) if found_rows else np.empty(0, np.int64)
    columns = np.concatenate(found_columns) if found_columns else np.empty(0, np.int64)
    if not len(rows):
        return rows, columns
    common = _intersections(left["sets"], other["sets"], rows, columns)
    union = left["n"][rows] + other["n"][columns] - common
    linked = common >= threshold * union - 1e-9
    return rows[linked], columns[linked]


def _forest(rows: np.ndarray, columns: np.ndarray) -> list[int]:
    """Positions of the links that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (i, j) in enumerate(zip(rows.tolist(), columns.tolist(), strict=True)):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def _blocks(members: DataFrame) -> DataFrame:
    """Deals the classes of every candidate group into blocks of about BLOCK_BYTES, and gives each pair of blocks its rows once.

    A class of block i goes to the pairs (i, j) for all j of its group.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.sum(8 * F.col("n") + 800) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")


def links(docs: DataFrame, *, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (doc_id, content, cls), degree (cls, linked: documents of other classes linked), forest (a, b: links that connect classes)."""
    spark = docs.sparkSession
    limit_batches(spark)
    measured = cut(classes_of(docs, width))
    classes = cut(
        measured.filter("n > 0").groupBy("cls").agg(F.count("*").alias("copies"), F.min("content").alias("content"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    )
    placed = cut(_bands(classes))
    shared = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("low")).filter("size > 1")
    met = cut(placed.join(shared, "key"))
    few = met.filter(F.col("size") <= small).select("key", "cls")
    pairs = few.select("key", F.col("cls").alias("a")).join(few.select("key", F.col("cls").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    signed = classes.select("cls", "n", "sig")
    sided = pairs.join(signed.withColumnsRenamed({"cls": "a", "n": "n_a", "sig": "sig_a"}), "a").join(signed.withColumnsRenamed({"cls": "b", "n": "n_b", "sig": "sig_b"}), "b")
    sized = sided.filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def prune(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(surviving(a, b, threshold, tolerance))))

    drawn = sized.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long")
    stars = met.filter((F.col("size") > small) & (F.col("cls") != F.col("low"))).select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()
    groups = connected(drawn.unionByName(stars)).withColumnRenamed("node", "cls")
    members = groups.join(classes, "cls")

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingles(data, width).tobytes() for data in bytes_of(batch.column("text"))]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.binary())], [*kept, "shingles"])

    needed = _blocks(members).select("content", "root", "first", "second", "block", "cls", "copies", "n", "sig")
    texts = docs.select("content", "text").join(members.select("content"), "content", "left_semi").dropDuplicates(["content"])
    shingled = texts.mapInArrow(sets, "content long, shingles binary")
    # blocks of one pair meet in one task; pairs of blocks are spread over all tasks
    rows = needed.join(shingled, "content").repartition(partitions(spark), "root", "first", "second").sortWithinPartitions("root", "first", "second", "block")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def finish(key: tuple, held: list[dict]) -> list[tuple]:
            sides: dict[int, dict] = {}
            for block in {r["block"] for r in held}:
                own = [r for r in held if r["block"] == block]
                sides[block] = {
                    "cls": [r["cls"] for r in own], "copies": np.array([r["copies"] for r in own]), "n": np.array([r["n"] for r in own]),
                    "sig": np.frombuffer(b"".join(r["sig"] for r in own), "<u2").reshape(len(own), -1), "sets": [np.frombuffer(r["shingles"], np.uint64) for r in own],
                }
            if key[1] == key[2]:
                one = two = sides.get(key[1])
                i, j = _compare(one, None, threshold, tolerance) if one else (np.empty(0, int),) * 2
            else:
                one, two = sides.get(key[1]), sides.get(key[2])
                i, j = _compare(one, two, threshold, tolerance) if one and two else (np.empty(0, int),) * 2
            if not len(i):
                return []
            shift = 0 if one is two else len(one["cls"])
            linked = np.zeros(len(one["cls"]) + (0 if one is two else len(two["cls"])), np.int64)
            np.add.at(linked, i, two["copies"][j])
            np.add.at(linked, j + shift, one["copies"][i])
            names = one["cls"] + ([] if one is two else two["cls"])
            out = [(names[k], int(linked[k]), None) for k in np.flatnonzero(linked)]
            return out + [(one["cls"][i[k]], 0, two["cls"][j[k]]) for k in _forest(i, j + shift)]

        key, held = None, []
        done: list[tuple] = []

        def emit():
            nonlocal done
            cls, linked, to = zip(*done, strict=True) if done else ((), (), ())
            done = []
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(linked, pa.int64()), pa.array(to, pa.int64())], ["cls", "linked", "other"])

        for batch in batches:
            for row in batch.to_pylist():
                mine = (row["root"], row["first"], row["second"])
                if mine != key:
                    done += finish(key, held) if held else []
                    key, held = mine, []
                    if len(done) > 10_000:
                        yield emit()
                held.append(row)
        done += finish(key, held) if held else []
        yield emit()

    found = cut(rows.select("root", "first", "second", "block", "cls", "copies", "n", "sig", "shingles").mapInArrow(compare, "cls long, linked long, other long"))
    degree = found.filter("other is null").groupBy("cls").agg(F.sum("linked").alias("linked"))
    return measured.drop("sig"), degree, found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, keeper.

    Two documents are linked if the Jaccard similarity of their sets of
    five-word shingles is 0.8 or more; class_id is the smallest doc_id that
    links lead to (null ids come last), n_links the number of other documents linked directly,
    keeper whether the document is the one of its class that stays. A text of
    fewer than five words is one shingle; null texts and texts without words
    have none: they link to nothing and each is its own class. Equal rows are
    linked to one another, and one of them is the keeper.
    """
    keyed = docs.select("doc_id", "text", row_hash("doc_id", "text").alias("content"))
    documents, degree, forest = links(keyed, **options)
    roots = connected(forest).withColumnsRenamed({"node": "cls"})
    same = documents.filter("n > 0").groupBy("cls").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("own"))
    joined = same.join(roots, "cls", "left").join(degree, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = joined.groupBy("root").agg(F.min("own").alias("first"))
    about = joined.join(first, "root").select("cls", F.col("first.doc_id").alias("class_id"), F.col("first.content").alias("kept"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = documents.filter("n > 0").join(about, "cls").select("doc_id", "content", "class_id", "n_links", (F.col("content") == F.col("kept")).alias("keeper"))
    alone = documents.filter("n = 0").select("doc_id", "content", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keeper"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class; of equal rows of a keeper, one stays."""
    keyed = docs.withColumn("_content", row_hash("doc_id", "text"))
    kept = jaccard_classes(docs, **options).filter("keeper").select(F.col("content").alias("_content")).distinct()
    return keyed.join(kept, "_content", "left_semi").dropDuplicates(["_content"]).select(*docs.columns)
