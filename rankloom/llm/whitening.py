"""Whitening of embeddings with Spark MLlib's distributed block matrices.

Centred rows are indexed and laid out as a BlockMatrix Y. Y' Y is the scatter
matrix, d x d, whose eigenvectors the driver takes; Y times the whitening
matrix, again a BlockMatrix product, projects every row.

BlockMatrix counts rows of a block and blocks by 32-bit numbers and lists its
blocks on the driver, so rows go through in panels: at most ``panel_rows`` of
them at a time, whose scatters add up. What the driver holds is d sums, the
scatter matrix, one count per partition and the block numbers of one panel.

Defined cases: rows whose vector is null or empty, holds a null, a non-finite
entry or one beyond the exact whole numbers of a double are dropped; so are
rows that have not the most frequent dimension (the larger one on a tie), as
they lie in another space. Rows are a list: repeated ones and null ids count as
they stand. Components without variance have null coordinates. No remaining row
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, stored

SCALE = 1024
OFFSET = 100_000
BLOCK_BYTES = 4 << 20
BLOCKS_OF_A_TASK = 8
PANEL_ROWS = 1 << 28
_EXACT = float(1 << 53)
_POSITION = (1 << 33) - 1

RESULT = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Fitted directions: mean sums, eigenvalues in falling order, unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def explained(self) -> np.ndarray:
        trace = self.values.sum()
        return self.values / trace if trace > 0 else np.full(len(self.values), np.nan)

    def matrix(self, components: int) -> np.ndarray:
        """d x components: eigenvectors over the roots of their eigenvalues; 0 where there is no variance."""
        values, vectors = self.values[:components], self.vectors[:, :components]
        flat = values <= 1e-12 * max(self.values[0], 1e-300)
        return np.where(flat, 0.0, vectors / np.sqrt(np.where(flat, 1.0, values)))


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): the vectors that remain, as whole numbers floor(scale * entry) + offset."""
    vectors = rows.select(F.col(id_column).alias("vec_id"), F.transform(F.col(vector_column), lambda c: c.cast("double") * scale).alias("scaled"))
    usable = F.forall("scaled", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _EXACT))
    sound = vectors.filter(F.col("scaled").isNotNull() & (F.size("scaled") > 0) & usable)
    return sound.select("vec_id", F.transform("scaled", lambda c: F.floor(c).cast("long") + offset).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (of a checkpoint, so that partitions stay as they are) with ``row``, numbers from 0 without gaps."""
    at = rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    counts = {r["_part"]: r["n"] for r in at.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    if not starts:
        return at.withColumn("row", F.lit(0).cast("long")).drop("_place", "_part")
    first = F.get(F.lit(np.array(starts, dtype=np.int64)), F.col("_part"))
    return at.withColumn("row", first + F.col("_place").bitwiseAND(F.lit(_POSITION))).drop("_place", "_part")


def _blocks(rows: DataFrame, n: int, d: int, per_block: int) -> BlockMatrix:
    """Rows (row, y) as a BlockMatrix; everything between the columns and the blocks stays in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("y").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(per_block, d)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, the middle dimension cut into ``splits`` tasks, which PySpark's own method leaves at one."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _panels(rows: DataFrame, n: int, panel_rows: int):
    """Every panel's rows, numbered from 0, and their number."""
    for start in range(0, n, panel_rows):
        size = min(panel_rows, n - start)
        inside = rows if n <= panel_rows else rows.filter(F.col("row").between(start, start + size - 1)).withColumn("row", F.col("row") - start)
        yield start, size, inside


def _per_block(d: int) -> int:
    return max(1, BLOCK_BYTES // (8 * d))


def fit(rows: DataFrame, n: int, sums: list[int], panel_rows: int) -> Whitening:
    """Eigenvectors of the covariance (divisor n) of rows (row, y) that are centred already."""
    d = len(sums)
    scatter = np.zeros((d, d))
    for _, size, inside in _panels(rows, n, panel_rows):
        panel = _blocks(inside, size, d, _per_block(d))
        scatter += _multiply(panel.transpose(), panel, -(-panel.numRowBlocks // BLOCKS_OF_A_TASK)).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), vectors[:, ::-1])


def project(rows: DataFrame, n: int, matrix: np.ndarray, panel_rows: int) -> DataFrame:
    """(row, coordinates) of rows (row, y): the BlockMatrix product with ``matrix``."""
    spark, (d, k) = rows.sparkSession, matrix.shape
    out = None
    for start, size, inside in _panels(rows, n, panel_rows):
        panel = _blocks(inside, size, d, _per_block(d))
        weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, matrix.ravel(order="F").tolist()))], 1), d, k, d, k)
        product = _multiply(panel, weights, 1).toIndexedRowMatrix()
        found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
        found = found.select((F.col("index") + start).alias("row"), vector_to_array("vector").alias("coordinates"))
        out = found if out is None else out.unionByName(found)
    return out


def _identity_error(coordinates: DataFrame, n: int, used: list[int]) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of the coordinates, less the identity."""
    if not used:
        return 0.0
    value = {i: F.get("coordinates", F.lit(i)) for i in used}
    means = coordinates.agg(*[F.avg(value[i]).alias(f"m{i}") for i in used]).first()
    centred = {i: value[i] - F.lit(means[f"m{i}"]) for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = coordinates.agg(*[(F.sum(centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8,
    scale: int = SCALE, offset: int = OFFSET, panel_rows: int = PANEL_ROWS,
) -> DataFrame:
    """One row per remaining vector and component (at most the dimension): its whitened coordinate and what the fit says.

    Columns: vec_id, component from 1, n, deviation (sum over dimensions of
    (n x - S)^2, exact), whitened, explained (the component's share of the
    variance), identity_error (one value for all).
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_column]
    nothing = spark.createDataFrame([], RESULT.format(id=kind))
    vectors = cut(whole_vectors(rows, id_column, vector_column, scale, offset))
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return nothing
    n, d = sizes["n"], sizes["d"]
    indexed = numbered(vectors if vectors.filter(F.size("x") != d).isEmpty() else cut(vectors.filter(F.size("x") == d)))
    if n > panel_rows:  # files of neighbouring row numbers, so that a panel opens its own files only
        indexed = stored(indexed)
    totals = indexed.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total"))
    sums = [r["total"] for r in totals.orderBy("at").collect()]

    scaled = F.zip_with("x", F.lit(np.array(sums, dtype=np.int64)), lambda x, s: x * n - s)
    centred = indexed.select("row", "vec_id", scaled.alias("far"))
    matrix_rows = centred.select("row", F.transform("far", lambda v: v.cast("double") / n).alias("y"))
    fitted = fit(matrix_rows, n, sums, panel_rows)

    k = min(components, d)
    weights = fitted.matrix(k)
    coordinates = cut(project(matrix_rows, n, weights, panel_rows))
    flat = [not weights[:, i].any() for i in range(k)]
    error = _identity_error(coordinates, n, [i for i in range(k) if not flat[i]])

    def square(value: Column) -> Column:
        whole = value.cast("decimal(19,0)")
        return whole * whole

    deviation = F.aggregate("far", F.lit(0).cast("decimal(38,0)"), lambda total, v: (total + square(v)).cast("decimal(38,0)"))
    shares = fitted.explained()[:k].tolist()
    each = F.posexplode(F.transform("coordinates", lambda c: c)).alias("at", "whitened")
    found = centred.select("row", "vec_id", deviation.alias("deviation")).join(coordinates, "row").select("vec_id", "deviation", each)
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(~F.get(F.lit(flat), F.col("at")), F.col("whitened")).alias("whitened"),
        F.nanvl(F.get(F.lit(shares), F.col("at")), F.lit(None).cast("double")).alias("explained"), F.lit(error).alias("identity_error"),
    )
