"""Embedding whitening with distributed block matrices.

Vectors become whole numbers, sums per dimension are exact, and the centred rows are indexed without gaps and dealt into
the blocks of an MLlib ``BlockMatrix``. Its transpose times itself is the scatter, whose d x d numbers come to the driver for
the eigenvectors; the block matrix times the whitening matrix (d x components) projects all rows. How far the covariance of
the projected rows is from the identity is measured the same way, over all of them.

Where the work runs: indexing, blocks, products and the way back in the JVM, spread by row blocks. The product over the rows is
cut into many parts of its middle dimension (else one task would get the only block of the result, and all rows with it).
Bounded in the driver and in broadcasts: d sums, d x d numbers, one count per partition.

Edge cases: rows whose vector is null or holds null or non-finite entries are left out, as are those of another size than
most have (of sizes as frequent, the longer). Ids may be null or repeat: every row is whitened. Entries beyond +-2^31 after scaling are
held there; a deviation that leaves the range of a long is null. A component whose eigenvalue is nothing but rounding (below
``FLAT`` of the trace: constant or fewer rows than dimensions) has no scale: ``whitened`` is null, and it does not count for the
identity error, which is null if none is left. An empty table, and vectors without entries, give an empty result; columns
other than id and vector are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partloom.session import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 1024  # rows of a block
PARTS_PER_CORE = 2
FLAT = 1e-12


def whole_numbers(vector: Column) -> Column:
    """array<bigint> of floor(1024 c) + 100000; null where the row is left out."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    held = lambda c: F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31), F.floor(c.cast("double") * SCALE))).cast("bigint") + SHIFT
    return F.when(F.forall(vector, finite), F.transform(vector, held))


def indexed(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """Written table of index (0 to n - 1), vec_id, x; the number of rows n and the size of their vectors."""
    x = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(F.col(vector)).alias("x")).where("x IS NOT NULL")
    marked = written(x.select(F.monotonically_increasing_id().alias("id"), "vec_id", "x", F.size("x").alias("size")), "whitening-rows")
    size = marked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return marked.select(F.col("id").alias("index"), "vec_id", "x"), 0, 0
    own = marked.where(F.col("size") == size["size"]).drop("size")
    # Ids rise within a partition in steps of one, but for rows of other sizes; partitions follow each other.
    slot, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    if marked.where(F.col("size") != size["size"]).isEmpty():
        numbered = own
    else:
        numbered = written(own.select(F.monotonically_increasing_id().alias("id"), "vec_id", "x"), "whitening-rows")
    counts = numbered.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("slot", (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"))
    placed = numbered.withColumn("slot", slot).join(F.broadcast(before), "slot")
    return placed.select((F.col("before") + place).alias("index"), "vec_id", "x"), size["n"], size["size"]


def sums(table: DataFrame, size: int) -> np.ndarray:
    """Exact sums per dimension."""
    each = table.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("total")).collect()
    out = np.zeros(size, np.int64)
    for row in each:
        out[row["at"]] = row["total"]
    return out


def to_blocks(rows: DataFrame, n: int, size: int) -> BlockMatrix:
    """Block matrix of the rows ``index``, ``values`` (array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    # The DataFrame goes to the JVM as it is; only the public constructor would send its rows through Python.
    wrapped = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, size))
    return wrapped.toBlockMatrix(ROWS, size)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times the matrix itself, its middle dimension cut into parts that are added up afterwards."""
    java = blocks._java_matrix_wrapper._java_model
    parts = min(java.numRowBlocks(), PARTS_PER_CORE * blocks.blocks.context.defaultParallelism)
    product = java.transpose().multiply(java, parts)
    return BlockMatrix(product, java.colsPerBlock(), java.colsPerBlock()).toLocalMatrix().toArray()


def projected(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """index, values: the rows times a small matrix, as block matrices."""
    spark_context = blocks.blocks.context
    d, k = matrix.shape
    small = BlockMatrix(spark_context.parallelize([((0, 0), DenseMatrix(d, k, matrix.ravel(order="F")))], 1), d, k, d, k)
    product = blocks.multiply(small).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per row and component."""
    kinds = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    table, n, size = indexed(rows, vector)
    if not n or not size:
        return rows.sparkSession.createDataFrame([], kinds)
    total = sums(table, size)
    # Whole numbers up to the division, so that the centred values carry one rounding.
    wide = lambda x: x.cast("decimal(38,0)")
    gap = lambda x, s: x * F.lit(n) - s
    held = float(np.abs(total).max()) < 2**62 and n < 2**30
    gaps = F.zip_with("x", F.lit(total), gap if held else (lambda x, s: wide(x) * F.lit(n) - wide(s)))
    centred = table.select("index", F.transform(gaps, lambda g: g.cast("double") / float(n)).alias("values"))
    blocks = to_blocks(centred, n, size)
    v = scatter(blocks) / n
    e, axes = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[:components]
    e, axes, trace = e[order], axes[:, order], float(np.trace(v))
    useful = e > FLAT * trace
    scaled = axes / np.sqrt(np.where(useful, e, 1.0))
    values = written(projected(blocks, scaled), "whitening-values")
    error = None
    if useful.any():
        z = F.col("values")
        mean = values.agg(*[F.avg(z[i]).alias(f"m{i}") for i in range(len(e))]).first()
        level = values.select("index", F.array(*[z[i] - F.lit(mean[i]) for i in range(len(e))]).alias("values"))
        covariance = scatter(to_blocks(level, n, len(e))) / n
        error = float(np.abs(covariance - np.eye(len(e)))[np.ix_(useful, useful)].max())
    # The square of a gap may need more than a long before the sum does.
    deviation = F.aggregate(F.transform(gaps, lambda g: F.try_multiply(wide(g), wide(g))), F.lit(0).cast("decimal(38,0)"), lambda a, g: F.try_add(a, g).cast("decimal(38,0)"))
    both = table.withColumn("deviation", deviation.try_cast("bigint")).select("index", "vec_id", "deviation").join(values, "index")
    each = F.transform(
        F.lit(np.arange(len(e), dtype=np.int32)),
        lambda i: F.struct(
            (i + 1).alias("component"),
            F.when(F.get(F.lit(useful), i), F.get("values", i)).alias("whitened"),
            F.get(F.lit(e / trace if trace > 0 else np.full(len(e), np.nan)), i).alias("explained"),
        ),
    )
    flat = both.select("vec_id", "deviation", F.inline(each))
    return flat.select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error")
    )
