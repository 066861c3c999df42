"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers. The distinct vectors, each once, are the fit list: centred, indexed without gaps and cut into the
blocks of a ``BlockMatrix``, whose transpose times itself is the scatter. Its eigenvectors are found on the driver (a matrix of
dimension by dimension, whatever the number of rows), and a second product, rows times whitening matrix, projects all rows.

The inner dimension of the scatter product is the number of rows, and its result is one small block, so the product is dealt out
over splits of the inner dimension and the partial scatters are added up. A slab of at most ``SLAB`` rows is one product: the
driver plans a product by the coordinates of its blocks, and this bounds how many there are.

Rows take no part if their vector is null, is empty, holds a null or non-finite entry or one too large for a whole number of
64 bits, or has another length than most vectors (of equally frequent lengths the largest is kept). Repeated rows and rows
without id are answered like all others. Components whose variance is zero to double precision have no unit
variance and aren't returned, so a table with a single distinct vector gives no rows, and neither does an empty one. A deviation
beyond 64 bits is null. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows and columns of a block, rows of a slab, blocks that one task of a product takes.
ROWS, COLUMNS, SLAB, TOGETHER = 1024, 1024, 1 << 26, 8


@dataclass(frozen=True)
class Fit:
    """What a fit list says: its length, the sums of its dimensions, all eigenvalues, and the matrix that whitens."""

    n: int
    sums: list[int]
    values: np.ndarray
    matrix: np.ndarray


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and x, the whole numbers, of the rows that take part."""
    entry = F.col(vector).cast("array<double>")
    fits = F.forall(entry, lambda c: F.coalesce(F.abs(c) < 2.0**56, F.lit(False)))  # false for null, NaN and infinity
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fits)
    return rows.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a stored table with ``part`` and ``at``, of which :func:`parts` makes gapless numbers."""
    at = F.monotonically_increasing_id()
    return stored(rows.withColumn("at", at), label).withColumn("part", F.shiftright("at", 33))


def parts(rows: DataFrame) -> DataFrame:
    """What turns ``at`` into a gapless index in each part: as many rows as the stored table has parts."""
    counts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Length and exact sums per dimension: a row per dimension and batch is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            if len(x):
                high, low = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)  # no overflow for any batch
                dims = pa.array(range(x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([dims, pa.array([len(x)] * x.shape[1], pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["dim", "n", "high", "low"])

    partial = fit.select("x").mapInArrow(run, "dim int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    sums = partial.groupBy("dim").agg(F.sum("n").alias("n"), *wide).orderBy("dim").collect()  # one row per dimension
    return (sums[0]["n"], [(int(r["high"]) << 20) + int(r["low"]) for r in sums]) if sums else (0, [])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks(rows: DataFrame, n: int, sums: list[int], label: str) -> DataFrame:
    """The rows, centred, in stored blocks: block, size, values (bytes of a row-major matrix), vec_ids, deviations.

    ``rows`` has vec_id, x, part and at. Their gapless index says which block they belong to. Entries are centred exactly: with c the
    mean rounded to a whole number, n * x - S is n * (x - c) - (S - n * c), in which all numbers are small. A deviation is the sum of
    the squares of these, null beyond 64 bits.
    """
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, near)]
    offsets = parts(rows)
    indexed = rows.join(F.broadcast(offsets), "part").select("vec_id", "x", (F.col("at") + F.col("shift")).alias("index"))
    dealt = indexed.withColumn("block", F.expr(f"index div {ROWS}")).repartitionByRange("block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        x = matrix(table["x"].combine_chunks())
        y = x - np.array(near, np.int64)
        most = n * int(np.abs(y).max(initial=0)) + n
        if len(sums) * most * most < 2**63:
            deviations = np.square(n * y - np.array(rest, np.int64)).sum(axis=1).tolist()
        else:
            exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
            deviations = [d if d < 2**63 else None for d in exact]
        values = y - np.array(rest, np.float64) / n
        made = [key[0].as_py(), len(y), values.tobytes(), table["vec_id"].to_pylist(), deviations]
        return pa.table([pa.array([v], kind) for v, kind in zip(made, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["block", "size", "values", "vec_ids", "deviations"])

    schema = "block long, size int, values binary, vec_ids array<long>, deviations array<long>"
    return stored(dealt.groupBy("block").applyInArrow(run, schema), label)


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Blocks (block, size, values) as a distributed matrix of n rows; the blocks count from 0."""

    def cut(row) -> list:
        values = np.frombuffer(row["values"]).reshape(row["size"], width)
        return [((row["block"], k), _dense(values[:, k * COLUMNS : (k + 1) * COLUMNS])) for k in range(-(-width // COLUMNS))]

    made = BlockMatrix(rows.select("block", "size", "values").rdd.flatMap(cut), ROWS, COLUMNS, n, width)
    return made.persist(StorageLevel.MEMORY_AND_DISK)


def _dense(values: np.ndarray) -> DenseMatrix:
    return Matrices.dense(*values.shape, values.ravel(order="F"))


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, its inner dimension dealt out over ``splits`` groups of tasks, whose partial products are added."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def slabs(rows: DataFrame, n: int) -> Iterator[tuple[DataFrame, int, int]]:
    """The blocks slab by slab, counted from 0 in each: the blocks, their rows and the number of the first."""
    step = max(1, SLAB // ROWS)
    for first in range(0, -(-n // ROWS), step):
        inside = rows.where(F.col("block").between(first, first + step - 1)).withColumn("block", F.col("block") - first)
        yield inside, min(n - first * ROWS, step * ROWS), first


def scatter(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The sum over all rows of the outer product of a row with itself."""
    total = np.zeros((width, width))
    for inside, count, _ in slabs(rows, n):
        made = block_matrix(inside, count, width)
        total += times(made.transpose(), made, math.ceil(made.numRowBlocks / TOGETHER)).toLocalMatrix().toArray()
    return total


def fitted(fit: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame | None]:
    """What a fit list of distinct vectors (vec_id, x, part, at) says, and its centred blocks."""
    n, sums = totals(fit)
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0))), None
    around = blocks(fit, n, sums, "whitening-fit-blocks")
    values, vectors = np.linalg.eigh(scatter(around, n, len(sums)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(components, len(sums))) if values[k] > max(0.0, values[0]) * len(sums) * np.finfo(float).eps]
    return Fit(n, sums, values, vectors[:, kept] / np.sqrt(values[kept])), around


def projected(rows: DataFrame, n: int, whitening: np.ndarray) -> DataFrame:
    """block, size and values of the product of the blocks and the whitening matrix."""
    spark, (width, k) = rows.sparkSession, whitening.shape
    pieces = [((r, 0), _dense(whitening[r * COLUMNS : (r + 1) * COLUMNS])) for r in range(-(-width // COLUMNS))]
    out = None
    for inside, count, first in slabs(rows, n):
        right = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), COLUMNS, k, width, k)
        product = times(block_matrix(inside, count, width), right, 1)

        def flat(item, first=first) -> tuple:
            (block, _), values = item
            return block + first, values.numRows, values.toArray().tobytes()

        made = spark.createDataFrame(product.blocks.map(flat), "block long, size int, values binary")
        out = made if out is None else out.unionByName(made)
    return out


def identity_error(around: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, from the whitened rows themselves."""
    k = model.matrix.shape[1]
    white = stored(projected(around, model.n, model.matrix), "whitening-fit-whitened")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum((np.frombuffer(v).reshape(-1, k).sum(axis=0) for v in batch.column("values").to_pylist()), np.zeros(k))
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["at", "total"])

    sums = white.select("values").mapInArrow(added, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    mean = np.array([r["total"] for r in sums]) / model.n

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [(np.frombuffer(v).reshape(-1, k) - mean).tobytes() for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("size"), pa.array(values, pa.binary())], names=["block", "size", "values"])

    apart = white.mapInArrow(less, "block long, size int, values binary")
    return float(np.abs(scatter(apart, model.n, k) / model.n - np.eye(k)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row that takes part and each component."""
    spark = vectors.sparkSession
    rows = numbered(whole(vectors, key, vector), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).take(2)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    if len(lengths) > 1:
        rows = numbered(rows.where(F.size("x") == lengths[0]["size"]).select("vec_id", "x"), "whitening-rows-of-one-length")
    fit = numbered(rows.select("x").distinct().withColumn("vec_id", F.lit(None).cast("long")), "whitening-distinct")
    model, around = fitted(fit, components)
    k = model.matrix.shape[1]
    if not k:
        return spark.createDataFrame([], schema)
    error, explained = identity_error(around, model), model.values[:k] / model.values.sum()
    every = blocks(rows, model.n, model.sums, "whitening-blocks")
    total = every.agg(F.sum("size").cast("long")).first()[0]
    found = projected(every, total, model.matrix).select("block", F.col("values").alias("white")).join(every.select("block", "vec_ids", "deviations"), "block")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for white, ids, deviations in zip(*(batch.column(c) for c in ("white", "vec_ids", "deviations"))):
                values = np.frombuffer(white.as_py())
                count = len(values) // k
                each = np.repeat(np.arange(count), k)
                arrays = [
                    ids.values.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                    pa.array(np.full(len(values), model.n), pa.int64()),
                    deviations.values.take(pa.array(each)),
                    pa.array(values),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(len(values), error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.select("white", "vec_ids", "deviations").mapInArrow(rows_of, schema)
