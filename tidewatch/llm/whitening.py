"""Whitening of vectors with Spark MLlib's BlockMatrix.

Centred rows are indexed into distributed blocks; the transposed blocks times the blocks
give the scatter, whose eigenvectors are found locally (it has one row per component of a
vector); the blocks times the whitening matrix are the projected rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.common import written
from tidewatch.llm.vectors import batch_map, integer_rows, lists

BLOCK_ROWS = 1024
#: Eigenvalues below this share of the largest count as zero.
NOTHING = 1e-12


def _sums(rows: DataFrame, column: str, kind: str) -> tuple[int, list]:
    """Number of rows and the exact (long) sum of an array column by position; one row per task is added up."""

    def partial(batches):
        n, total = 0, 0
        for batch in batches:
            n += batch.num_rows
            total = total + batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        if n:
            yield {"n": [n], "s": lists(np.asarray(total)[None])}

    tasks = batch_map(rows.select(column), partial, StructType.fromDDL(f"n long, s array<{kind}>"))
    each = tasks.select("n", F.posexplode("s").alias("place", "v"))
    # decimals, as the sum over all tasks may leave the range of a long
    got = each.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("place").collect()
    return (int(got[0]["n"]) if got else 0), [int(r["s"]) for r in got]


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """slot, at, vec_id, deviation and the centred vector y = (n * x - S) / n of every row.

    ``deviation`` is the exact sum of (n * x - S)^2, NULL where it does not fit into a long.
    """
    schema = StructType([rows.schema["slot"], rows.schema["at"], rows.schema["vec_id"], *StructType.fromDDL("deviation long, y array<double>").fields])
    exact = np.array(sums, dtype=object)

    def read(batches):
        names = ["slot", "at", "vec_id"]
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            # x - S // n is small, and so are the products with n that remain
            low = np.array([s // n for s in exact], dtype=np.int64)
            rest = np.array([s % n for s in exact], dtype=np.int64)
            y = (x - low) - rest / n
            size = float(n) * float(n) * (y * y).sum(axis=1).max(initial=0.0)
            if size < 2.0**61:
                gap = (x - low) * n - rest
                deviation = (gap * gap).sum(axis=1).tolist()
            else:
                each = [sum((int(v) * n - int(r)) ** 2 for v, r in zip(row, rest)) for row in (x - low)]
                deviation = [d if d < 1 << 63 else None for d in each]
            yield {c: batch.column(i) for i, c in enumerate(names)} | {"deviation": deviation, "y": lists(y)}

    return batch_map(rows.select("slot", "at", "vec_id", "x"), read, schema)


def blocks_of(rows: DataFrame, index: str, vector: str) -> BlockMatrix:
    """Rows (index, array of doubles) as a distributed matrix of blocks; an index that is missing is a row of zeros."""
    wide = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(wide).toBlockMatrix(BLOCK_ROWS, BLOCK_ROWS)


def scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """transpose(blocks) x blocks, as a local matrix.

    Without splits of the dimension that both share (the rows), a product as small as this
    would be one task's; Python's ``multiply`` does not have the argument.
    """
    model = blocks._java_matrix_wrapper
    product = model._java_model.transpose().multiply(model._java_model, splits)
    local = product.toLocalMatrix()
    return np.array(local.toArray()).reshape(local.numCols(), local.numRows()).T


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors over the square roots of their eigenvalues as columns;
    zeros where an eigenvalue is zero. Each eigenvector's component of largest size is positive."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    usable = e > NOTHING * max(e.max(initial=0), 0)
    return e, np.where(usable, v / np.sqrt(np.where(usable, e, 1)), 0.0)


def covariance(rows: DataFrame, column: str) -> np.ndarray:
    """Covariance (divisor n) of an array column. Each task centres its own rows, and tasks are merged with
    the differences of their means."""

    def partial(batches):
        n, mean, within = 0, 0.0, 0.0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            if not len(x):
                continue
            m, own = len(x), x.mean(axis=0)
            gap = own - mean
            within = within + (x - own).T @ (x - own) + np.outer(gap, gap) * (n * m / (n + m))
            n, mean = n + m, mean + gap * (m / (n + m))
        if n:
            yield {"n": [n], "mean": lists(mean[None]), "within": lists(within.reshape(1, -1))}

    tasks = written(batch_map(rows.select(column), partial, StructType.fromDDL("n long, mean array<double>, within array<double>")))
    means = tasks.select("n", F.posexplode("mean").alias("place", "m")).groupBy("place").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    mean = np.array([r["mean"] for r in means.orderBy("place").collect()])
    k = len(mean)
    gaps = F.transform("mean", lambda m, i: m - F.element_at(F.lit(mean.tolist()), i + 1))
    between = F.flatten(F.transform("gap", lambda a: F.transform("gap", lambda b: a * b * F.col("n"))))
    parts = tasks.withColumn("gap", gaps).select("n", F.posexplode(F.zip_with("within", between, lambda a, b: a + b)).alias("place", "v"))
    got = parts.groupBy("place").agg((F.sum("v") / F.sum("n")).alias("c")).orderBy("place").collect()
    return np.array([r["c"] for r in got]).reshape(k, k)


def _block_rows(projected: BlockMatrix, width: int, spark: SparkSession) -> DataFrame:
    """index and w (array of ``width`` doubles) of a matrix that is one block wide."""
    return spark.createDataFrame(
        projected.blocks.flatMap(lambda b: ((b[0][0] * BLOCK_ROWS + i, row) for i, row in enumerate(b[1].toArray()[:, :width].tolist()))),
        "index long, w array<double>",
    )


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components of a vector become x = floor(scale * c) + shift. Rows whose vector is NULL or holds
    a NULL or non-finite component are dropped, as are those of another length than most (see
    ``integer_rows``, also for the range of components). Repeated ids and rows count like any
    other. There are as many components as a vector has, up to ``components`` (at most 1024).
    Where an eigenvalue is zero, ``whitened`` is NULL and the component takes no part in
    ``identity_error``; ``explained`` is NULL if all vectors are equal. ``identity_error`` is
    measured on the projected rows. Whitened values of a component are defined up to its sign,
    and components of equal eigenvalues up to a rotation.
    """
    spark = vectors.sparkSession
    rows, dim = integer_rows(vectors, vector, scale, shift, ["vec_id"])
    components = min(components, dim)
    n, sums = _sums(rows, "x", "long")
    if not components or not n:
        schema = StructType([rows.schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
        return spark.createDataFrame([], schema)
    # every slot has room for the fullest one, so that indexes need no cumulated counts; gaps are rows of zeros
    room = rows.agg(F.max("at")).first()[0] + 1
    ready = written(centred(rows, n, sums).withColumn("index", F.col("slot") * F.lit(room) + F.col("at")))
    blocks = blocks_of(ready, "index", "y")
    v = scatter(blocks, max(1, ready.rdd.getNumPartitions())) / n
    e, w = whitening_matrix(v, components)
    local = spark.createDataFrame([(i, row) for i, row in enumerate(w.tolist())], "index long, v array<double>")
    projected = written(_block_rows(blocks.multiply(blocks_of(local, "index", "v")), components, spark))
    found = written(ready.select("index", "vec_id", "deviation").join(projected, "index"))
    usable = [k for k in range(components) if w[:, k].any()]
    error = None
    if usable:
        c = covariance(found, "w")[np.ix_(usable, usable)]
        error = float(np.abs(c - np.eye(len(usable))).max())
    trace = float(np.trace(v))
    known = [(float(e[k]) / trace if trace else None, k in usable) for k in range(components)]
    shares = F.array(*[F.lit(s).cast("double") for s, _ in known])
    whole = F.array(*[F.lit(u) for _, u in known])
    out = found.select("vec_id", "deviation", F.posexplode("w").alias("place", "value"))
    at = F.col("place") + 1
    return out.select(
        "vec_id", at.cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.element_at(whole, at), F.col("value")).alias("whitened"),
        F.element_at(shares, at).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
