"""Whitening of embeddings: principal components by MLlib's singular values of the centred rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import Staged, ship_package, tidy
from phrasepivot.llm.topk import scaled

#: Singular values below this share of the largest count as none: their squares, which a Gram matrix has, are near its rounding.
LEAST_SINGULAR = 4e-6
#: Dimensions of which MLlib decomposes a whole Gram matrix.
WHOLE_GRAM = 15_000
_WIDE = "decimal(38,0)"


def _matrix(rows: DataFrame, column: str) -> RowMatrix:
    """A distributed matrix of a column of arrays of doubles, without Python workers."""
    vectors = rows.select(array_to_vector(F.col(column)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"))


@dataclass(frozen=True)
class Components:
    """n rows were fitted.  values: eigenvalues of the covariance (divisor n), falling; vectors: a unit vector in each
    column; total: the covariance's trace."""

    n: int
    values: np.ndarray
    vectors: np.ndarray
    total: float


def fit_components(centred: DataFrame, n: int, dims: int, deviations: DataFrame, components: int) -> Components:
    """centred: column y, rows less their mean.  deviations: column deviation, the sum of (n * x - S)^2 of each row.

    All dims singular values are asked for, up to WHOLE_GRAM: MLlib then decomposes the Gram matrix, which executors
    sum, as a whole and not by iterations that stop at a tolerance.  An eigenvalue is a singular value squared over n.  The total variance
    is the deviations' sum over n cubed, so it rests on no eigenvalue."""
    # beyond 38 digits of their sum, deviations are summed as doubles
    sums = deviations.agg(F.try_sum("deviation").alias("exact"), F.count("deviation").alias("known"), F.sum(F.col("rough")).alias("rough")).first()
    exact = int(sums.exact) if sums.exact is not None and sums.known == n else None
    total = (exact / n**3) if exact is not None else sums.rough / n**3
    if not total > 0:  # rows are all alike
        return Components(n, np.zeros(0), np.zeros((dims, 0)), 0.0)
    asked = dims if dims <= WHOLE_GRAM else components
    found = _matrix(centred, "y").computeSVD(asked, computeU=False, rCond=LEAST_SINGULAR)
    singular, vectors = found.s.toArray(), found.V.toArray()
    kept = min(components, int((singular > LEAST_SINGULAR * singular[0]).sum()))
    return Components(n, singular[:kept] ** 2 / n, vectors[:, :kept], total)


def _projecting(sent):
    """Of batches of (id, deviation, y): id, deviation, and y on every component over its spread."""

    def run(batches):
        import pyarrow as pa

        onto = sent.value
        for b in batches:
            y = np.asarray(b.column(2).flatten()).reshape(b.num_rows, onto.shape[0])
            z = np.ascontiguousarray(y @ onto).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) + 1, onto.shape[1], dtype=np.int32)), pa.array(z))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "deviation", "z"])

    return run


def identity_error(whitened: DataFrame, n: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of column z less the identity."""
    if n < 2:
        return 0.0
    covariance = _matrix(whitened, "z").computeCovariance().toArray() * ((n - 1) / n)  # MLlib divides by n - 1
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """The id, component (int, from 1 by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * c) + offset; all rows are fitted, n of them with sums S.  deviation is the sum over
    dimensions of (n * x - S)^2, exact, null where it passes 64 bits; whitened the row less the mean on the component
    over the root of its eigenvalue; explained the eigenvalue's share of the total variance; identity_error one value.

    Rows of a null vector, of a null or non-finite entry, or of one of which scale times is 2**62 or more are dropped.
    A null id is kept, and so are repeated rows, each on its own.  Shorter vectors count as padded with zeros.
    Components are at most as many as the rows' rank: rows that are all alike, a single row, vectors without entries
    and an empty table give an empty result.  Other columns are not read.

    The rows become one table in the shared folder, which is read for the sums, for the matrix and for the projection.
    The driver gets the sums and the components, dims by components numbers."""
    spark = vectors.sparkSession
    ship_package(spark)
    empty = spark.createDataFrame([], f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sound = vectors.select(F.col(id_col).alias("id"), scaled(F.col(vec_col), scale).alias("x")).where("x is not null")
    rows = Staged(spark, sound, "vectors").df
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dims = size.n, size.d or 0
    if not n or not dims:
        return empty
    sums = [n * offset] * dims  # what padding adds is in it
    for r in rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast(_WIDE)).alias("s")).collect():  # a row a dimension
        sums[r.pos] += int(r.s)
    padded = F.concat(F.transform("x", lambda v: v + offset), F.array_repeat(F.lit(offset).cast("long"), F.lit(dims) - F.size("x")))
    less = F.array(*(F.lit(str(s)).cast(_WIDE) for s in sums))
    y = F.zip_with(padded, less, lambda x, s: x.cast("decimal(19,0)") * F.lit(str(n)).cast("decimal(18,0)") - s)
    deviation = F.aggregate("y", F.lit(0).cast(_WIDE), lambda a, v: F.try_add(a, F.try_multiply(v.cast(_WIDE), v.cast(_WIDE))).cast(_WIDE))
    rough = F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    centred = rows.select("id", y.alias("y")).select("id", deviation.alias("deviation"), rough.alias("rough"), F.transform("y", lambda v: v.cast("double") / F.lit(float(n))).alias("y"))
    table = Staged(spark, centred, "centred").df
    fitted = fit_components(table, n, dims, table, components)
    if not len(fitted.values):
        return empty
    sent = spark.sparkContext.broadcast(fitted.vectors / np.sqrt(fitted.values))
    fits = F.when(F.col("deviation") <= F.lit(2**63 - 1), F.col("deviation")).cast("long")
    kind = vectors.schema[id_col].dataType.simpleString()
    projected = table.select("id", fits.alias("deviation"), "y").mapInArrow(tidy(_projecting(sent)), f"id {kind}, deviation long, z array<double>")
    whitened = Staged(spark, projected, "whitened").df
    error = identity_error(whitened, n)
    shares = F.array(*(F.lit(float(v / fitted.total)) for v in fitted.values))
    out = whitened.select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
