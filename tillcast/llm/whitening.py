"""Embedding whitening by shifted Cholesky QR.

The centred rows A of all vectors are orthogonalised by passes over the table. A pass sends every row through
triangular solves with the factors found so far and adds up the Gram matrix of what comes out; the Cholesky factor of
that matrix is the next factor. The first Gram matrix is shifted by a multiple of rounding, which keeps its factor
defined however badly conditioned A is; the passes after it bring the columns back to orthogonal to double
precision. The product R of the factors has A = QR, so the singular values and right vectors of R are those of A: they
give the components and their variances without a covariance matrix being squared.

Tasks hold one batch of rows and the factors, the driver the factors: matrices of the vector's length squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.rows import table
from tillcast.session import materialize

COMPONENTS = 8
# Fixed values of the contract: entries become whole numbers by this scale and offset.
SCALE, OFFSET = 1024, 100_000
MOST_PASSES = 8
BATCH = 4096
_LONG = 2**63


def _finite(vector: str):
    """Not null, not empty, and every entry a number with a whole number of 64 bits (below about 9e15)."""
    bound = float(2**63) / SCALE - OFFSET
    entries = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < bound, F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & entries, F.lit(False))


def usual_length(vectors: DataFrame, vector: str = "embedding") -> int:
    """The number of entries that most finite vectors have, the larger of two that equally many have; 0 without any."""
    lengths = vectors.where(_finite(vector)).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.agg(F.max(F.struct("n", "size"))["size"]).first()[0]
    return found or 0


def usable(vectors: DataFrame, length: int, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has ``length`` entries, none of them null or non-finite."""
    return vectors.where((F.size(vector) == length) & _finite(vector))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a batch as whole numbers; the vectors have one length."""
    entries = np.asarray(column.flatten().cast(pa.float64()))
    return (np.floor(SCALE * entries.reshape(len(column), -1)) + OFFSET).astype(np.int64)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S without rounding; Python integers where 64 bits do not hold it."""
    if n * max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1) < _LONG // 4:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn, by forward substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


@dataclass(frozen=True)
class Whitening:
    """What the passes found: n vectors with sums S, the factor R, components (columns) with variances e."""

    n: int
    sums: list[int]
    factor: np.ndarray
    directions: np.ndarray
    variances: np.ndarray

    @property
    def explained(self) -> list[float | None]:
        """Share of each component in the trace of the covariance; none where there is no variance."""
        trace = float(self.variances.sum())
        return [float(e) / trace if trace > 0 else None for e in self.variances]

    @property
    def rank(self) -> int:
        """Components whose deviation is more than rounding."""
        if not len(self.variances):
            return 0
        deviations = np.sqrt(self.variances)
        return int((deviations > deviations[0] * len(deviations) * np.finfo(float).eps).sum())


def _gram(rows: DataFrame, vector: str, n: int, sums: list[int], factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the solved rows: one sum per place and task, added up by the engine."""
    shared = rows.sparkSession.sparkContext.broadcast((n, sums, factors))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, factors = shared.value
        size = len(sums)
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0).slice(at, BATCH))
                q = _solved(_differences(x, n, sums).astype(np.float64) / n, factors)
                total += q.T @ q
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"]
        )

    parts = rows.select(vector).mapInArrow(summed, "i int, j int, g double")
    out = np.zeros((len(sums), len(sums)))
    for r in parts.groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow().to_pylist():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def fit(vectors: DataFrame, vector: str = "embedding") -> Whitening:
    """Shifted Cholesky QR over all finite vectors of the usual length, a pass over the table for each factor."""
    rows = usable(vectors, usual_length(vectors, vector), vector)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0).slice(at, BATCH))
                wide = int(np.abs(x).max(initial=0)) * len(x) >= _LONG // 4
                part = x.astype(object).sum(0) if wide else x.sum(0).astype(object)
                n, sums = n + len(x), part if sums is None else sums + part
        if n:
            at = pa.array(range(-1, len(sums)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [at, pa.array([Decimal(int(s)) for s in [n, *sums]], pa.decimal128(38, 0))], ["at", "s"]
            )

    found = rows.select(vector).mapInArrow(counted, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s"))
    sums = {r["at"]: int(r["s"]) for r in found.collect()}
    n = sums.pop(-1, 0)
    sums = [sums[at] for at in range(len(sums))]
    size, eps = len(sums), np.finfo(float).eps
    # How far a Gram matrix may be from a projector: rounding of its sums.
    near = eps * max(100 * size, n**0.5)
    factors, whole, gram = [], np.eye(size), np.zeros((size, size))
    while size and len(factors) < MOST_PASSES:
        gram = _gram(rows, vector, n, sums, factors)
        values, vectors = np.linalg.eigh(gram)
        if values[-1] <= 0 or factors and np.abs(gram @ gram - gram).max() < near:
            break
        if factors:
            # Directions that hold nothing but rounding keep a factor of one, so that the others have theirs exactly.
            nothing = vectors[:, values < near]
            definite = gram + nothing @ nothing.T
        else:
            definite = gram + 11 * (n * size + size * (size + 1)) * (eps / 2) * values[-1] * np.eye(size)
        factors.append(np.linalg.cholesky(definite).T)
        whole = factors[-1] @ whole
    # The last Gram matrix is the identity, and zero in directions without variance, where Q has no rows.
    _, singular, right = np.linalg.svd(gram @ whole) if size else (None, np.zeros(0), np.zeros((0, 0)))
    return Whitening(n, sums, gram @ whole, right.T, singular**2 / max(n, 1))


def whiten(
    vectors: DataFrame, model: Whitening, vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """The rows of ``vectors`` that are ``usable`` with the fitted length, with ``whitened`` and ``deviation``.

    ``whitened`` holds the centred vector's coordinates on the first components, each over the root of its variance
    (as many as the vector has entries at most); null on a component without variance, as where all vectors are equal.
    ``deviation`` is the exact sum of (n*x - S)^2, null where a long does not hold it. Vectors of another length
    are left out, as are null vectors and those with null or non-finite entries. Repeated rows stay repeated, a null key is a key. Columns already named like the two
    are replaced, all others passed through. An empty table gives an empty one.
    """
    rest = vectors.drop("whitened", "deviation")
    count = min(components, len(model.sums))
    # Components without variance have no coordinates.
    live = min(count, model.rank)
    scaled = model.directions[:, :live] / np.sqrt(model.variances[:live])
    shared = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, scaled))
    names = rest.columns
    place = names.index(vector)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scaled = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                diff = _differences(_matrix(batch.column(place)), n, sums)
                real = diff.astype(np.float64)
                if float((real * real).sum(1).max()) < _LONG // 2 and diff.dtype != object:
                    squares = pa.array((diff * diff).sum(1))
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in diff]
                    squares = pa.array([e if e < _LONG else None for e in exact], pa.int64())
                coordinates = np.full((len(diff), count), np.nan)
                coordinates[:, : scaled.shape[1]] = (real / n) @ scaled
                flat = coordinates.ravel()
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(flat) + 1, count), pa.int32()), pa.array(flat, mask=np.isnan(flat))
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, squares], [*names, "whitened", "deviation"])

    kept = usable(rest, len(model.sums), vector)
    added = [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    schema = T.StructType([*rest.schema.fields, *added])
    return kept.mapInArrow(whitened, schema)


def identity_error(rows: DataFrame, components: int) -> DataFrame:
    """One row: the largest entry of |covariance of ``whitened`` - identity| over the components with variance."""
    entries = [
        F.abs(F.covar_pop(F.get("whitened", i), F.get("whitened", j)) - (1.0 if i == j else 0.0))
        for i in range(components) for j in range(i, components)
    ]
    return rows.agg(F.greatest(F.lit(0.0), *entries).alias("identity_error") if entries else F.lit(0.0))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    rows = materialize(whiten(vectors, model).select("vec_id", "deviation", "whitened"), "whitened")
    explained = model.explained[:COMPONENTS]
    shares = F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>")
    error = identity_error(rows, len(explained)).scalar()
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), error.alias("identity_error"),
    )
