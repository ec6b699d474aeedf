"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows form a matrix X, one row a vector less the mean. Bidiagonalisation gives X V = U B with
orthonormal V and U and a small upper bidiagonal B, by alternating products: u from X v, the next v from
the transpose times u. The singular vectors of B turn V into the components, its singular values are the
deviations times the root of the row count.

One pass over the rows does both products of a step. A row's entry of the left vector is the row's product
with a small vector: u = X w, and by the recurrence w = (v - beta w') / alpha. So left vectors are never
written or gathered; tasks compute their entries, multiply by the rows again and send sums of one number per
dimension, which Spark adds up. The left vectors' inner products, needed to reorthogonalise them, follow from
the sums of earlier steps; both sides are reorthogonalised against all earlier vectors, twice.

A step whose remainder vanishes has found an invariant subspace; the next one starts from a fresh vector
orthogonal to it, so equal deviations are all found. Steps go on until the wanted components are exact to
double precision and what is left of the total variance is less than the last one's; at most one step per
dimension is needed.

Entries are whole numbers, floor(64 c) + 1,000,000, and centring is exact: n x - S in whole numbers,
divided by n. The fit takes every row that is left, in any number of files.

Defined cases. Rows are dropped whose vector is null or holds a null, a non-finite entry or one beyond
2^45 (which has no exact place on the grid), or has another length than most vectors have (ties: the longer
one). Repeated rows and ids count again; a null id stays. Components of no variance (below ``NOTHING`` of
the largest) cannot be whitened and are left out: equal vectors, one vector or an empty table give no rows.
A squared deviation beyond 2^63 is exact in ``whiten`` (decimal) and an error in the contract's long column.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

COMPONENTS = 32
GRID, OFFSET = 64, 1_000_000
LARGEST = float(2**45)
NOTHING = 1e-13
EXACT = 1e-14  # remainder of a component against the largest deviation
SEED = 12


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole-number entries of the rows that take part."""
    entries = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    # NaN is larger than any number in comparisons
    good = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False)))
    x = F.transform(entries, lambda c: F.floor(c * GRID).cast("bigint") + OFFSET)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (sizes.d if sizes else 0))


class Rows:
    """The rows' count, sums and passes over them; all that reaches the driver has a length of some dimensions."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        first = rows.select(F.size("x").alias("d")).first()
        self.d = first.d if first else 0
        if not self.d:
            self.n = 0
            return
        at = [F.col("x")[i] for i in range(self.d)]
        ends = [f(c) for c in at for f in (F.min, F.max)]
        found = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in at], *ends).first()
        self.n, self.sums = found[0], [int(s) for s in found[1 : 1 + self.d]]
        bounds = found[1 + self.d :]
        reach = [max(self.n * hi - s, s - self.n * lo) for s, lo, hi in zip(self.sums, bounds[::2], bounds[1::2], strict=True)]
        #: whether (n x - S) and the sum of its squares are exact in 64 bits
        self.narrow = max(reach) < 2**62 and self.n * max(map(abs, bounds)) < 2**62
        self.squares_fit = sum(r * r for r in reach) < 2**63

    def whole(self):
        """The function of a batch that gives the matrix n x - S: exact whole numbers."""
        d, n, sums, narrow = self.d, self.n, self.sums, self.narrow

        def apply(batch: pa.RecordBatch) -> np.ndarray:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            return x * n - np.array(sums, np.int64) if narrow else x.astype(object) * n - np.array(sums, object)

        return apply

    def centred(self):
        whole, n = self.whole(), self.n
        return lambda batch: whole(batch).astype(np.float64) / n

    def total(self, apply, size: int) -> np.ndarray:
        """The sum of a function of centred matrices that gives ``size`` numbers: one sum per task, added by Spark."""
        centred = self.centred()

        def run(batches):
            held = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    held += apply(centred(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(held)], names=["place", "part"])

        parts = self.rows.select("x").mapInArrow(run, "place int, part double")
        added = np.zeros(size)
        for r in parts.groupBy("place").agg(F.sum("part").alias("total")).collect():
            added[r.place] = r.total
        return added

    def products(self, y: np.ndarray) -> tuple[np.ndarray, float, float]:
        """One pass: t = X y in the tasks; back come the transpose times t, the squares of t and of all entries."""

        def apply(x):
            t = x @ y
            return np.concatenate([t @ x, [t @ t, np.einsum("ij,ij->", x, x)]])

        found = self.total(apply, self.d + 2)
        return found[:-2], float(found[-2]), float(found[-1])


def _clear(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` less its parts along orthonormal vectors, taken off twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            vector = vector - (q @ vector) @ q
    return vector


def bidiagonalise(products, d: int, wanted: int):
    """(components, squared singular values, total): rows of components by falling value.

    ``products(y)`` gives (transpose times X y, squares of X y, squares of X).
    """
    draw = np.random.default_rng(SEED)
    right: list[np.ndarray] = []  # v
    weights: list[np.ndarray] = []  # w, with u = X w
    returned: list[np.ndarray] = []  # transpose times u
    kept: list[int] = []  # steps that have a left vector
    alphas, betas = [], []

    def fresh():
        for _ in range(8):
            v = _clear(draw.standard_normal(d), right)
            if np.linalg.norm(v) > 1e-8:
                return _clear(v / np.linalg.norm(v), right)
        return None

    v, beta, total = fresh(), 0.0, 0.0
    while v is not None and len(right) < d:
        v = v / np.linalg.norm(v)
        y = v - beta * weights[-1] if beta else v
        back, squares, total = products(y)
        size = max(total, np.finfo(float).tiny) ** 0.5
        for _ in range(2):  # take off the parts along earlier left vectors: inner products from their sums
            for k in kept:
                along = weights[k] @ back
                y, back = y - along * weights[k], back - along * returned[k]
                squares -= along * along
        alpha = max(squares, 0.0) ** 0.5
        right.append(v)
        if alpha <= 1e-12 * size:  # the row space ends here: this direction has no variance
            weights.append(np.zeros(d))
            returned.append(np.zeros(d))
            alphas.append(0.0)
            rest = np.zeros(d)
        else:
            kept.append(len(weights))
            weights.append(y / alpha)
            returned.append(back / alpha)
            alphas.append(alpha)
            rest = _clear(returned[-1] - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if beta > 1e-13 * size:
            v = rest / beta
        else:
            v, beta = fresh(), 0.0
        betas.append(beta)
        if len(right) >= min(wanted, d):
            left, values, turned = np.linalg.svd(_bidiagonal(alphas, betas))
            remainders = betas[-1] * np.abs(left[-1, :wanted])
            last = values[min(wanted, len(values)) - 1] ** 2
            if (remainders <= EXACT * values[0]).all() and total - (values**2).sum() < last:
                break
    if not right:
        return np.zeros((0, d)), np.zeros(0), 0.0
    left, values, turned = np.linalg.svd(_bidiagonal(alphas, betas))
    return turned @ np.array(right), values**2, total


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that takes part.

    ``deviation`` is a decimal; see the module's text for the rest.
    """
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = Rows(materialize(grid(vectors), "grid"))
    if rows.n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    axes, squares, total = bidiagonalise(rows.products, rows.d, components)
    found = min(components, int((squares > NOTHING * max(squares[0], np.finfo(float).tiny)).sum())) if total else 0
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    turn = axes[:found].T / np.sqrt(squares[:found] / rows.n)
    explained = squares[:found] / total
    error = _identity_error(rows, turn)
    whole, n, narrow = rows.whole(), rows.n, rows.squares_fit and rows.narrow

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch)
            if narrow:
                apart = pa.array(np.repeat(np.einsum("ij,ij->i", x, x), found)).cast(pa.decimal128(38, 0))
            else:
                apart = pa.array([v for r in x.astype(object) for v in [int((r * r).sum())] * found], pa.decimal128(38, 0))
            m = len(x)
            whitened = (x.astype(np.float64) / n) @ turn
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), found))),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * found, n, np.int64)),
                    apart,
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * found, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.rows.mapInArrow(run, schema)


def _identity_error(rows: Rows, turn: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, from a pass over them."""
    m = turn.shape[1]
    upper = np.triu_indices(m)

    def apply(x):
        z = x @ turn
        return np.concatenate([(z.T @ z)[upper], z.sum(axis=0)])

    found = rows.total(apply, len(upper[0]) + m)
    means = found[-m:] / rows.n
    return float(np.abs(found[:-m] / rows.n - means[upper[0]] * means[upper[1]] - (upper[0] == upper[1])).max())


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    return whiten(vectors).withColumn("deviation", F.col("deviation").cast("bigint"))
