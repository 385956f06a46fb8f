"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X, n by d, lie in stored blocks. Each step multiplies twice in
one pass over the blocks: u = Xv and X'u. Left vectors u have a number for every
row, so they are not kept: u is X times a vector w of d numbers, and a task
makes the rows of U that it needs from its block and the w's. Every new u and v
is made orthogonal to all earlier ones, u once more by a second pass where less
than a tenth is left of it; what tasks hand back is sums of at most 2 d numbers. The singular values of the small bidiagonal matrix over the
root of n are the deviations, its right vectors the components.

Integers stay exact as long as they matter: centred entries are x - S/n from
whole numbers, and the deviation of a row is a whole number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtido.llm.common import map_rows, settled, stored_blocks, struct_of

_SHIFT = 1_000_000
_SUMS = dict(place="int", value="double")


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x``, floor(64 c) + 1000000 for each entry; without vectors that are null or hold null or non-finite entries."""
    c = F.col(vector_col).cast("array<double>")
    fine = F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), c.alias("c")).filter(F.col("c").isNotNull() & fine)
        .select("id", F.transform("c", _whole).alias("x"))
    )


def _whole(c: Column) -> Column:
    far = F.lit(float(1 << 61))
    return F.floor(F.least(F.greatest(c * 64, -far), far)) + F.lit(_SHIFT).cast("long")


def _blocks(valid: DataFrame, dims: int, rows_each: int) -> DataFrame:
    """Up to ``rows_each`` rows as one binary of ``dims`` whole numbers each; shorter vectors end in c = 0."""

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        ids, held = [], []
        for row_id, x in taken:
            ids.append(row_id)
            held.append(x + [_SHIFT] * (dims - len(x)))
            if len(ids) == rows_each:
                yield ids, np.array(held, dtype="<i8").tobytes()
                ids, held = [], []
        if ids:
            yield ids, np.array(held, dtype="<i8").tobytes()

    return map_rows(valid, rows, struct_of(ids="array<long>", rows="binary"))


class Centred:
    """Blocks of whole rows with their count n and sums S, and products with the rows x - S/n."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.dims = blocks, n, len(sums)
        # S = n * low + rest, so x - low is a whole number and x - S/n is off by the last bit at most.
        self.low, self.rest = ([f(s, n) for s in sums] for f in (lambda s, n: s // n, lambda s, n: s % n))

    def whole(self) -> Callable[[bytes], np.ndarray]:
        low = np.array(self.low, dtype=np.int64)
        return lambda stored: np.frombuffer(stored, "<i8").reshape(-1, len(low)) - low

    def rows(self) -> Callable[[bytes], np.ndarray]:
        """In a task: the centred rows of a block."""
        whole, rest = self.whole(), np.array(self.rest, dtype=np.float64) / self.n
        return lambda stored: whole(stored) - rest

    def summed(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all blocks of ``part`` of the centred rows; the driver gets as many numbers as it has."""
        centred = self.rows()

        def run(taken: Iterator[tuple]) -> Iterator[tuple]:
            total = None
            for (stored,) in taken:
                mine = part(centred(stored))
                total = mine if total is None else total + mine
            if total is not None:
                yield from enumerate(map(float, total.ravel()))

        found = map_rows(self.blocks.select("rows"), run, struct_of(**_SUMS)).groupBy("place").agg(F.sum("value")).collect()
        out = np.zeros(len(found))
        for place, value in found:
            out[place] = value
        return out

    def products(self, w: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """With u = X w: X'u, U'u for U = X times ``earlier``, and u'u."""
        def part(x: np.ndarray) -> np.ndarray:
            u = x @ w
            return np.concatenate([x.T @ u, (x @ earlier).T @ u, [u @ u]])

        found = self.summed(part)
        return found[: self.dims], found[self.dims : -1], float(found[-1])


def _fresh(basis: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``basis``, which leave some direction open."""
    away = np.eye(len(basis)) - basis @ basis.T
    v = away[:, np.argmax((away * away).sum(axis=0))]
    v = v - basis @ (basis.T @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(centred: Centred, wanted: int, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of the centred rows: the first ``wanted``.

    Steps go on until the bound of the residual of each wanted vector is below
    ``tolerance`` times the largest singular value, or the space is exhausted,
    at most as many steps as dimensions. Where a product leaves nothing new (few
    rows, rows in a subspace), the next v is any direction not yet taken.
    """
    d = centred.dims
    # Not along an axis, so that it has a part in every component, and the same in each run.
    v = np.random.default_rng(0).standard_normal(d)
    v /= np.linalg.norm(v)
    # Columns: the v's, the w's of the u's, and X'u for each u.
    right, left, back = (np.empty((d, 0)) for _ in range(3))
    b = np.zeros((d, d + 1))
    scale = 0.0
    while True:
        k = right.shape[1]
        right = np.column_stack([right, v])
        # u = Xv less its part in the earlier u's; once more where little is left of it.
        w = v
        for _ in range(2):
            product, inner, square = centred.products(w, left)
            w, product = w - left @ inner, product - back @ inner
            alpha = float(np.sqrt(max(0.0, square - inner @ inner)))
            if alpha > 0.1 * np.sqrt(square):
                break
        scale = max(scale, alpha)
        if alpha > 1e-13 * scale:
            w, product = w / alpha, product / alpha
        else:
            alpha, w, product = 0.0, np.zeros(d), np.zeros(d)
        left, back = np.column_stack([left, w]), np.column_stack([back, product])
        b[k, k] = alpha
        # v = X'u less its part in the earlier v's, twice.
        new = product - right @ (right.T @ product)
        new = new - right @ (right.T @ new)
        beta = float(np.linalg.norm(new))
        if k + 1 == d:
            break
        if beta > 1e-13 * scale:
            new = new / beta
        else:
            beta, new = 0.0, _fresh(right)
        b[k, k + 1] = beta
        p, sigma, _ = np.linalg.svd(b[: k + 1, : k + 1])
        if beta and k + 1 >= wanted and sigma[0] and (beta * np.abs(p[-1, :wanted])).max() <= tolerance * sigma[0]:
            break
        v = new
    k = right.shape[1]
    _, sigma, q = np.linalg.svd(b[:k, :k])
    return sigma[:wanted], (right @ q.T)[:, :wanted]


def whiten(vectors: DataFrame, components: int = 32, rows_each: int = 1024, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Rows on their principal components, each to unit deviation: one output row a vector and component.

    Entries c count as x = floor(64 c) + 1000000 (no farther than 2^61 from there). Columns: the
    id, ``component`` (from 1, by falling variance), ``n`` (vectors), ``deviation``
    (sum over dimensions of (n x - S)^2 with the sums S, a whole number; null
    beyond 64 bits), ``whitened``, ``explained`` (the component's share of the
    variance) and ``identity_error`` (of the covariance of ``whitened``, over
    all rows). The fit is over all vectors.

    Vectors that are null or hold a null, NaN or infinite entry take no part;
    shorter vectors, empty ones too, count as filled up with c = 0. Repeated
    rows, null and repeated ids count each. Components without variance (fewer
    rows or dimensions than components, rows in a subspace, equal rows) are left
    out, so a table of one row, of equal rows or of none gives no rows. Equal
    variances leave open which vectors span their space. Other columns are not
    read.
    """
    return settled(vectors.sparkSession, "whitened", lambda: _whitened(vectors, components, rows_each, id_col, vector_col))


def fit(vectors: DataFrame, rows_each: int, id_col: str, vector_col: str) -> Centred | None:
    """The stored blocks with their count and exact sums; None for no vectors or no dimensions."""
    valid = valid_vectors(vectors, id_col, vector_col)
    counted = valid.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, dims = counted[0], counted[1] or 0
    if not n or not dims:
        return None
    sums = (
        valid.select(F.posexplode("x").alias("place", "x")).groupBy("place")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("k")).orderBy("place").collect())
    exact = [int(r.s) + _SHIFT * (n - r.k) for r in sums]  # one number a dimension
    return Centred(stored_blocks(_blocks(valid, dims, rows_each), "vector_blocks"), n, exact)


def _whitened(vectors: DataFrame, components: int, rows_each: int, id_col: str, vector_col: str) -> DataFrame:
    schema = struct_of(vec_id="long", component="int", n="long", deviation="long", whitened="double", explained="double",
                       identity_error="double")
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], schema).withColumnRenamed("vec_id", id_col)
    centred = fit(vectors, rows_each, id_col, vector_col)
    if centred is None:
        return nothing
    n, dims = centred.n, centred.dims
    squares = float(centred.summed(lambda x: np.array([(x * x).sum()]))[0])
    if not squares:
        return nothing
    sigma, axes = bidiagonalise(centred, min(components, dims))
    kept = sigma > 1e-12 * sigma[0]
    deviations, axes = sigma[kept] / np.sqrt(n), axes[:, kept]
    project = axes / deviations

    def crossed(x: np.ndarray) -> np.ndarray:
        z = x @ project
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    found, m = centred.summed(crossed), len(deviations)
    mean = found[m * m :] / n
    covariance = found[: m * m].reshape(m, m) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(m)).max())
    explained = (deviations**2 / (squares / n)).tolist()
    rows_of, whole, rest = centred.rows(), centred.whole(), np.array(centred.rest, dtype=np.int64)

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        for ids, stored in taken:
            x, z = whole(stored), rows_of(stored) @ project
            far = _deviations(x, rest, n)
            for i, row_id in enumerate(ids):
                for k in range(m):
                    yield row_id, k + 1, n, far[i], float(z[i, k]), explained[k], error

    return map_rows(centred.blocks, rows, schema).withColumnRenamed("vec_id", id_col)


def _deviations(x: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 where ``x`` is less low and S less n low; None beyond 64 bits."""
    largest = int(np.abs(x).max(initial=0)) + 1
    if x.shape[1] * (n * largest) ** 2 < 1 << 62:
        d = n * x - rest
        return (d * d).sum(axis=1).tolist()
    out = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]
