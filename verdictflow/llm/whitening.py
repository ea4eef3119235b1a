"""Whitening of integer embeddings on their leading principal components, by Jacobi-Davidson.

The covariance is never formed. It is applied to a few vectors at once by a Spark job over the
distinct vectors, which are kept as blocks of a matrix: each task centres its blocks, multiplies
twice and returns one partial sum, at most ``PARTS`` of them. Rayleigh-Ritz on a growing subspace
gives approximate eigenpairs; a pair whose residual has reached double precision is locked, for the
others the projected correction equation is solved by some steps of MINRES, all in step, so that a
step is one job. Once all pairs are locked, random directions and their images are added to the
subspace: only if nothing larger turns up there is the result final. What the driver holds are
vectors of the embedding's dimension, some tens of them.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped; entries too
large for a long are cut to its range; a vector shorter than the longest counts as ending in zeros;
repeated rows are all returned but fitted once; null ids pass through; components without variance
(fewer distinct vectors than components, equal vectors) are left out, so that one distinct vector, an
empty table or empty vectors give no rows; a ``deviation`` beyond a long is null. Only the two named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.session import materialize

BLOCK_ROWS = 4096  # vectors in a block
PARTS = 512  # most partial sums that reach the driver; each is dimension x vectors doubles
INNER = 8  # most MINRES steps of a correction
MOST = 96  # most vectors in the subspace
EPS = float(np.finfo(float).eps)
LONG = 2 ** 63 - 1


# --- integer vectors -------------------------------------------------------------------------------

def integer_vectors(df: DataFrame, vector_col: str, scale: int, *keep) -> DataFrame:
    """The columns ``keep`` and x = floor(scale * c) as an array of long, rows with unusable vectors dropped."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    return df.filter(v.isNotNull()).filter(~bad).select(*keep, whole.alias("x"))


def to_codes(x: np.ndarray) -> list[bytes]:
    """Each row in as few bytes per entry as it needs, so that equal vectors have equal codes."""
    most = np.maximum(x.max(axis=1), ~x.min(axis=1))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        data, size = x[at].astype(f"<i{w}").tobytes(), w * x.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = data[k * size:(k + 1) * size]
    return out


def from_codes(codes: list[bytes], d: int) -> np.ndarray:
    width = np.fromiter(map(len, codes), np.int64, len(codes)) // d
    x = np.empty((len(codes), d), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        x[at] = np.frombuffer(b"".join(codes[i] for i in at.tolist()), f"<i{w}").reshape(-1, d)
    return x


def coded(vectors: DataFrame, d: int, id_type: str | None = None) -> DataFrame:
    """``code`` (and vec_id): the vectors, filled up with zeros to ``d`` entries, as bytes."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["x"]
            size = column.value_lengths().to_numpy()
            x = np.zeros((len(batch), d), np.int64)
            x[np.arange(d) < size[:, None]] = column.flatten().to_numpy()
            out = {} if id_type is None else {"vec_id": batch["vec_id"]}
            yield pa.RecordBatch.from_pydict(out | {"code": pa.array(to_codes(x) if len(x) else [], pa.binary())})

    return vectors.mapInArrow(encode, "code binary" if id_type is None else f"vec_id {id_type}, code binary")


def blocks_of(codes: DataFrame, d: int) -> DataFrame:
    """The distinct vectors, as matrices of at most ``BLOCK_ROWS`` rows."""
    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                x = from_codes(batch["code"].slice(at, BLOCK_ROWS).to_pylist(), d)
                small = next((t for t in ("<i1", "<i2", "<i4") if x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max), "<i8")
                yield pa.RecordBatch.from_pydict({"kind": [small], "data": [x.astype(small).tobytes()]})

    return codes.distinct().mapInArrow(stack, "kind string, data binary")


class Vectors:
    """The distinct vectors on Spark: sums over blocks, one job each."""

    def __init__(self, blocks: DataFrame, d: int):
        self.d = d
        self.blocks = blocks.coalesce(PARTS)
        self.n, self.sums = 0, [0] * d

        def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, [0] * d
            for x in matrices(parts, d):
                n += len(x)
                safe = max(int(x.max()), -int(x.min())) * len(x) <= LONG
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [list(map(str, sums))]})

        for row in self.blocks.mapInArrow(moments, "n long, sums array<string>").collect():
            self.n += row.n
            self.sums = [a + int(b) for a, b in zip(self.sums, row.sums, strict=True)]

    def total(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over blocks of ``part`` (centred block), added in the order of the parts."""
        n, sums, d = self.n, self.sums, self.d

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0.0
            for x in matrices(parts, d):
                out = out + part(centred(x, n, sums))
            if not isinstance(out, float):
                yield pa.RecordBatch.from_pydict({"part": [out.astype("<f8").tobytes()]})

        found = self.blocks.mapInArrow(work, "part binary").collect()
        return np.sum([np.frombuffer(r.part, "<f8") for r in found], axis=0)

    def trace(self) -> float:
        return float(self.total(lambda z: np.array([np.square(z).sum()]))[0]) / self.n

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``q``."""
        return self.total(lambda z: (z.T @ (z @ q)).ravel()).reshape(q.shape) / self.n

    def variances(self, u: np.ndarray) -> np.ndarray:
        """Rayleigh quotients from the projections: precise for small eigenvalues beside very large ones, too."""
        return self.total(lambda z: np.square(z @ u).sum(axis=0)) / self.n

    def identity_error(self, u: np.ndarray, values: np.ndarray) -> float:
        """Largest entry of the covariance of the whitened vectors minus the identity."""
        to, k = u / np.sqrt(values), len(values)
        mean = self.total(lambda z: (z @ to).sum(axis=0)) / self.n

        def outer(z: np.ndarray) -> np.ndarray:
            w = z @ to - mean
            return (w.T @ w).ravel()
        return float(np.abs(self.total(outer).reshape(k, k) / self.n - np.eye(k)).max())


def matrices(parts: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in parts:
        for kind, data in zip(batch["kind"].to_pylist(), batch["data"], strict=True):
            yield np.frombuffer(data.as_buffer(), kind).reshape(-1, d).astype(np.int64)


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs where they hold it, else Python integers."""
    most = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) if x.size else 0
    if most <= LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (scaled(x, n, sums) / n).astype(float)


# --- eigenpairs ------------------------------------------------------------------------------------

def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(a).sum(axis=0))


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Least residual solutions of symmetric systems, one per column, from zero in at most ``steps`` products."""
    tiny = np.finfo(float).tiny
    beta = np.maximum(norms(b), tiny)
    goal, left = tol * beta, beta.copy()
    x, v, v_old = np.zeros_like(b), b / beta, np.zeros_like(b)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    cos, sin, carry, skip, beta_old = -np.ones(b.shape[1]), *(np.zeros(b.shape[1]) for _ in range(4))
    for _ in range(steps):
        y = apply(v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - beta_old * v_old
        beta = norms(y)
        skipped, upper, diag = skip, cos * carry + sin * alpha, sin * carry - cos * alpha
        skip, carry = sin * beta, -cos * beta
        size = np.maximum(np.hypot(diag, beta), tiny)
        cos, sin = diag / size, beta / size
        w, w_old = (v - skipped * w_old - upper * w) / size, w
        x = x + cos * left * w
        left = sin * left
        if (np.abs(left) <= goal).all():
            break
        v, v_old, beta_old = y / np.maximum(beta, tiny), v, beta
    return x


def extended(q: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The part of the columns ``new`` outside the span of ``q``, orthonormal."""
    out = np.empty((len(q), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):  # twice is enough unless a vector lies almost in the span
            v = v - q @ (q.T @ v)
            v = v - out @ (out.T @ v)
            if (left := np.linalg.norm(v)) <= 1e-10 * size or not left:
                break
            v, size = v / left, 1.0
        else:
            out = np.column_stack([out, v])
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, most: int = MOST,
                    inner: int = INNER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix of dimension ``d`` given by its products, and
    unit eigenvectors. Raises if residuals do not reach double precision."""
    rng = np.random.default_rng(seed)
    k = min(k, d)
    most = min(d, max(most, 4 * k))
    q = extended(np.empty((d, 0)), rng.normal(size=(d, min(d, 2 * k))))
    image, probed, best, stuck = product(q), False, np.inf, 0
    for _ in range(500):
        h = q.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, residual = q @ y[:, :k], image @ y[:, :k] - (q @ y[:, :k]) * theta[:k]
        size, top = norms(residual), max(abs(theta[0]), abs(theta[-1]))
        worst = size.max()
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        good = 8 * EPS * top
        # rounding in the products ends progress somewhat above that in high dimensions
        locked = size <= (good if stuck < 4 else max(good, 4 * d * EPS * top))
        if locked.all():
            if probed or q.shape[1] == d:
                return theta[:k], ritz
            probed = True
            new = rng.normal(size=(d, k))  # is there a larger eigenvalue that the subspace missed?
            for _ in range(3):
                new = extended(ritz, new)
                new = np.column_stack([new, product(new)])[:, -k:]
        else:
            probed = False

            def correction(t: np.ndarray, at=theta[:k][~locked]) -> np.ndarray:
                t = product(t) - t * at
                return t - ritz @ (ritz.T @ t)

            rhs = residual[:, ~locked]
            rhs = rhs - ritz @ (ritz.T @ rhs)
            new = minres(correction, -rhs, inner, 0.05)
        if q.shape[1] + new.shape[1] > most and most < d:  # go on with the best directions only
            keep = min(2 * k, most // 2)
            q, image = q @ y[:, :keep], image @ y[:, :keep]
        new = extended(q, new)
        if not new.shape[1] and q.shape[1] < d:
            new = extended(q, rng.normal(size=(d, min(k, d - q.shape[1]))))
        if new.shape[1]:
            q, image = np.column_stack([q, new]), np.column_stack([image, product(new)])
    raise ArithmeticError(f"residuals {size.tolist()} did not reach double precision")


# --- whitening -------------------------------------------------------------------------------------

def whitened(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding",
             scale: int = 256) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows = integer_vectors(df, vector_col, scale, F.col(id_col).alias("vec_id"))
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], schema)
    fit = Vectors(materialize(blocks_of(coded(rows.select("x"), d), d), "vector-blocks"), d)
    trace = fit.trace()
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, u = jacobi_davidson(fit.product, d, components)
    real = values > d * EPS * trace
    u = u[:, real]
    values = fit.variances(u)
    error, n, sums, k = fit.identity_error(u, values), fit.n, fit.sums, len(values)
    to, explained = u / np.sqrt(values), values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, m = from_codes(part["code"].to_pylist(), d), len(part)
                far = scaled(x, n, sums)
                most = int(np.abs(far).max())
                square = far * far if d * most * most <= LONG else far.astype(object) ** 2
                deviation = [v if v <= LONG else None for v in map(int, square.sum(axis=1))]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part["vec_id"].take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n)), "deviation": pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    "whitened": pa.array(((far / n).astype(float) @ to).ravel()), "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error))})

    return coded(rows, d, kind).mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
