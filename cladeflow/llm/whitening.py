"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP, GUARD = 32, 16  # components; more columns of the subspace, which make wanted ones converge sooner
DEGREE, PROBES = 12, 10  # of the filter's polynomial; Lanczos steps that bound the spectrum
EXACT, ENOUGH = 4e-15, 1e-10  # residuals, in units of the largest eigenvalue: where to stop; what a result must reach once it gets no better
ROUNDS = 200
STRAIGHT = 256  # tasks whose sums go to the driver as they are; beyond, they are added up in groups first
WIDE = 1 << 62


class Vectors:
    """The vectors of a table as integers, n of d dimensions with exact sums, and passes over them."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        self.tasks = rows.rdd.getNumPartitions()
        found = self._moments()
        self.n = found[0]["n"] if found else 0
        self.sums = [int(r["hi"]) * 2**32 + int(r["lo"]) for r in found]
        self.spread = self.n * max((r["most"] - r["least"] for r in found), default=0)  # no entry of n x - S is beyond
        self.narrow = self.n * max((max(abs(r["most"]), abs(r["least"])) for r in found), default=0) < WIDE
        self.short = self.narrow and d * self.spread**2 < WIDE  # a row's squares fit 64 bits together

    def _moments(self) -> list:
        d = self.d

        def run(batches):
            n, hi, lo = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            least, most = np.full(d, WIDE), np.full(d, -WIDE)
            for b in batches:
                x = integers(b.column(1), d)
                n, hi, lo = n + len(x), hi + (x >> 32).sum(0), lo + (x & 0xFFFFFFFF).sum(0)
                if len(x):
                    least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), *map(pa.array, (hi, lo, least, most))], ["pos", "n", "hi", "lo", "least", "most"])

        told = self.rows.mapInArrow(run, "pos int, n long, hi long, lo long, least long, most long")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        return told.groupBy("pos").agg(F.sum("n").alias("n"), wide("hi"), wide("lo"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("pos").collect()  # a row a dimension

    def centring(self) -> Callable[[pa.Array], np.ndarray]:
        """A function that gives n x - S of a column of vectors, exact; Python's integers where 64 bits don't do."""
        n, d, kind = self.n, self.d, np.int64 if self.narrow else object
        sums = np.array(self.sums, kind)
        return lambda column: integers(column, d).astype(kind) * n - sums

    def added(self, shape: tuple, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all batches of rows_of(centred vectors), an array of this shape."""
        centre, n = self.centring(), self.n

        def run(batches):
            total = np.zeros(shape)
            for b in batches:
                if b.num_rows:
                    total += rows_of((centre(b.column(1)) / n).astype(float))
            yield one(np.random.default_rng().integers(1 << 30), total)

        def one(group, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(group)], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "y"])

        def add(batches):
            total = np.zeros(shape)
            for b in batches:
                for y in b.column(1).to_pylist():
                    total += np.frombuffer(y).reshape(shape)
            yield one(0, total)

        sums = self.rows.mapInArrow(run, "part int, y binary")
        if self.tasks > STRAIGHT:
            sums = sums.repartition(max(2, int(self.tasks**0.5)), "part").mapInArrow(add, "part int, y binary")
        return np.sum([np.frombuffer(r["y"]).reshape(shape) for r in sums.collect()], axis=0)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        """V q, as centred XᵀXq over n, in one pass."""
        return self.added(q.shape, lambda c: c.T @ (c @ q)) / self.n


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) + 1000000 of a column of vectors of doubles."""
    return (np.floor(64 * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))).astype(np.int64) + 1_000_000


def spectrum(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """Bounds of the spectrum by some Lanczos steps from a random vector: the outermost Ritz values and, beyond them, the last residual."""
    q, alpha, beta = [rng.standard_normal(d)], [], []
    q[0] /= np.linalg.norm(q[0])
    for _ in range(min(steps, d)):
        r = times(q[-1][:, None])[:, 0]
        alpha.append(q[-1] @ r)
        basis = np.array(q)
        for _ in range(2):
            r = r - basis.T @ (basis @ r)
        beta.append(np.linalg.norm(r))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        q.append(r / beta[-1])
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return ritz[0] - beta[-1], ritz[-1] + beta[-1]


def filtered(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, degree: int, low: float, cut: float, high: float) -> np.ndarray:
    """The Chebyshev polynomial of a degree in V times x, small over [low, cut] and growing from cut on; scaled so that it is about 1 at high."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (high - middle)
    before, now = x, (times(x) - middle * x) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now, sigma = now, (times(now) - middle * now) * (2 * new / half) - sigma * new * before, new
    return now


def components(vectors: Vectors, top: int, guard: int, degree: int = DEGREE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The largest eigenvalues of V with their unit eigenvectors (columns), and the largest residual after each round.

    Each round filters the subspace, makes it orthonormal by QR and takes Ritz vectors. The unwanted spectrum reaches from its lower
    bound to the subspace's smallest Ritz value. Rounds end when every wanted residual is at most EXACT times the largest eigenvalue, or
    gets no smaller below ENOUGH times it.
    """
    d, times, rng = vectors.d, vectors.covariance_times, np.random.default_rng(seed)
    width, told = min(d, top + guard), []
    q, _ = np.linalg.qr(rng.standard_normal((d, width)))
    low, high = spectrum(times, d, PROBES, rng) if width < d else (0.0, 0.0)
    while True:
        y = times(q)
        g = q.T @ y
        value, turn = np.linalg.eigh((g + g.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        some = slice(0, min(top, width))
        told.append(float(np.linalg.norm(y[:, some] - q[:, some] * value[some], axis=0).max(initial=0) / max(value[0], 1e-300)))
        if value[0] <= 0 or told[-1] <= EXACT or (len(told) > 1 and told[-1] <= ENOUGH and told[-1] > told[-2] / 2):
            return value[some], q[:, some], told
        if len(told) > ROUNDS:
            raise RuntimeError(f"subspace iteration: residual {told[-1]:.1e} after {ROUNDS} rounds")
        if width == d:  # nothing is unwanted, so there is nothing to damp
            q, _ = np.linalg.qr(y)
            continue
        high = max(high, float(value[0]) * (1 + 1e-9))
        cut = min(max(float(value[-1]), low + 1e-6 * (high - low)), high - 1e-6 * (high - low))
        q, _ = np.linalg.qr(filtered(times, q, degree, low, cut, high))


def whole_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vector of doubles) of the rows that take part, and their dimensions."""
    vector = F.col(f"`{vec_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v")).filter("v is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < 7e16D)")
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    return rows.filter(F.size("v") == d), d


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector and each of the `top` largest principal components.

    A vector counts as x = floor(64 c) + 1000000. Components are eigenvectors of the covariance of all x (divisor n), found by passes over all
    rows that each multiply a block of `top + guard` columns by the centred XᵀX; no covariance matrix is formed and no vector leaves its task.
    whitened is a row's projection over the square root of the eigenvalue; deviation the exact sum of squares of n x - S (a
    long, or a decimal where it may not fit, null beyond 38 digits); explained the eigenvalue's share of the trace; identity_error the largest entry of whitened's covariance,
    measured in a pass of its own, minus the identity.

    Vectors that are null or empty, or hold nulls, NaN, infinite or numbers of 7e16 or more, take no part, nor do those of another length than
    the most frequent (the larger of equals). Null and repeated ids are rows like others. Components without variance are left out: all
    of them where there is one different vector or none. The table is read once a pass; write it first where it is dear.
    """
    spark, kind = table.sparkSession, table.schema[id_col].dataType.simpleString()
    rows, d = whole_vectors(table, id_col, vec_col)
    vectors = Vectors(rows, d) if d else None
    value, axes = np.zeros(0), np.zeros((0, 0))
    if vectors and vectors.n and vectors.spread:
        value, axes, _ = components(vectors, top, guard, degree)
        some = value > 1e-12 * value[0]
        value, axes = value[some], axes[:, some]
    if not len(value):
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, k, short, scale = vectors.n, len(value), vectors.short, axes / np.sqrt(value)

    def checks(c: np.ndarray) -> np.ndarray:
        w = c @ scale
        out = np.zeros((k + 2, k))
        out[:k], out[k], out[k + 1, 0] = w.T @ w, w.sum(0), (c * c).sum()
        return out

    told = vectors.added((k + 2, k), checks) / n
    identity_error = float(np.abs(told[:k] - np.outer(told[k], told[k]) - np.eye(k)).max())
    explained, centre = value / told[k + 1, 0], vectors.centring()
    wide = pa.int64() if short else pa.decimal128(38, 0)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                m, c = part.num_rows, centre(part.column(1))
                dev, line = (c * c).sum(1) if short else (c.astype(object) ** 2).sum(1), pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(line), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([x if x < 10**38 else None for x in dev.tolist()], wide).take(line), pa.array(((c / n).astype(float) @ scale).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error)),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation {'long' if short else 'decimal(38,0)'}, whitened double, explained double, identity_error double")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return made.withColumn("deviation", F.col("deviation").cast("long"))
