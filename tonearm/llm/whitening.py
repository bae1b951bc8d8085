"""Whitening of embeddings: leading components of their covariance by a block Jacobi-Davidson method.

1. Every entry c becomes the integer x = floor(64 c) + 1000000.  The fit list holds each distinct x vector once, as packed
   bytes of the least width that holds it, so equal vectors have equal bytes; it is written to the shared folder.
2. The covariance V is never formed.  A product V u is a Spark job: each task centres its rows, exactly up to one division by n,
   multiplies them with a block of vectors and with that result again, and sends one small sum; many sums are added
   in a second stage before the driver gets them.
3. Rayleigh-Ritz on a subspace gives approximate pairs.  Those not yet converged get a correction each: the equation
   (I - QQ')(V - theta I)(I - QQ') t = -r, where Q holds the locked vectors and the current ones, is solved by inner MINRES
   steps, all of a block in one job a step.  Corrections extend the subspace, which restarts from its best vectors when it is full.  Leading
   pairs whose residual has reached double precision are locked (over very many rows the products themselves are a little coarser; a
   residual that stops falling near there is taken).
4. Rows are projected on the components, which are fixed on the driver once: the same for all rows.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those whose vector hasn't the commonest
length (ties: the longer).  A row with a null vec_id keeps it; rows that repeat a vec_id each get a result; equal vectors count once
in the fit.  Components of eigenvalue zero (to double precision) are left out, so there are none for an empty table or a
single distinct vector.  Equal eigenvalues: any orthonormal basis of their space.  Vectors of any length are taken whole; the driver holds
``SPACE`` + 2 blocks of that length.  x saturates at +-2**62; a ``deviation`` beyond a long is null.  Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written

SHIFT, SCALE, TOP = 1_000_000, 64.0, 2.0**62
SPACE = 96  # vectors in the search space at most, if 16 components are wanted (six times as many as wanted)
INNER, OUTER = 6, 60  # MINRES steps of one correction; rounds before an error is raised
PRECISION = 128 * np.finfo(np.float64).eps  # residual over the greatest eigenvalue
ROUGH, STUCK = 1e-11, 3  # below ROUGH, a residual that hasn't halved in so many rounds is as good as the sums over this many rows are
DIRECT = 64  # sums that the driver adds itself


def packed(x: np.ndarray) -> bytes:
    """One tag byte and the entries in the least of 1, 2, 4 and 8 bytes that holds them all."""
    for kind in ("<i1", "<i2", "<i4"):
        info = np.iinfo(kind)
        if x.min() >= info.min and x.max() <= info.max:
            break
    else:
        kind = "<i8"
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _blocks(column):
    """(rows, matrix of long) of a packed column, a block for each width."""
    values = column.to_pylist()
    widths = np.array([v[0] for v in values], dtype=np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        flat = np.frombuffer(b"".join(values[i][1:] for i in at.tolist()), dtype=f"<i{w}")
        yield at, flat.reshape(len(at), -1).astype(np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, d (length) and x - 1000000 packed, of every row whose vector is whole and finite."""

    def run(batches_in):
        for batch in batches_in:
            ids, rows, kept, sizes = batch.column("vec_id"), [], [], []
            column = batch.column("v")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                good = np.isfinite(flat)
                x = np.clip(np.floor(flat * SCALE), -TOP, TOP)
            x = np.where(good, x, 0).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~good)])
            for i in np.flatnonzero(valid & (np.diff(ends) > 0)).tolist():
                a, b = int(ends[i]), int(ends[i + 1])
                if bad[a] == bad[b]:
                    kept.append(i)
                    rows.append(packed(x[a:b]))
                    sizes.append(b - a)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "d", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, d int, x binary")


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 31, x & 0x7FFFFFFF


@dataclass(frozen=True)
class Centre:
    """n vectors with sums of x - 1000000 by dimension, as exact integers; ``widest`` bounds |x - 1000000|."""

    n: int
    sums: tuple[int, ...]
    widest: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: long where that suffices, else Python integers."""
        if self.n * self.widest < 1 << 61:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list:
        y = self.scaled(x)
        if y.dtype == object or 4 * len(self.sums) * (self.n * self.widest) ** 2 >= 1 << 63:
            return [s if s < 1 << 63 else None for s in (sum(int(c) ** 2 for c in row) for row in y)]
        return (y * y).sum(axis=1).tolist()


def fit_list(rows: DataFrame) -> tuple[DataFrame, Centre | None]:
    """The distinct vectors of the commonest length as a stored table, and their centre."""
    lengths = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows.select("x"), None
    d = lengths[0]["d"]
    fit = written(rows.where(F.col("d") == d).select("x").distinct(), "whitening-fit")

    def run(batches_in):
        n, high, low, widest = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64), 0
        for batch in batches_in:
            for _, x in _blocks(batch.column("x")):
                n += len(x)
                a, b = _halves(x)
                high += a.sum(axis=0)
                low += b.sum(axis=0)
                widest = max(widest, int(np.abs(x).max()))
        columns = {"j": np.arange(d), "n": np.full(d, n), "high": high, "low": low, "widest": np.full(d, widest)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    whole = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    sums = fit.mapInArrow(run, "j long, n long, high long, low long, widest long").groupBy("j").agg(whole("n"), whole("high"), whole("low"), F.max("widest").alias("widest")).orderBy("j").collect()
    return fit, Centre(int(sums[0]["n"]), tuple((int(r["high"]) << 31) + int(r["low"]) for r in sums), max(r["widest"] for r in sums))


def summed(fit: DataFrame, centre: Centre, of) -> np.ndarray:
    """The sum over the fit list of ``of(centred rows)``, an array of fixed shape that every task sums on its own."""

    def run(batches_in):
        total = None
        for batch in batches_in:
            for _, x in _blocks(batch.column("x")):
                y = of(centre.centred(x))
                total = y if total is None else total + y
        if total is not None:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int64()), "y": pa.array([total.tobytes()], pa.binary())})

    def add(batches_in):
        first, total = None, None
        for batch in batches_in:
            for p, y in zip(batch.column("p").to_pylist(), batch.column("y").to_pylist()):
                first, total = (p, np.frombuffer(y)) if total is None else (first, total + np.frombuffer(y))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([first], pa.int64()), "y": pa.array([total.tobytes()], pa.binary())})

    parts, tasks = fit.mapInArrow(run, "p long, y binary"), fit.rdd.getNumPartitions()
    if tasks > DIRECT:
        groups = math.isqrt(tasks)
        parts = parts.repartitionById(groups, F.pmod("p", F.lit(groups)).cast("int")).sortWithinPartitions("p").mapInArrow(add, "p long, y binary")
    rows = sorted(parts.collect(), key=lambda r: r["p"])
    return sum(np.frombuffer(r["y"]) for r in rows)


def _outside(basis: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The part of ``t`` orthogonal to a basis; twice, against cancellation."""
    for _ in range(2):
        t = t - basis @ (basis.T @ t)
    return t


def _joined(basis: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``t`` that a basis lacks."""
    out = np.zeros((len(t), 0))
    for j in range(t.shape[1]):
        v = t[:, j : j + 1]
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = _outside(np.hstack([basis, out]), v / size)
        left = np.linalg.norm(v)
        if left > 1e-8:
            v = _outside(np.hstack([basis, out]), v / left)
            out = np.hstack([out, v / np.linalg.norm(v)])
    return out


def minres(product, basis: np.ndarray, theta: np.ndarray, right: np.ndarray, steps: int, goal: float = 0.05) -> np.ndarray:
    """Approximate solutions t, orthogonal to ``basis``, of (I - QQ')(V - theta_j I)(I - QQ') t_j = right_j; one product a step for all."""
    v = _outside(basis, right)
    beta = np.linalg.norm(v, axis=0)
    begun = np.where(beta > 0, beta, 1.0)
    v, before, x = v / begun, np.zeros_like(v), np.zeros_like(v)
    w1, w2 = np.zeros_like(v), np.zeros_like(v)
    c1, s1, c2, s2 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, last = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        p = _outside(basis, product(v) - v * theta) - before * last
        alpha = (p * v).sum(axis=0)
        p = p - v * alpha
        nxt = np.linalg.norm(p, axis=0)
        delta, gamma2, gamma3 = c1 * alpha - c2 * s1 * last, s1 * alpha + c2 * c1 * last, s2 * last
        gamma1 = np.hypot(delta, nxt)
        safe = np.where(gamma1 > 0, gamma1, 1.0)
        c2, s2, c1, s1 = c1, s1, delta / safe, nxt / safe
        w = (v - w2 * gamma3 - w1 * gamma2) / safe
        x = x + np.where(gamma1 > 0, c1 * eta, 0.0) * w
        eta = -s1 * eta
        w2, w1 = w1, w
        before, v, last = v, p / np.where(nxt > 0, nxt, 1.0), nxt
        if (np.abs(eta) <= goal * begun).all():
            break
    return _outside(basis, x)


def leading(product, d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric operator without negative eigenvalues.

    ``product`` multiplies a d x k block.  Eigenvalues that are zero to double precision are left out.
    """
    wanted = min(wanted, d)
    room = min(d, SPACE * max(wanted, 16) // 16)
    locked, values = np.zeros((d, 0)), []
    space = _joined(locked, np.random.default_rng(seed).normal(size=(d, min(d, wanted + 8))))
    image = product(space)
    lead, stuck = np.inf, 0
    for _ in range(OUTER):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(values[0] if values else 0.0, float(theta[0]), np.finfo(float).tiny)
        rest = image - space * theta
        if locked.shape[1]:
            rest = _outside(locked, rest)
        size = np.linalg.norm(rest, axis=0)
        done, stuck = 0, stuck + 1 if size[0] > lead / 2 else 0
        lead = min(lead, size[0])
        enough = max(PRECISION * top, min(8 * size[0], ROUGH * top) if stuck >= STUCK else 0.0)
        while len(values) + done < wanted and done < len(theta) and size[done] <= enough:
            done += 1
        if done:
            lead, stuck = np.inf, 0
            locked = np.hstack([locked, space[:, :done]])
            values += theta[:done].tolist()
            space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        need = wanted - len(values)
        if need <= 0 or not len(theta):
            break
        block = min(need, len(theta))
        if space.shape[1] + block > room - locked.shape[1] and locked.shape[1] + space.shape[1] < d and room < d:
            keep = min(space.shape[1], 2 * block + 8, max(block, room - locked.shape[1] - block))
            space, image = space[:, :keep], image[:, :keep]
        near = np.hstack([locked, space[:, :block]])
        fix = minres(product, near, theta[:block], -rest[:, :block], INNER)
        new = _joined(np.hstack([locked, space]), fix)
        if not new.shape[1]:
            new = _joined(np.hstack([locked, space]), rest[:, :block])
        if not new.shape[1]:  # nothing to add: a space that the operator keeps; fresh products decide whether it has converged
            fresh = product(space)
            if np.abs(fresh - image).max() <= PRECISION * top and (np.linalg.norm(fresh - space * theta, axis=0)[:block] > 8 * PRECISION * top).any():
                new = _joined(np.hstack([locked, space]), np.random.default_rng(seed + len(values) + 1).normal(size=(d, block)))
            image = fresh
            if not new.shape[1]:
                order = theta[:block] > 0
                locked, values = np.hstack([locked, space[:, :block][:, order]]), values + theta[:block][order].tolist()
                break
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError(f"residuals don't reach double precision in {OUTER} rounds")
    values = np.array(values)
    by = np.argsort(-values, kind="stable")
    values, locked = values[by], locked[:, by]
    real = values > max(d, 16) * np.finfo(float).eps * (values[0] if len(values) else 0.0)
    return values[real], locked[:, real]


def whitened(vectors: DataFrame, wanted: int = 16) -> DataFrame:
    """A row for each whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(vectors)
    fit, centre = fit_list(rows)
    empty = vectors.sparkSession.createDataFrame([], out)
    if centre is None:
        return empty
    d, n = len(centre.sums), centre.n
    trace = float(summed(fit, centre, lambda c: np.array([(c * c).sum()]))[0]) / n
    if not trace > 0:
        return empty

    def product(u: np.ndarray) -> np.ndarray:
        return summed(fit, centre, lambda c: c.T @ (c @ u)).reshape(d, -1) / n

    values, vectors_ = leading(product, d, wanted)
    axes = vectors_ / np.sqrt(values)
    k = len(values)
    covariance = summed(fit, centre, lambda c: (w := c @ axes).T @ w).reshape(k, k) / n
    error, share = float(np.abs(covariance - np.eye(k)).max()), values / trace

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                for at, x in _blocks(part.column("x")):
                    columns = {
                        "vec_id": part.column("vec_id").take(pa.array(np.repeat(at, k))),
                        "component": pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                        "n": pa.array(np.full(k * len(at), n), pa.int64()),
                        "deviation": pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        "whitened": pa.array((centre.centred(x) @ axes).ravel()),
                        "explained": pa.array(np.tile(share, len(at))),
                        "identity_error": pa.array(np.full(k * len(at), error)),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

    return rows.where(F.col("d") == d).select("vec_id", "x").mapInArrow(run, out)
