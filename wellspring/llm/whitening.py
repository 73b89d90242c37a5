"""Embedding whitening by a block Jacobi-Davidson method.

The covariance is never formed.  Tasks hold blocks of the fit list's vectors and
multiply them, centred, with a few columns at a time; their shares are summed
over a shuffle and the driver sees ``dimensions x columns`` numbers.  There it
keeps a search space: Rayleigh-Ritz takes approximate eigenpairs from it, the
correction equation of each, projected against all of them, is solved by
some steps of MINRES (one distributed product a step for all pairs together),
and the corrections widen the space.  Pairs lock in order when their residual
reaches double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import PARTIAL_DDL, partial_sum, stored, summed

#: Entries become floor(STEP * entry) + OFFSET; components returned, at most.
STEP, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Beyond this magnitude 64 times an entry is held, so that it fits a double exactly.
LIMIT = 1 << 52
#: Pairs sought beyond those returned, so that none is missed; steps of MINRES.
GUARD, INNER = 4, 5
#: Vectors of a block.
ROWS = 2048


def minres(apply: Callable, b: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column of ``b``; ``apply``
    multiplies the columns each with its own matrix."""
    safe = lambda x: np.where(np.abs(x) > 1e-300, x, 1.0)
    eta = np.linalg.norm(b, axis=0)
    first = safe(eta)
    v_old, v = np.zeros_like(b), b / first
    d_old, d = np.zeros_like(b), np.zeros_like(b)
    x = np.zeros_like(b)
    beta = np.zeros(b.shape[1])
    g_old, g, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    live = eta > 0
    for _ in range(steps):
        if not live.any():
            break
        av = apply(v)
        alpha = (v * av).sum(0)
        new = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(new, axis=0)
        delta = g * alpha - g_old * s * beta
        r1, r2, r3 = np.hypot(delta, beta_new), s * alpha + g_old * g * beta, s_old * beta
        d_old, d = d, np.where(r1 > 1e-300, (v - r3 * d_old - r2 * d) / safe(r1), 0.0)
        g_old, g, s_old, s = g, delta / safe(r1), s, beta_new / safe(r1)
        x += np.where(live, g * eta, 0.0) * d
        eta = -s * eta
        live &= (np.abs(eta) > tol * first) & (beta_new > 1e-14 * np.abs(alpha).max(initial=1e-300)) & (r1 > 1e-300)
        v_old, v, beta = v, new / safe(beta_new), beta_new
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add to the given ones what ``new`` adds."""
    length = np.linalg.norm(new, axis=0)
    new = new[:, length > 0] / length[length > 0]
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
    u, size, _ = np.linalg.svd(new, full_matrices=False)
    new = u[:, size > 1e-8]
    for q in against:
        new = new - q @ (q.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def jacobi_davidson(product: Callable, dims: int, wanted: int, guard: int = GUARD, inner: int = INNER,
                    seed: int = 11, max_rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the
    symmetric matrix that ``product`` multiplies columns with."""
    wanted = min(wanted, dims)
    sought = min(wanted + guard, dims)
    widest = min(dims, 6 * sought)
    rng = np.random.Generator(np.random.PCG64(seed))
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = np.linalg.qr(rng.normal(size=(dims, min(dims, 2 * sought))))[0]
    image = product(space)
    loose = 1.0
    for _ in range(max_rounds):
        inner_matrix = space.T @ image
        theta, turn = np.linalg.eigh((inner_matrix + inner_matrix.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        need = sought - len(values)
        ritz, value = space[:, :need], theta[:need]
        residual = image[:, :need] - ritz * value
        # What is locked is left out of the corrections.
        residual -= locked @ (locked.T @ residual)
        scale = max(np.abs(values).max(initial=0.0), np.abs(theta).max(initial=0.0))
        size = np.linalg.norm(residual, axis=0)
        exact = len(values) + space.shape[1] == dims
        enough = np.where(np.arange(len(values), len(values) + len(size)) < wanted, 4 * dims ** 0.5 * np.finfo(float).eps, 1e-6) * scale
        done = (size <= enough) | exact
        lead = len(done) if done.all() else int(np.argmin(done))
        locked, values = np.hstack([locked, ritz[:, :lead]]), np.concatenate([values, value[:lead]])
        space, image = space[:, lead:], image[:, lead:]
        if len(values) >= sought:
            break
        ritz, value, residual = ritz[:, lead:], value[lead:], residual[:, lead:]
        if space.shape[1] + ritz.shape[1] > widest and space.shape[1] > 2 * need:
            space, image = space[:, :2 * need], image[:, :2 * need]
        sides = np.hstack([locked, ritz])
        off = lambda t: t - sides @ (sides.T @ t)

        def apply(t, value=value, off=off):
            t = off(t)
            return off(product(t) - t * value)
        loose = max(loose / 4, 1e-4)
        more = _orthonormal(off(minres(apply, -off(residual), inner, loose)), locked, space)
        if not more.shape[1]:  # nothing new along the corrections: a fresh direction
            more = _orthonormal(rng.normal(size=(dims, 1)), locked, space)
        more = more[:, :dims - locked.shape[1] - space.shape[1]]
        space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    else:
        raise RuntimeError("the eigenpairs did not reach double precision")
    # One more Rayleigh-Ritz step on all pairs, which also sorts those that were found late.
    h = locked.T @ product(locked)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    vectors = (locked @ turn)[:, ::-1][:, :wanted]
    top = np.abs(vectors).argmax(0)
    return values[::-1][:wanted], vectors * np.sign(vectors[top, np.arange(wanted)])


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is whole and finite; x is of longs."""
    entries = F.transform(vectors[f"`{vec_col}`"], lambda c: c.cast("double"))
    good = F.coalesce(entries.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    held = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * F.lit(float(STEP)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))),
                                        F.lit(LIMIT)), F.lit(-LIMIT)) + F.lit(OFFSET)
    return vectors.select(vectors[f"`{id_col}`"].alias("vec_id"), F.when(good, entries).alias("v")).where("v is not null").select(
        "vec_id", F.transform("v", held).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(dims: int):
    def scan(batches):
        n, s = 0, np.zeros(dims, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # 512 entries of up to 2**53 fit a long
                x = _matrix(batch.column("x").slice(at, 512))
                n, s = n + len(x), s + x.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38)), pa.array([n] * dims, pa.int64())],
            names=["i", "s", "n"])
    return scan


def _packed(base: np.ndarray):
    """Blocks of vectors less ``base``, as 4-byte integers where they fit and else as doubles."""
    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("x").slice(at, ROWS)) - base
                small = np.abs(x).max(initial=0) < 1 << 31
                yield pa.RecordBatch.from_arrays([pa.array([small]), pa.array([x.astype("<i4" if small else "<f8").tobytes()], pa.binary())],
                                                 names=["small", "data"])
    return scan


def _over_blocks(blocks: DataFrame, rest: np.ndarray, share: Callable) -> np.ndarray:
    """The sum over all centred blocks of ``share(block)``, flat."""
    def scan(batches):
        total = None
        for batch in batches:
            for small, data in zip(batch.column("small").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), "<i4" if small else "<f8").reshape(-1, len(rest)) - rest
                total = share(x) if total is None else total + share(x)
        if total is not None:
            yield partial_sum(total)
    return summed(blocks.mapInArrow(scan, PARTIAL_DDL), np.float64)


_DDL = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per
    remaining row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped.  An
    entry c becomes the long x = floor(64 c) + 1000000; magnitudes of 64 c from 2^52 on
    are held there.  The fit list has each distinct x vector once: n vectors with sums S.
    Components are the covariance's unit eigenvectors by falling eigenvalue, those
    within rounding of 0 left out, so vectors that are all equal give no rows.  ``deviation`` is the sum
    of (n x - S)^2 and null where that exceeds a long; ``whitened`` is x - S/n along the
    component over the root of its eigenvalue; ``explained`` the eigenvalue's share of
    the trace; ``identity_error`` the largest absolute entry of the whitened fit
    list's covariance less the identity, measured.

    All vectors must be of one width; where they aren't, the most frequent width (of
    several the least) counts and rows of others are dropped, as are empty vectors.  Repeated rows
    and ids and null ids are returned as often as they stand.  An empty table gives
    an empty result.
    """
    rows = stored(whole_vectors(vectors, id_col, vec_col).where("size(x) > 0"), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    spark = vectors.sparkSession
    none = spark.createDataFrame([], f"vec_id {kind}, {_DDL}")
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return none
    dims = width["w"]
    rows = rows.where(F.size("x") == dims)
    fit = stored(rows.select("x").distinct(), "fit")
    sums = fit.mapInArrow(_sums(dims), "i int, s decimal(38,0), n bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, s = int(sums[0]["n"]), [int(r["s"]) for r in sums]
    base = np.array([v // n for v in s], np.int64)
    left = [v % n for v in s]  # S - n * base
    rest = np.array([v / n for v in left])
    blocks = stored(fit.mapInArrow(_packed(base), "small boolean, data binary"), "blocks")

    def product(u):
        return _over_blocks(blocks, rest, lambda x: x.T @ (x @ u)).reshape(dims, -1) / n

    trace = float(_over_blocks(blocks, rest, lambda x: (x ** 2).sum(0)).sum()) / n
    if not trace:
        return none
    values, axes = jacobi_davidson(product, dims, components)
    some = values > 1e-12 * trace
    values, axes = values[some], axes[:, some]
    k = len(values)
    turn = axes / np.sqrt(values)

    def moments(x):
        z = x @ turn
        return np.concatenate([z.sum(0)[None], z.T @ z])
    found = _over_blocks(blocks, rest, moments).reshape(k + 1, k) / n
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())

    def scan(batches):
        odd = np.array(left, object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                c = _matrix(part.column("x")) - base
                z = (c - rest) @ turn
                if dims * (n * (float(np.abs(c).max()) + 1)) ** 2 < 2.0 ** 62:
                    far = ((n * c - np.array(left, np.int64)) ** 2).sum(1).tolist()
                else:
                    far = [v if v < 1 << 63 else None for v in ((n * c.astype(object) - odd) ** 2).sum(1).tolist()]
                m = len(c)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.reshape(-1)),
                     pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(scan, f"vec_id {kind}, {_DDL}")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
