"""Embedding whitening: incremental eigendecomposition, merged spectra, Rayleigh-Ritz refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import long_id, ship_package, table
from gaugeworks.session import settle

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Partial results that one task merges; levels of merging grow with the logarithm of the tasks.
FAN_IN = 16
#: Rows of vectors that are worked on at a time.
BLOCK = 4_096
_EPS = float(np.finfo(np.float64).eps)
_LONGEST = 2.0**53  # beyond, neighbouring long values are one double


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1/rho + sum z_i**2 / (d_i - x) for rising distinct d and nonzero z.

    Root j lies between d_j and d_j+1, the last within rho * |z|**2 above its pole. All are
    found together, each as an offset from its nearer pole, so that differences to poles
    keep their digits. A step solves the equation with the sums left and right of the root
    each replaced by a pole of the same value and slope; where it leaves the bracket, the
    bracket is halved. Returns the pole taken as origin and the offset.
    """
    n = len(d)
    squares = z * z
    if n == 1:
        return np.zeros(1, int), rho * squares
    ends = np.r_[d[1:], d[-1] + rho * squares.sum()]
    gap = ends - d
    index = np.arange(n)
    left_of = (index[:, None] <= index).astype(float)  # pole i is left of root j
    middle = 1 / rho + squares @ (1 / (d[:, None] - (d + gap / 2)))
    origin = np.where((middle >= 0) | (index == n - 1), index, np.minimum(index + 1, n - 1))
    right = origin > index
    poles = d[:, None] - d[origin]
    lo = np.where(right, -gap / 2, np.where(middle >= 0, 0.0, gap / 2))
    hi = np.where(right, 0.0, np.where(middle >= 0, gap / 2, gap))
    below, above = d - d[origin], ends - d[origin]
    x = (lo + hi) / 2
    for _ in range(80):
        inverse = 1 / (poles - x)
        left, every = squares @ (inverse * left_of), squares @ inverse
        value = 1 / rho + every
        small = 8 * _EPS * n * (1 / rho + every - 2 * left)  # terms on the left are negative
        negative = value < 0
        lo, hi = np.where(negative, x, lo), np.where(negative, hi, x)
        open_ = (np.abs(value) > small) & (hi - lo > 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not open_.any():
            break
        inverse *= inverse
        slope_left = squares @ (inverse * left_of)
        slope_right = squares @ inverse - slope_left
        to_left, to_right = below - x, above - x
        c = value - to_left * slope_left - to_right * slope_right
        a = (to_left + to_right) * value - to_left * to_right * (slope_left + slope_right)
        b = to_left * to_right * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            moved = x + step
        sound = np.isfinite(moved) & (moved > lo) & (moved < hi)
        x = np.where(open_, np.where(sound, moved, (lo + hi) / 2), x)
    return origin, x


class Spectrum:
    """Eigenvalues and orthonormal eigenvectors of a sum of outer products, updated in place.

    Only nonzero eigenvalues are held: the null space is deflated as a whole, all that a new
    vector has outside of the held directions is one further direction of eigenvalue zero.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.values = np.empty(0)
        self.vectors = np.empty((width, 0))

    def add(self, vector: np.ndarray, weight: float = 1.0) -> None:
        """Add weight * vector * vector^T by one secular equation."""
        length = float(np.linalg.norm(vector))
        if length == 0.0 or weight <= 0.0:
            return
        z = self.vectors.T @ vector
        values, vectors = self.values, self.vectors
        if len(values) < self.width:
            rest = vector - vectors @ z
            again = vectors.T @ rest  # once more, so that the new direction is orthogonal
            rest -= vectors @ again
            z = z + again
            outside = float(np.linalg.norm(rest))
            if outside > 64 * _EPS * length:
                vectors = np.column_stack([rest / outside, vectors])
                values = np.r_[0.0, values]
                z = np.r_[outside, z]
        largest = max(float(values.max(initial=0.0)), weight * length * length)
        values, vectors, z = _merge_equal(values, vectors, z, 8 * _EPS * largest)
        kept = np.abs(z) * length * weight > 8 * _EPS * largest  # others' eigenpairs stay
        if kept.any():
            d, w = values[kept], z[kept]
            origin, offset = secular_roots(d, w, weight)
            distance = (d[:, None] - d[origin]) - offset  # d_i - root_j
            # The vector for which these roots are exact, so that the eigenvectors are
            # orthogonal however close the roots lie.
            ratio = -distance / _differences(d)
            exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(w)
            turn = exact[:, None] / distance
            turn /= np.linalg.norm(turn, axis=0)
            values, vectors = values.copy(), vectors.copy()
            values[kept] = d[origin] + offset
            vectors[:, kept] = vectors[:, kept] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum, one eigenpair after the other."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.add(vector, float(value))


def _differences(d: np.ndarray) -> np.ndarray:
    """d_j - d_i where j differs from i, arranged so that column products pair off.

    Row i, column j holds d_j - d_i for j < i and d_j+1 - d_i from j = i on; the last column
    has 1, as there is one root more than there are other poles.
    """
    n = len(d)
    below = d[None, :] - d[:, None]
    after = np.column_stack([below[:, 1:], -np.ones(n)])
    index = np.arange(n)
    return np.where(index[None, :] < index[:, None], below, after)


def _merge_equal(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotate within (almost) equal eigenvalues, so that all but one have no part in the update."""
    close = np.flatnonzero(np.diff(values) <= least)
    if not len(close):
        return values, vectors, z
    vectors, z = vectors.copy(), z.copy()
    for i in close:
        length = np.hypot(z[i], z[i + 1])
        if length > 0:
            c, s = z[i + 1] / length, z[i] / length
            one, two = vectors[:, i].copy(), vectors[:, i + 1].copy()
            vectors[:, i], vectors[:, i + 1] = c * one - s * two, s * one + c * two
            z[i], z[i + 1] = 0.0, length
    return values, vectors, z


@dataclass(frozen=True)
class Whitening:
    """Fit over `n` vectors of one width: mean of x, components as columns, their eigenvalues."""

    n: int
    sums: tuple[int, ...]  # of x - OFFSET, exact
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """x - S/n for floored vectors."""
        return vectors - np.array([s / self.n for s in self.sums])

    def whiten(self, vectors: np.ndarray) -> np.ndarray:
        return self.centred(vectors) @ self.components / np.sqrt(self.eigenvalues)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_width(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Blocks of vectors of one width, with their rows."""
    for batch in batches:
        widths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            part = batch.take(pa.array(np.flatnonzero(widths == width))) if (widths != width).any() else batch
            for start in range(0, part.num_rows, BLOCK):
                rows = part.slice(start, BLOCK)
                yield int(width), rows, _matrix(rows.column(column))


_MATRIX = "width int, part long, values array<double>, matrix binary"


def _packed(width: int, part: int, values: np.ndarray, matrix: np.ndarray) -> dict:
    """A row of numbers that belong to a task: some values, and a matrix row after row."""
    return {"width": width, "part": part, "values": values.tolist(), "matrix": matrix.tobytes()}


def _merged(parts: DataFrame, merge: Callable[[int, pa.Table], tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Merge one row per task and width, FAN_IN at a time, to one row per width.

    Rows are a few kilobytes, width squared; a task sees FAN_IN of them and the driver one
    per width, whatever the number of tasks.
    """
    schema = pa.schema([("width", pa.int32()), ("part", pa.int64()), ("values", pa.list_(pa.float64())), ("matrix", pa.binary())])

    def group(rows: pa.Table) -> pa.Table:
        width, part = rows.column("width")[0].as_py(), rows.column("part")[0].as_py()
        order = np.argsort(rows.column("at").to_numpy(), kind="stable")
        return pa.Table.from_pylist([_packed(width, part, *merge(width, rows.take(order)))], schema)

    parts = settle(parts)
    largest = parts.agg(F.max("part").alias("part")).first()["part"] or 0
    while largest > 0:
        largest //= FAN_IN
        dealt = parts.withColumn("at", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = dealt.groupBy("width", "part").applyInArrow(group, _MATRIX)
    return {row["width"]: (np.array(row["values"]), np.frombuffer(row["matrix"])) for row in parts.collect()}


def _added(width: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the tasks' matrices."""
    return np.empty(0), np.sum([np.frombuffer(m.as_py()) for m in rows.column("matrix")], axis=0)


def _per_task(vectors: DataFrame, start: Callable[[int], object], take: Callable, pack: Callable) -> DataFrame:
    """One row per task and width: a state that takes each block of vectors in turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for width, _, block in _by_width(batches):
            if width not in states:
                states[width] = start(width)
            take(width, states[width], block)
        part = TaskContext.get().partitionId()
        rows = [_packed(width, part, *pack(state)) for width, state in states.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("width", pa.int32()), ("part", pa.int64()), ("values", pa.list_(pa.float64())), ("matrix", pa.binary()),
            ]))

    return vectors.select("y").mapInArrow(run, _MATRIX)


def floored(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Usable vectors on the grid: id and y = floor(SCALE * c), as doubles that hold integers.

    Out go rows whose vector is null or empty or holds an entry that is null, not finite, or
    so large that y is no exact double.
    """
    y = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: c * F.lit(float(SCALE)))
    # A comparison with null or NaN entries: NaN is larger than every number.
    sound = F.size("y").cast("boolean") & ~F.exists("y", lambda c: c.isNull() | ~(F.abs(c) < F.lit(_LONGEST)))
    found = df.select(long_id(df, id_column).alias("id"), y.alias("y")).where(F.coalesce(sound, F.lit(False)))
    whole = F.transform("y", lambda c: F.floor(c).cast("double"))
    return found.select("id", whole.alias("y"))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Components of the covariance of all vectors, for each width that occurs.

    `vectors` has y, from `floored`. Counts and sums are exact. Every task then adds its
    centred vectors to a spectrum one by one, a rank-one update each; spectra are merged by
    rank-one updates with one another's eigenpairs, FAN_IN at a time. At last all vectors
    are projected on the merged basis, and the small moment matrix of these projections,
    summed over the tasks, turns it into the components (Rayleigh-Ritz): what rounding the
    updates gathered is gone then. Directions whose eigenvalue is rounding noise count as
    null space and are no components.
    """
    ship_package(vectors.sparkSession)
    place = vectors.select(F.size("y").alias("width"), F.posexplode("y").alias("at", "c"))
    place = place.groupBy("width", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(17,0)")).alias("s")
    )
    totals: dict[int, dict[int, tuple[int, int]]] = {}
    for row in place.collect():  # one row per dimension
        totals.setdefault(row["width"], {})[row["at"]] = (row["n"], int(row["s"]))
    sums = {width: tuple(rows[i][1] for i in range(width)) for width, rows in totals.items()}
    counts = {width: rows[0][0] for width, rows in totals.items()}
    means = {width: np.array([s / counts[width] for s in own]) for width, own in sums.items()}

    def take_vectors(width: int, spectrum: Spectrum, block: np.ndarray) -> None:
        for row in block - means[width]:
            spectrum.add(row)

    def merge_spectra(width: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        merged = Spectrum(width)
        for values, matrix in zip(rows.column("values"), rows.column("matrix"), strict=True):
            own = Spectrum(width)
            own.values = np.array(values.as_py())
            own.vectors = np.frombuffer(matrix.as_py()).reshape(-1, width).T
            merged.merge(own)
        return merged.values, merged.vectors.T

    spectra = _merged(
        _per_task(vectors, Spectrum, take_vectors, lambda s: (s.values, s.vectors.T)), merge_spectra
    )
    bases = {width: np.ascontiguousarray(basis.reshape(-1, width).T) for width, (_, basis) in spectra.items()}

    def take_moments(width: int, moments: np.ndarray, block: np.ndarray) -> None:
        projected = (block - means[width]) @ bases[width]
        size = projected.shape[1]
        moments[:size, :size] += projected.T @ projected

    moments = _merged(
        _per_task(vectors, lambda w: np.zeros((w, w)), take_moments, lambda m: (np.empty(0), m)), _added
    )
    fits = {}
    for width, (_, moment) in moments.items():
        basis = bases[width]
        size = basis.shape[1]
        values, turn = np.linalg.eigh(moment.reshape(width, width)[:size, :size] / counts[width])
        trace = float(values.sum())
        order = np.argsort(-values)[:components]
        order = order[values[order] > 64 * _EPS * width * max(trace, 0.0)]
        fits[width] = Whitening(counts[width], sums[width], basis @ turn[:, order], values[order], trace)
    return fits


def identity_error(vectors: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, for each width."""

    def take(width: int, moments: np.ndarray, block: np.ndarray) -> None:
        white = fits[width].whiten(block)
        white = np.column_stack([np.ones(len(white)), white])  # the first row gathers the sums
        moments[: white.shape[1], : white.shape[1]] += white.T @ white

    parts = _per_task(vectors, lambda w: np.zeros((w + 1, w + 1)), take, lambda m: (np.empty(0), m))
    errors = {}
    for width, (_, moment) in _merged(parts, _added).items():
        size = len(fits[width].eigenvalues)
        moment = moment.reshape(width + 1, width + 1) / fits[width].n
        mean = moment[0, 1 : size + 1]
        off = moment[1 : size + 1, 1 : size + 1] - np.outer(mean, mean) - np.eye(size)
        errors[width] = float(np.abs(off).max(initial=0.0))
    return errors


def deviations(whole: np.ndarray, fit: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; None where it is beyond a long.

    The offset cancels out, so y and its sums serve as well.
    """
    own = whole.astype(np.int64)
    most = fit.n * int(np.abs(own).max(initial=0)) + max(map(abs, fit.sums), default=0)
    if most**2 * own.shape[1] < 1 << 63:
        off = fit.n * own - np.array(fit.sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((fit.n * c - s) ** 2 for c, s in zip(row, fit.sums, strict=True)) for row in own.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten_embeddings(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Whitened vectors by component: id, component, n, deviation, whitened, explained, identity_error.

    The entry c of a vector counts as x = floor(64 * c) + 1000000. Components are the unit
    eigenvectors of the covariance of all x (divisor n), numbered from 1 by falling
    eigenvalue, up to `components`. One row per usable vector and component: its projection
    over the eigenvalue's root, the eigenvalue's share of the trace, the exact squared
    distance of n * x from the sums, and how far the whitened vectors' covariance is from
    the identity.

    Rows go whose vector is null, empty, or has an entry that is null, not finite, or 2**53
    or more when multiplied by 64. Vectors of another length are fitted among themselves.
    Directions without variance are no components, so a single vector or equal ones give no
    rows. A deviation beyond a long is null. Null and repeated ids are kept; repeated rows
    count each. An empty table gives an empty one. Other columns are left out.
    """
    vectors = settle(floored(df, id_column, vector))
    fits = {width: fit for width, fit in fit_whitening(vectors, components).items() if len(fit.eigenvalues)}
    vectors = vectors.where(F.size("y").isin(list(fits)))
    errors = identity_error(vectors, fits) if fits else {}
    shared = df.sparkSession.sparkContext.broadcast((fits, errors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = shared.value
        for width, rows, block in _by_width(batches, 1):
            fit, count = fits[width], rows.num_rows
            white = fit.whiten(block)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array([width] * count, pa.int32()), pa.array([fit.n] * count, pa.int64()),
                    pa.array(deviations(block, fit), pa.int64()), lists.cast(pa.list_(pa.float64())),
                    pa.array([errors[width]] * count, pa.float64()),
                ],
                ["id", "width", "n", "deviation", "white", "identity_error"],
            )

    found = vectors.mapInArrow(
        run, "id long, width int, n long, deviation long, white array<double>, identity_error double"
    )
    shares = [
        (width, i, float(e / fit.trace)) for width, fit in fits.items() for i, e in enumerate(fit.eigenvalues, 1)
    ]
    named = df.sparkSession.createDataFrame(shares, "width int, component int, explained double")
    found = found.select("id", "width", "n", "deviation", "identity_error", F.posexplode("white").alias("at", "whitened"))
    return found.withColumn("component", (F.col("at") + 1).cast("int")).join(
        F.broadcast(named), ["width", "component"]  # `components` rows per width
    ).select("id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE: dict[str, str] = {}
