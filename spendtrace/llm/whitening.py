"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Entries become integers, x = floor(scale * c) + offset. Over the fit list (each
distinct x-vector once: n vectors with sums S) the scatter
M = n * sum(x x') - S S' is an integer matrix and n^2 times the covariance.

* Tasks sum products exactly; limbs of big values are summed as decimals.
* The characteristic polynomial of M is found modulo enough primes, each by
  reduction to Hessenberg form, in tasks of ``PRIMES_A_TASK`` primes, and put
  together by Chinese remaindering: its integer coefficients are exact.
* All its roots are real, so the sign changes of the coefficients of f(x + t)
  count the roots above t with their multiplicity (Budan and Fourier). Bisection
  over dyadic t encloses the k-th root within a relative ``2**-ROOT_BITS``.
* The null space of M - root is found by inverse iteration in fixed-point
  integers; roots that share an enclosure give an orthonormal basis of theirs.

What reaches the driver is bounded by the dimension d, not by the rows: d(d+1)/2
sums, d+1 residues a prime, and 16 components of d numbers.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries, or entries whose x no long holds, are dropped. The dimension is the
length that most remaining rows have (the smaller of equals); rows of another length
have no x-vector of this list and are dropped too. Repeated rows and ids each
give rows of their own; a null id stays null. Components end where eigenvalues
are zero (the exact rank), so a table of one distinct vector, or an empty one, gives no
rows. ``deviation`` is null where no long holds it; ``deviation_exact`` holds up to 38 digits.
Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace.llm.staging import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
PRIMES_A_TASK = 8
#: Roots are enclosed within this many bits of their size, and vectors computed with PLACES fractional bits.
ROOT_BITS = 192
PLACES = 384
#: Values are summed by limbs of this many bits.
LIMB_BITS = 60
_DIGIT = 20
_ROWS = 4096


# ---------------------------------------------------------------- entries

def shifted(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, flat values floor(scale * c)) of the usable vectors of a list column."""
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0), dtype=np.int64)
    flat = vectors.flatten()  # leaves out null lists
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.floor(values * SCALE)
        bad = ~(np.abs(y) < 2.0**62)
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    ok = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    inside = np.repeat(ok, lengths)
    return np.flatnonzero(ok), lengths[ok], y[inside].astype(np.int64)


def packed(y: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it: equal vectors have equal bytes and others don't."""
    most = int(np.abs(y).max())
    kind = next(k for k in ("i1", "i2", "i4", "i8") if most < 1 << (8 * int(k[1]) - 1))
    return kind[1].encode() + y.astype("<" + kind).tobytes()


def unpacked(codes: list[bytes]) -> Iterator[np.ndarray]:
    """Matrices of packed vectors of one length, a few thousand rows each."""
    by_width: dict[bytes, list[bytes]] = {}
    for c in codes:
        by_width.setdefault(c[:1], []).append(c[1:])
    for width, rows in by_width.items():
        for k in range(0, len(rows), _ROWS):
            part = rows[k : k + _ROWS]
            yield np.frombuffer(b"".join(part), dtype=f"<i{width.decode()}").reshape(len(part), -1).astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, from floating-point products of short digits that stay exact."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    digits, rest = [], y
    while rest.any():
        low = ((rest + (1 << (_DIGIT - 1))) & ((1 << _DIGIT) - 1)) - (1 << (_DIGIT - 1))
        digits.append(low.astype(np.float64))
        rest = (rest - low) >> _DIGIT
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) << (_DIGIT * (i + j))
    return total


def limbs(value: int) -> list[int]:
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB_BITS) - 1)))
        rest >>= LIMB_BITS
    return out


def scatter_sums(fit: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums of y_i y_j over the fit list, with y_0 = 1 (counts and sums are row 0)."""

    def sums(batches):
        total = None
        for batch in batches:
            for y in unpacked(batch.column(0).to_pylist()):
                part = exact_products(np.concatenate([np.ones((len(y), 1), np.int64), y], axis=1))
                total = part if total is None else total + part
        if total is None:
            return
        rows = [(i, j, k, v) for i in range(len(total)) for j in range(i, len(total)) for k, v in enumerate(limbs(int(total[i, j])))]
        i, j, k, v = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64())],
            names=["i", "j", "k", "v"],
        )

    parts = fit.mapInArrow(sums, "i int, j int, k int, v long")
    table = parts.groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toArrow()
    found: dict[tuple[int, int], int] = {}
    for i, j, k, v in zip(*(table[c].to_pylist() for c in "ijkv")):
        found[i, j] = found.get((i, j), 0) + (int(v) << (LIMB_BITS * k))
    return found


# ---------------------------------------------------------------- characteristic polynomial

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2**31), by strong probable-prime tests to bases that decide there."""
    found, p = [], top - 1 - (top % 2)
    while len(found) < count:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1

        def passes(base: int) -> bool:
            x = pow(base, odd, p)
            return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))

        if all(passes(b) for b in (2, 3, 5, 7)):
            found.append(p)
        p -= 2
    return found


def primes_for(matrix: list[list[int]]) -> int:
    """How many primes above 2**30 determine the coefficients: each is at most (1 + trace / d)^d for eigenvalues not below 0."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return (d * (trace // d + 2).bit_length() + 2) // 30 + 1


def polynomial_mod(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(x - matrix) modulo each prime: Hessenberg reduction, then its recurrence."""
    d = len(matrix)
    flat = [v for row in matrix for v in row]
    p1 = np.array(primes, dtype=np.int64)
    a = np.array([[v % q for v in flat] for q in primes], dtype=np.int64).reshape(len(primes), d, d)
    p2, p3 = p1[:, None], p1[:, None, None]
    for m in range(d - 2):
        for b in np.flatnonzero(a[:, m + 1, m] == 0):
            below = np.flatnonzero(a[b, m + 2 :, m])
            if len(below):
                r = m + 2 + int(below[0])
                a[b, [m + 1, r]] = a[b, [r, m + 1]]
                a[b][:, [m + 1, r]] = a[b][:, [r, m + 1]]
        # A zero pivot has only zeros below it, so its inverse is not needed.
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(a[:, m + 1, m], primes)], dtype=np.int64)
        u = a[:, m + 2 :, m] * inverse[:, None] % p2
        a[:, m + 2 :] = (a[:, m + 2 :] - u[:, :, None] * a[:, m + 1][:, None] % p3) % p3
        a[:, :, m + 1] = (a[:, :, m + 1] + (a[:, :, m + 2 :] * u[:, None] % p3).sum(axis=2)) % p2
    polys = np.zeros((len(primes), d + 1, d + 1), dtype=np.int64)
    polys[:, 0, 0] = 1
    for m in range(1, d + 1):
        weights = np.zeros((len(primes), m), dtype=np.int64)
        weights[:, m - 1] = a[:, m - 1, m - 1]
        run = np.ones(len(primes), dtype=np.int64)
        for i in range(m - 2, -1, -1):
            run = run * a[:, i + 1, i] % p1
            weights[:, i] = a[:, i, m - 1] * run % p1
        lower = (weights[:, :, None] * polys[:, :m] % p3).sum(axis=1) % p2
        polys[:, m, 1:] = polys[:, m - 1, :-1]
        polys[:, m] = (polys[:, m] - lower) % p2
    return polys[:, d]


def remaindered(residues: np.ndarray, primes: list[int]) -> list[int]:
    """Integers of least size with the given residues (primes x values)."""
    modulus = math.prod(primes)
    units = [modulus // p * pow(modulus // p, -1, p) for p in primes]
    out = []
    for column in residues.T.tolist():
        value = sum(r * u for r, u in zip(column, units)) % modulus
        out.append(value - modulus if 2 * value > modulus else value)
    return out


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first; primes are dealt over tasks."""
    primes = primes_below(1 << 31, primes_for(matrix))
    blocks = -(-len(primes) // PRIMES_A_TASK)

    def residues(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                own = primes[b * PRIMES_A_TASK : (b + 1) * PRIMES_A_TASK]
                rows = polynomial_mod(matrix, own).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(rows, pa.list_(pa.int64()))], names=["prime", "residues"])

    table = spark.range(0, blocks, 1, blocks).mapInArrow(residues, "prime long, residues array<long>").toArrow()
    return remaindered(np.array(table["residues"].to_pylist(), dtype=np.int64), table["prime"].to_pylist())


# ---------------------------------------------------------------- roots

def roots_above(poly: list[int], t: int) -> int:
    """Number of roots above t, with multiplicity, of a polynomial whose roots are all real."""
    c = list(poly)
    d = len(c) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_sign(poly: list[int], t: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * t + c
    return (total > 0) - (total < 0)


def scaled(poly: list[int], bits: int) -> list[int]:
    """Polynomial whose roots are ``2**bits`` times as large."""
    d = len(poly) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(poly)]


def enclosed_root(poly: list[int], k: int, top: int, bits: int = ROOT_BITS) -> tuple[int, int, int, int]:
    """(low, s, roots above the enclosure, roots within) where the k-th largest root (from 1) lies in (low, low + 1] / 2**s.

    ``top`` is at least the greatest root; the k-th must be above 0.
    """
    s, low, high = 0, 0, max(1, top)
    current, above = poly, 0
    within = roots_above(current, 0)
    while True:
        while high - low > 1:
            mid = (low + high) // 2
            if within - above == 1:
                # One simple root: its sign tells the half. Signs alternate with the number of roots above.
                sign = value_sign(current, mid)
                higher = sign != 0 and (sign < 0) == (above % 2 == 0)
                low, high = (mid, high) if higher else (low, mid)
            elif (n := roots_above(current, mid)) >= k:
                low, within = mid, n
            else:
                high, above = mid, n
        if low.bit_length() > bits:
            return low, s, above, within - above
        grow = max(1, bits + 1 - low.bit_length()) if within - above == 1 else 64
        s, low, high = s + grow, low << grow, high << grow
        current = scaled(poly, s)


# ---------------------------------------------------------------- components

def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> list[list[int]]:
    """Orthonormal vectors (``PLACES`` fractional bits) of the ``count`` eigenvalues at ``root``, by inverse iteration."""
    d = len(matrix)
    # One scale for all: entries below 1, so that rounding is relative to the greatest.
    shift = max(abs(v) for row in matrix for v in row).bit_length()
    one = 1 << PLACES

    def fixed(v: Fraction) -> int:
        return (v.numerator << PLACES) // (v.denominator << shift)

    a = np.array([[fixed(Fraction(matrix[i][j]) - (root if i == j else 0)) for j in range(d)] for i in range(d)], dtype=object)
    order = list(range(d))
    for m in range(d):
        pivot = m + max(range(d - m), key=lambda r: abs(a[m + r, m]))
        if pivot != m:
            a[[m, pivot]] = a[[pivot, m]]
            order[m], order[pivot] = order[pivot], order[m]
        if a[m, m] == 0:
            a[m, m] = 1  # the least number: an exact eigenvalue gives an exact null vector
        if m + 1 < d:
            a[m + 1 :, m] = (a[m + 1 :, m] << PLACES) // a[m, m]
            a[m + 1 :, m + 1 :] -= (a[m + 1 :, m][:, None] * a[m, m + 1 :][None]) >> PLACES

    def solved(v: np.ndarray) -> np.ndarray:
        x = v[order].copy()
        for m in range(d):
            x[m + 1 :] -= (a[m + 1 :, m] * x[m]) >> PLACES
        for m in range(d - 1, -1, -1):
            x[m] = (x[m] << PLACES) // a[m, m]
            x[:m] -= (a[:m, m] * x[m]) >> PLACES
        return x

    def orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for v in vectors:
            v = unit(v)
            for _ in range(2):
                for w in out:
                    v = v - ((w * (int((v * w).sum()) >> PLACES)) >> PLACES)
                v = unit(v)
            out.append(v)
        return out

    def unit(v: np.ndarray) -> np.ndarray:
        # Brought near one first, whatever the solve's growth.
        most = max(1, max(abs(int(x)) for x in v)).bit_length()
        v = v << max(0, PLACES - most) >> max(0, most - PLACES)
        norm = math.isqrt(int((v * v).sum()))
        return (v << PLACES) // max(1, norm)

    # Start vectors from a fixed rule; none is orthogonal to a component but by accident, and rounding mends that.
    rng = np.random.default_rng(11)
    vectors = [rng.integers(-(1 << 30), 1 << 30, d).astype(object) * (one >> 30) for _ in range(count)]
    for _ in range(3):
        vectors = orthonormal([solved(v) for v in vectors])
    return [[int(x) for x in v] for v in vectors]


def component(matrix: list[list[int]], poly: list[int], k: int) -> tuple[Fraction, np.ndarray]:
    """(eigenvalue, unit eigenvector) of the k-th largest eigenvalue, which must be above 0."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    low, s, above, within = enclosed_root(poly, k, trace)
    root = Fraction(2 * low + 1, 1 << (s + 1))
    vector = np.array([x / (1 << PLACES) for x in null_vectors(matrix, root, within)[k - above - 1]])
    # A fixed sign: the entry of greatest size is positive.
    return root, vector * np.sign(vector[np.abs(vector).argmax()])


class Whitening:
    """Mean and components of a fit list; ``scales`` are the square roots of the covariance's eigenvalues."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, scales: np.ndarray, explained: np.ndarray):
        self.n, self.sums = n, sums
        self.components, self.scales, self.explained = components, scales, explained
        # Whole and fractional part, so that y - S/n is rounded once even where y is large.
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([float(Fraction(s % n, n)) for s in sums])
        self.rest = np.array([s % n for s in sums], dtype=object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """rows x components."""
        centred = (y - self.whole).astype(np.float64) - self.part
        return centred @ self.components.T / self.scales

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sums of (n y - S)^2."""
        most = (int(np.abs(y - self.whole).max()) + 1) * self.n
        if most * most * y.shape[1] < 1 << 63:
            d = self.n * (y - self.whole) - self.rest.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * (y - self.whole).astype(object) - self.rest
        return [int(v) for v in (d * d).sum(axis=1)]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the packed distinct vectors (column ``code``); None where no eigenvalue is above 0."""
    spark = fit.sparkSession
    sums = scatter_sums(fit)
    n = sums.get((0, 0), 0)
    if not n:
        return None
    d = fit_length(fit)  # a dimension of zeros has no sums
    s = [sums.get((0, j), 0) for j in range(1, d + 1)]
    matrix = [[n * sums.get((min(i, j), max(i, j)), 0) - s[i - 1] * s[j - 1] for j in range(1, d + 1)] for i in range(1, d + 1)]
    poly = characteristic_polynomial(spark, matrix)
    rank = d - next(i for i, c in enumerate(poly) if c)
    wanted = min(components, rank)
    if not wanted:
        return None

    def solve(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root, vector = component(matrix, poly, k)
                e, share = Fraction(root, n * n), root / sum(matrix[i][i] for i in range(d))
                columns = [pa.array([k]), pa.array([float(e)]), pa.array([float(share)]), pa.array([vector.tolist()])]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "e", "share", "vector"])

    found = spark.range(1, wanted + 1, 1, wanted).mapInArrow(solve, "k long, e double, share double, vector array<double>")
    table = found.toArrow().sort_by("k")
    return Whitening(
        n, s, np.array(table["vector"].to_pylist()), np.sqrt(table["e"].to_numpy()), table["share"].to_numpy()
    )


def fit_length(fit: DataFrame) -> int:
    row = fit.select("code").first()
    return next(unpacked([bytes(row["code"])])).shape[1]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Greatest absolute entry of the fit list's whitened covariance minus the identity, each part centred before multiplying."""

    def moments(batches):
        n, mean, square = 0, None, None
        for batch in batches:
            for y in unpacked(batch.column(0).to_pylist()):
                n, mean, square = merged((n, mean, square), centred_moments(model.whitened(y)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "mean", "square"])

    k = len(model.scales)

    def gathered(parts: pa.Table) -> pa.Table:
        total = (0, None, None)
        for n, mean, square in zip(parts["n"].to_pylist(), parts["mean"].to_pylist(), parts["square"].to_pylist()):
            total = merged(total, (n, np.array(mean), np.array(square).reshape(k, k)))
        return pa.table({"n": [total[0]], "mean": [total[1].tolist()], "square": [total[2].ravel().tolist()]})

    schema = "n long, mean array<double>, square array<double>"
    parts = fit.mapInArrow(moments, schema)
    # One row of k * k numbers a partition.
    table = parts.groupBy().applyInArrow(gathered, schema).toArrow()
    covariance = np.array(table["square"][0].as_py()).reshape(k, k) / table["n"][0].as_py()
    return float(np.abs(covariance - np.eye(k)).max())


def centred_moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merged(a: tuple, b: tuple) -> tuple:
    """Moments (count, mean, centred products) of two parts together."""
    if not a[0]:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


# ---------------------------------------------------------------- operator

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
)


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector of ``vectors`` (vec_id, embedding) and component; see the module's text for the columns' meaning."""
    spark = vectors.sparkSession

    def encode(batches):
        for batch in batches:
            _, lengths, y = shifted(batch.column(0))
            ends = np.cumsum(lengths)
            codes = [packed(y[b - k : b]) for b, k in zip(ends, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int32)), pa.array(codes, pa.binary())], names=["dim", "code"])

    # Each distinct vector once, with how many rows have it; repeats fall away before the shuffle.
    distinct = vectors.select("embedding").mapInArrow(encode, "dim int, code binary")
    distinct = stored(distinct.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("rows")), "distinct-vectors")
    common = distinct.groupBy("dim").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "dim").first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dim = common["dim"]
    fit = distinct.where(F.col("dim") == dim).select("code")
    model = fit_whitening(fit, components)
    if model is None:
        return spark.createDataFrame([], RESULT)
    error = identity_error(fit, model)

    def project(batches):
        k = len(model.scales)
        for batch in batches:
            at, lengths, y = shifted(batch.column(1))
            right = lengths == dim
            at, y = at[right], y[np.repeat(right, lengths)].reshape(-1, dim)
            for a in range(0, len(at), _ROWS):
                part = y[a : a + _ROWS]
                deviations = model.deviations(part)
                rows, each = len(part) * k, pa.array(np.repeat(np.arange(len(part)), k))
                ids = batch.column(0).take(pa.array(at[a : a + _ROWS])).take(each)
                columns = {
                    "vec_id": ids.cast(pa.int64()),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    "n": pa.array(np.full(rows, model.n)),
                    "deviation": pa.array([v if v < 1 << 63 else None for v in deviations], pa.int64()).take(each),
                    "whitened": pa.array(model.whitened(part).ravel()),
                    "explained": pa.array(np.tile(model.explained, len(part))),
                    "identity_error": pa.array(np.full(rows, error)),
                    "deviation_exact": pa.array([v if v < 10**38 else None for v in deviations], pa.decimal128(38, 0)).take(each),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return vectors.select("vec_id", "embedding").mapInArrow(project, RESULT)
