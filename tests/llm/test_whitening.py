import math
from fractions import Fraction

import numpy as np
import pytest

from spendtrace.llm import whitening
from spendtrace.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, code string, dim string"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "y", "z", "w") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def expected(vectors):
    """Brute force over single-precision entries: numpy's eigenvectors, exact sums in Python."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors]
    fit = sorted({tuple(x) for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    return usable, n, sums, values[order], columns[:, order]


def compare(vectors, got, components=16):
    usable, n, sums, values, columns = expected(vectors)
    rank = int((values > 1e-9 * max(values[0], 1e-300)).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(got) == k * len(usable)
    signs = {}
    for i, x in usable:
        for r in by_id[i]:
            assert r.n == n and r.identity_error <= 1e-6
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) == r.deviation_exact
            c = r.component - 1
            assert abs(r.explained - values[c] / values.sum()) <= 1e-9
            want = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ columns[:, c] / math.sqrt(values[c])
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
                assert abs(r.whitened - sign * want) <= 1e-6 * max(1, abs(want))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24))
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(mixed)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(150)]  # copies count once
    vectors.append((3, vectors[3][1]))  # a repeated row
    got = whitening.whitened_vectors(frame(spark, [v for v in vectors if v[0] != 3])).collect()
    compare([v for v in vectors if v[0] != 3], got)
    twice = whitening.whitened_vectors(frame(spark, vectors)).where("vec_id = 3").collect()
    assert len(twice) == 32 and len({(r.component, r.whitened) for r in twice}) == 16


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (93, [math.nan] * 6), (94, [math.inf, 0, 0, 0, 0, 0])]
    odd += [(95, [1.0, 2.0]), (96, [1e30, 0, 0, 0, 0, 0]), (97, [1.0] * 7)]
    got = whitening.whitened_vectors(frame(spark, good + odd)).collect()
    compare(good, got)
    unnamed = whitening.whitened_vectors(frame(spark, good + [(None, good[0][1])])).where("vec_id is null").collect()
    assert len(unnamed) == 6


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, vectors):
    df = whitening.whitened_vectors(frame(spark, vectors))
    assert df.collect() == [] and df.columns[:3] == ["vec_id", "component", "n"]


def test_rank_and_equal_eigenvalues(spark):
    # A cube's corners, moved apart in one more direction by nothing: three equal eigenvalues, one zero.
    corners = [(4 * a + 2 * b + c, [a, b, c, 0.0]) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    got = whitening.whitened_vectors(frame(spark, corners)).collect()
    assert len(got) == 8 * 3 and all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-12 for r in got)
    w = np.zeros((8, 3))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / 8, np.eye(3))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=3) * 1e9).astype(np.float32).tolist()) for i in range(30)]
    got = whitening.whitened_vectors(frame(spark, vectors)).collect()
    usable, n, sums, _, _ = expected(vectors)
    by_id = {r.vec_id: r for r in got}
    for i, x in usable:
        want = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert int(by_id[i].deviation_exact) == want and by_id[i].deviation == (want if want < 1 << 63 else None)
        assert by_id[i].identity_error <= 1e-6


def test_polynomial_and_roots():
    rng = np.random.default_rng(4)
    b = rng.integers(-50, 50, (7, 5))
    m = (b @ b.T).tolist()
    primes = whitening.primes_below(1 << 31, whitening.primes_for(m))
    assert all(all(p % q for q in range(2, 2000)) for p in primes)
    poly = whitening.remaindered(whitening.polynomial_mod(m, primes), primes)
    assert poly[-1] == 1 and poly[0] == poly[1] == 0 and poly[2] != 0  # rank 5
    for t in (-3, 2, 11):
        exact = round(float(np.linalg.det(t * np.eye(7) - np.array(m, float))))
        assert abs(sum(c * t**i for i, c in enumerate(poly)) - exact) <= 1e-6 * abs(exact) + 1
    values = np.linalg.eigvalsh(np.array(m, float))[::-1]
    for k in range(1, 6):
        root, vector = whitening.component(m, poly, k)
        assert abs(float(root) / values[k - 1] - 1) < 1e-12
        assert np.allclose(np.array(m, float) @ vector, float(root) * vector, atol=1e-8)
    # (x - 3)^2 (x - 1): counts know multiplicity.
    double = [-9, 15, -7, 1]
    assert [whitening.roots_above(double, t) for t in (0, 1, 2, 3)] == [3, 2, 2, 0]
    low, s, above, within = whitening.enclosed_root(double, 2, 7)
    assert (above, within) == (0, 2) and low < 3 << s <= low + 1
    # Zero pivots: a matrix already split into blocks.
    split = [[2, 0, 0, 0], [0, 3, 0, 1], [0, 0, 5, 0], [0, 1, 0, 3]]
    got = whitening.remaindered(whitening.polynomial_mod(split, primes), primes)
    assert [round(c) for c in np.poly(np.array(split, float))[::-1]] == got


def test_query(spark):
    df = QUERIES["op11_exact_whitening"](spark, "/root/testdata/sf0.001")
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    compare([(r.vec_id, r.embedding) for r in rows], df.collect())
