import math

import numpy as np

from spendtrace.llm import multiindex

VECTORS = "vec_id long, embedding array<float>, label int, rep long, cell int, root string"


def brute(rows, threshold=0.93):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    live = [k for k, (i, v, label, *_) in enumerate(rows) if i is not None and label is not None and usable(v)]
    links, parent = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {k: np.array(rows[k][1], np.float32).astype(np.float64) for k in live}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for n, a in enumerate(live):
        for b in live[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((repr((r[0], links[k], find(r[0]), r[0] == find(r[0])))) for k, r in enumerate(rows))


def sample_rows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4])
        rows.append([i, v.astype(np.float32).tolist(), int(i % 3)])
    for i in range(400, 460):
        rows.append([i, rows[7][1], 1])  # copies
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-3.0], [-0.0, 1.0], [0.0, 1.0], [1e-30] * 16, [1e30] * 16]
    for k, v in enumerate(odd):
        rows.append([500 + k, v, 1])
    rows += [[600, rows[7][1], None], [601, rows[7][1], None]]
    return [(*r, 1, 2, "x") for r in rows]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "MEMBERS", 16)
    monkeypatch.setattr(multiindex, "VISITORS", 24)
    rows = sample_rows()
    got = multiindex.similar_vectors(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows)


def test_lower_recall_finds_at_least_its_target(spark):
    rows = [r for r in sample_rows() if r[0] < 400]
    df = spark.createDataFrame(rows, VECTORS)
    full = sum(r.n_links for r in multiindex.similar_vectors(df).collect())
    some = sum(r.n_links for r in multiindex.similar_vectors(df, target_recall=0.9).collect())
    assert 0.9 * full <= some <= full


def test_nothing_to_link(spark):
    assert multiindex.similar_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    alone = multiindex.similar_vectors(spark.createDataFrame([(None, None, None, 1, 1, "x"), (3, None, 1, 1, 1, "x")], VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in alone) == [(0, 0, True), (3, 0, True)]


def test_traversal_is_ascending_and_complete():
    rng = np.random.default_rng(3)
    a, b = np.sort(rng.random(9)).tolist(), np.sort(rng.random(7)).tolist()
    got = list(multiindex.multi_sequence(a, b, 1.1))
    assert [t for *_, t in got] == sorted(t for *_, t in got)
    assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.1}


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = multiindex.unit_rows(rng.normal(size=(500, 8)))
    index = multiindex.MultiIndex(x[:100], 6)
    cells = index.cells(x)
    true = multiindex.squared_distances(x, x)
    for a, found in enumerate(index.traverse(x[:50], 10.0)):
        bound = dict(found)
        assert all(bound[cells[b]] <= true[a, b] + 1e-9 for b in range(500))


def hot_rows():
    """A third of the rows in one tight group, the others pairs at about the threshold."""
    rng = np.random.default_rng(9)
    hot = rng.normal(size=64)
    vectors = [hot + 0.1 * rng.normal(size=64) for _ in range(800)]
    for v in rng.normal(size=(800, 64)):
        vectors += [v, v + 0.36 * rng.normal(size=64)]
    return [(i, v.astype(np.float32).tolist(), i % 2 if i < 800 else i // 2 % 2, 1, 2, "x") for i, v in enumerate(vectors)]


def test_a_hot_group_does_not_set_the_reach_of_the_others(spark):
    rows = hot_rows()
    got = {r.vec_id: r.n_links for r in multiindex.similar_vectors(spark.createDataFrame(rows, VECTORS), target_recall=0.999).collect()}
    units = multiindex.unit_rows(np.array([r[1] for r in rows], np.float32))
    labels = np.array([r[2] for r in rows])
    want = ((units @ units.T >= 0.93) & (labels[:, None] == labels)).sum(axis=1) - 1
    outside = [i for i in range(800, len(rows)) if want[i]]
    assert len(outside) > 1000
    assert all(got[i] <= want[i] for i in range(len(rows)))
    assert np.mean([got[i] == want[i] for i in outside]) >= 0.998  # calibrated over pairs: 0.79
    assert np.mean([got[i] / want[i] for i in range(800)]) >= 0.999
    assert all(got[i] == got[i ^ 1] for i in outside if want[i] == want[i ^ 1] == 1)  # both ends count a link


def test_too_few_vectors_keep_the_exact_bound():
    few, many = np.full(500, 0.01), np.linspace(0, 0.02, 20_000)
    ones = np.ones(20_000, np.int64)
    assert multiindex.reach_for(few, ones[:500], 0.14, 0.999, whole=False) == 0.14
    assert multiindex.reach_for(few, ones[:500], 0.14, 0.999, whole=True) < 0.011
    assert 0.0199 < multiindex.reach_for(many, ones, 0.14, 0.999, whole=False) < 0.02
    assert multiindex.reach_for(many[:0], ones[:0], 0.14, 0.999, whole=True) == 0.14
