import re

import numpy as np
import pyarrow as pa

from spendtrace.llm import outliers
from tests.llm.fixtures import document_rows, documents, no_documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def counts(text):
    data = (text or "").encode()
    words = WORD.findall(data)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in _count(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def _count(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def test_counts_of_whole_texts():
    texts = [r[1] for r in document_rows()] + ["word " * 600_000 + "é* | " * 200_000]
    got = outliers.count_statistics(pa.array(texts, pa.string())).to_pylist()
    for text, row in zip(texts, got):
        if text and len(text) > 1_000_000:
            assert (row["n_words"], row["n_symbols"], row["n_repeat_words"]) == (1_000_000, 400_000, 1_000_000)
        else:
            assert tuple(row.values()) == counts(text)


def test_verdicts(spark):
    rows = document_rows()
    got = outliers.quality_verdicts(documents(spark), min_rows=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[15] is False  # symbols
    assert all(verdict[i] for i in range(20, 60) if counts(rows[i][1])[0] >= 50)


def test_no_documents(spark):
    assert outliers.quality_verdicts(no_documents(spark)).collect() == []


def brute_mcd(x, support, steps):
    """C-steps on a dense matrix, with the operator's distance bins."""
    floors = np.diag(outliers.FLOORS)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    centre, precision = q[1], np.diag(1 / (((q[2] - q[0]) / 1.349) ** 2 + outliers.FLOORS))

    def distance(c, p):
        return np.maximum(np.einsum("ni,ij,nj->n", x - c, p, x - c), 0)

    for _ in range(steps):
        bins = np.floor(np.log2(distance(centre, precision) + 2.0**-20) * outliers.BINS_PER_OCTAVE)
        sub = x[bins <= np.sort(bins)[int(np.ceil(support * len(x))) - 1]]
        factor = support / outliers.chi2_cdf(outliers.chi2_quantile(support, 4), 6)
        centre, precision = sub.mean(0), np.linalg.inv(np.cov(sub.T, bias=True) * factor + floors)
    sub = x[distance(centre, precision) <= outliers.chi2_quantile(0.975, 4)]
    return distance(sub.mean(0), np.linalg.inv(np.cov(sub.T, bias=True) + floors))


def test_estimates_match_a_dense_computation(spark):
    rng = np.random.default_rng(1)
    good = rng.multivariate_normal([1, 2, 0, 1], np.diag([1, 2, 0.5, 1]) + 0.3, 400)
    bad = rng.normal(12, 0.5, (90, 4))
    x = np.concatenate([good, bad])
    frame = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "g string, doc_id long, x0 double, x1 double, x2 double, x3 double")
    estimates = outliers.mcd_estimates(frame, 0.75, 4)
    got = {r.doc_id: r.d for r in frame.join(estimates, "g").select("doc_id", outliers.mahalanobis2().alias("d")).collect()}
    want = brute_mcd(x, 0.75, 4)
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-6)
    assert want[:400].max() < 40 < want[400:].min()


def test_chi2():
    assert abs(outliers.chi2_quantile(0.975, 4) - 11.1433) < 1e-3


def test_small_groups_are_judged_by_their_language_or_by_all_rows(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]

    def prose():
        return " ".join(rng.choice(vocabulary, 120))

    rows = [(i, prose(), "en", "web") for i in range(80)]  # enough rows in one source
    rows += [(100 + i, prose(), "en", f"rare{i % 3}") for i in range(9)]
    rows += [(200 + i, prose(), "fr", "web") for i in range(6)]  # a language of few rows
    rows += [(300, "$$$ %%% " * 60 + prose(), "en", "rare1"), (301, "$$$ %%% " * 60 + prose(), "fr", "web")]
    got = outliers.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.distance2 is not None for r in got)
    assert {r.doc_id for r in got if not r.kept} == {300, 301}


def test_rows_that_share_an_id_are_judged_apart(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]

    def prose():
        return " ".join(rng.choice(vocabulary, 120))

    bad = "$$$ %%% " * 60
    rows = [(i, prose(), "en", "web") for i in range(80)]
    rows += [(7, bad + prose(), "en", "web"), (None, prose(), "en", "web"), (None, bad + prose(), "en", "web"), (7, "too short", "en", "web")]
    got = outliers.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.base_failed, r.kept) for r in got if r.doc_id == 7) == [(False, False), (False, True), (True, False)]
    assert sorted(r.kept for r in got if r.doc_id is None) == [False, True]
    assert all(r.kept for r in got if r.doc_id not in (7, None))
