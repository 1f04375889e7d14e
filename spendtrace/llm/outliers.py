"""Quality rules: robust multivariate outliers among text statistics.

Every text becomes a few counts. Documents that fail the base rules are out.
The others get a vector of transformed statistics, and each group of language
and source gets a minimum-covariance-determinant (MCD) estimate of location and
scatter: the rows nearest the current estimate, a share ``support`` of the
group, give the next estimate (C-step). A row whose Mahalanobis distance to the
final estimate is beyond ``cutoff`` is an outlier.

The estimates use every row. A C-step is one pass: rows are binned by the
logarithm of their distance, and counts and moments are summed per (group, bin)
with map-side combining, so a group of any size meets as at most a few thousand
bin rows. Only those are handled per group.

Defined results: a null text has no words and fails the base rules, as an empty
one does. Null language and source count as ''. Groups of fewer than
``min_rows`` rows are judged by the estimate of all rows of their language, large
sources included; where that has too few rows, by the estimate of all rows. Only a table
with fewer rows than that has no estimate, and nothing more is rejected. Repeated rows and ties count
as often as they occur. Every row is judged by its own counts: rows that share an id, or have none, are judged apart. Columns other than those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.llm.kept import release
from spendtrace.llm.staging import bounded_batches, stored
from spendtrace.llm.textnum import SPACE, slices, window_hashes, words

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_NEW_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
DIM = 4
BINS_PER_OCTAVE = 16
#: Variance added to each transformed statistic, so that one that hardly varies
#: in a group can't reject by itself for a small deviation.
FLOORS = (0.03**2, 0.06**2, 0.05**2, 0.05**2)


def _repeated_words(windows: np.ndarray) -> int:
    """Words covered by three-word windows that occur twice or more."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(windows) + 2, dtype=bool)
    hits = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        covered[hits + k] = True
    return int(covered.sum())


def _repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def count_statistics(texts: pa.Array) -> pa.StructArray:
    """The :data:`COUNTS` of whole texts."""
    out = np.zeros((len(COUNTS), len(texts)), dtype=np.int64)
    for a, b, joined, at in slices(texts):
        buf = np.frombuffer(joined, dtype=np.uint8)
        starts, _, hashes = words(buf)
        first = np.searchsorted(starts, at)
        out[0, a:b] = np.diff(first)
        out[1, a:b] = np.add.reduceat(_NEW_CHAR[buf] & ~SPACE[buf], at[:-1], dtype=np.int64)
        out[2, a:b] = np.add.reduceat(_SYMBOL[buf], at[:-1], dtype=np.int64)
        windows = window_hashes(hashes, 3)
        for i in range(b - a):
            out[3, a + i] = _repeated_lines(joined[at[i] : at[i + 1] - 1])
            out[4, a + i] = _repeated_words(windows[first[i] : max(first[i], first[i + 1] - 2)])
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=list(COUNTS))


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the struct column ``stats``."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(STATS_TYPE)
    def stats(texts: pa.Array) -> pa.Array:
        release()
        return count_statistics(texts)

    return docs.withColumn("stats", stats(F.col(text))).drop(text)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[F.Column]:
    """Word length, symbols, repeated lines and repeated words, on scales where clean text is roughly symmetric."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dof) < p else (low, middle)
    return high


MOMENTS = ["n"] + [f"s{i}" for i in range(DIM)] + [f"s{i}_{j}" for i in range(DIM) for j in range(i, DIM)]
ESTIMATE = "g string, centre array<double>, precision array<double>"


def _moments() -> list[F.Column]:
    x = [F.col(f"x{i}") for i in range(DIM)]
    return (
        [F.count(F.lit(1)).alias("n")]
        + [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)]
        + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
    )


def concentrate(bins: pd.DataFrame, support: float) -> pd.DataFrame:
    """Next estimate from one group's moments per distance bin: the nearest bins that hold ``support`` of the rows."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy(dtype=np.int64)
    need = math.ceil(support * n.sum())
    take = int(np.searchsorted(np.cumsum(n), need)) + 1
    m = bins[MOMENTS].to_numpy(dtype=np.float64)[:take].sum(axis=0)
    centre = m[1 : 1 + DIM] / m[0]
    scatter = np.zeros((DIM, DIM))
    k = 1 + DIM
    for i in range(DIM):
        for j in range(i, DIM):
            scatter[i, j] = scatter[j, i] = m[k] / m[0] - centre[i] * centre[j]
            k += 1
    if support < 1:  # a trimmed normal sample is too narrow by this factor
        scatter *= support / chi2_cdf(chi2_quantile(support, DIM), DIM + 2)
    scatter += np.diag(FLOORS)
    return pd.DataFrame(
        {
            "g": [bins["g"].iloc[0]],
            "centre": [centre.tolist()],
            "precision": [np.linalg.inv(scatter).ravel().tolist()],
        }
    )


def mahalanobis2() -> F.Column:
    """Squared distance of x0.. from the joined estimate."""
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIM)]
    terms = [
        (1 if i == j else 2) * d[i] * d[j] * F.col("precision")[i * DIM + j] for i in range(DIM) for j in range(i, DIM)
    ]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def with_vectors(stats: DataFrame) -> DataFrame:
    """x0.. added to the rows that pass the base rules; null language and source count as ''."""
    rows = stats.where(~base_failed()).withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    return rows.withColumns({f"x{i}": x for i, x in enumerate(transformed())})


def judging_groups(vectors: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, g, gs): the group that judges their rows (null: too few rows in all) and those whose estimates they are part of."""
    sizes = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.withColumn("small", F.col("n") < min_rows), "group-sizes")
    by_lang = stored(sizes.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.bool_or("small").alias("asks_lang")), "language-sizes")
    of_all = by_lang.agg(F.sum("of_lang")).scalar()
    asks_all = by_lang.agg(F.bool_or(F.col("of_lang") < min_rows)).scalar()
    own = F.when(~F.col("small"), F.concat(F.lit("s\t"), "lang", F.lit("\t"), "source"))
    of_lang = F.when(F.col("asks_lang") & (F.col("of_lang") >= min_rows), F.concat(F.lit("l\t"), "lang"))
    of_any = F.when(asks_all & (of_all >= min_rows), F.lit("a"))
    return sizes.join(by_lang, "lang").select(
        "lang", "source", F.coalesce(own, of_lang, of_any).alias("g"), F.array_compact(F.array(own, of_lang, of_any)).alias("gs")
    )


def mcd_estimates(vectors: DataFrame, support: float, steps: int) -> DataFrame:
    """One estimate per group, after ``steps`` C-steps over all rows and a reweighted last one.

    The start is the coordinate-wise median with robust spreads (a bounded
    quantile sketch); C-steps lower the determinant from there.
    """
    vectors = vectors.where("g is not null")
    quantiles = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"q{i}") for i in range(DIM)]
    start = vectors.groupBy("g").agg(*quantiles)
    spread = [F.lit(1.0) / (F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + F.lit(FLOORS[i])) for i in range(DIM)]
    estimates = start.select(
        "g",
        F.array(*[F.col(f"q{i}")[1] for i in range(DIM)]).alias("centre"),
        F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)]).alias("precision"),
    )
    estimates = stored(estimates, "mcd-start")
    distance_bin = F.floor(F.log2(mahalanobis2() + F.lit(2.0**-20)) * BINS_PER_OCTAVE)
    for _ in range(steps):
        bins = (
            vectors.join(estimates, "g")
            .withColumn("bin", distance_bin)
            .groupBy("g", "bin")
            .agg(*_moments())
        )
        step = bins.groupBy("g").applyInPandas(lambda pdf: concentrate(pdf, support), ESTIMATE)
        estimates = stored(step, "mcd-step")
    within = vectors.join(estimates, "g").where(mahalanobis2() <= chi2_quantile(0.975, DIM))
    moments = within.groupBy("g").agg(*_moments()).withColumn("bin", F.lit(0))
    return stored(moments.groupBy("g").applyInPandas(lambda pdf: concentrate(pdf, 1.0), ESTIMATE), "mcd")


def quality_verdicts(
    docs: DataFrame, support: float = 0.75, steps: int = 4, cutoff: float = 150.0, min_rows: int = 40
) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 (squared Mahalanobis; null without estimate) and kept, per row."""
    stats = document_statistics(docs.select("doc_id", "text", "lang", "source"))
    stats = stored(stats.select("doc_id", "lang", "source", *[F.col("stats")[c].alias(c) for c in COUNTS]), "stats")
    vectors = with_vectors(stats)
    groups = stored(judging_groups(vectors, min_rows), "judging-groups")
    named = vectors.join(groups, ["lang", "source"])
    xs = [f"x{i}" for i in range(DIM)]
    estimates = mcd_estimates(stored(named.select(F.explode("gs").alias("g"), *xs), "vectors"), support, steps)
    # Each row meets the estimate by its own group: ids play no part, so rows that share one have verdicts of their own.
    passed = named.join(estimates, "g", "left").select(
        "doc_id",
        *COUNTS,
        F.lit(False).alias("base_failed"),
        mahalanobis2().alias("distance2"),
        (F.coalesce(mahalanobis2(), F.lit(0.0)) <= cutoff).alias("kept"),
    )
    failed = stats.where(base_failed()).select(
        "doc_id", *COUNTS, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept")
    )
    return passed.union(failed)
