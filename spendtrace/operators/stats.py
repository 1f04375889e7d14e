"""Exact statistics of whole-number measures (milliseconds, centiseconds).

The built-in exact percentile keeps all distinct values of a group in the
memory of one task. Here a group is first reduced to (value, rows) counts,
which combine on the map side; the wanted ranks are then located by counting
over coarse value buckets, and only the few buckets that hold a wanted rank are
ordered value by value. No task ever sees more than one bucket's values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 10


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    weight: Column | None = None,
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(keys, value) -> rows, plus any further count-like sums.

    ``weight`` is how many rows one input row stands for. NULL values keep
    their counts but weigh nothing in the statistics.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    w = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.withColumns({"_value": v, "_weight": F.when(v.isNotNull(), w).otherwise(F.lit(0))})
    return rows.groupBy(*keys, F.col("_value").alias("value")).agg(
        F.sum("_weight").cast("bigint").alias("rows"),
        *[c.alias(name) for name, c in (counts or {}).items()],
    )


def exact_stats(
    hist: DataFrame,
    keys: Sequence[str] = (),
    quantiles: Mapping[str, float] | None = None,
    counts: Sequence[str] = (),
    with_std: bool = False,
) -> DataFrame:
    """Per group: n, mean, min, max, the named quantiles and summed ``counts``.

    ``hist`` comes from :func:`value_counts`. Quantiles interpolate linearly.
    """
    quantiles = dict(quantiles or {})
    keys = list(keys)
    rows, value = F.col("rows"), F.col("value")
    wide = "decimal(38,0)"
    totals = hist.groupBy(*keys).agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("n"),
        F.sum(value.cast("decimal(18,0)") * rows.cast("decimal(18,0)")).cast(wide).alias("_sum"),
        F.min(F.when(rows > 0, value)).alias("min"),
        F.max(F.when(rows > 0, value)).alias("max"),
        *[F.sum(c).alias(c) for c in counts],
        *(
            [F.sum(value.cast("decimal(18,0)") * value * rows.cast("decimal(18,0)")).cast(wide).alias("_squares")]
            if with_std
            else []
        ),
    )
    parts = totals
    if quantiles:
        # Asking for the counts here too keeps both uses of ``hist`` alike.
        used = hist.filter(F.greatest(rows, *counts) > 0 if counts else rows > 0)
        parts = totals.unionByName(_quantiles(used, keys, quantiles), allowMissingColumns=True)
        merged = [c for c in parts.columns if c not in keys]
        parts = parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in merged])
    n, s = F.col("n").cast("double"), F.col("_sum")
    out = [*keys, "n", F.try_divide(s.cast("double"), n).alias("mean")]
    if with_std:
        # Exact integers until the last step: no cancellation. Where these have too many digits, doubles.
        exact = F.try_subtract(F.try_multiply(F.col("n").cast("decimal(19,0)"), F.col("_squares")), F.try_multiply(s, s))
        rough = n * F.col("_squares").cast("double") - s.cast("double") * s.cast("double")
        spread = F.coalesce(exact.cast("double"), F.greatest(rough, F.lit(0.0)))
        out.append(F.sqrt(F.try_divide(spread, n * (n - 1))).alias("std"))
    return parts.select(*out, "min", "max", *quantiles, *counts)


def _quantiles(hist: DataFrame, keys: list[str], quantiles: Mapping[str, float]) -> DataFrame:
    # A bucket that cannot be NULL adds no filter of its own, so all branches
    # share one exchange of ``hist`` and the source is scanned once.
    bucket = F.coalesce(F.shiftright("value", BUCKET_BITS), F.lit(0))
    # Entries without rows (NULL values) add nothing to a running count and match no rank.
    counted = hist.select(*keys, bucket.alias("bucket"), "value", "rows")
    by_bucket = counted.groupBy(*keys, "bucket").agg(F.sum("rows").alias("in_bucket"))
    # A group has at most (value range / 1024) buckets here, whatever its number of rows.
    group = Window.partitionBy(*keys)
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = by_bucket.select(
        *keys,
        "bucket",
        (F.sum("in_bucket").over(running) - F.col("in_bucket")).alias("before"),
        "in_bucket",
        F.sum("in_bucket").over(group).alias("total"),
    )
    # Ranks are zero-based; each quantile needs the two ranks around its position.
    position = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    low = {name: F.floor(p) for name, p in position.items()}
    high = {name: F.ceil(p) for name, p in position.items()}
    ranks = [r for name in quantiles for r in (low[name], high[name])]
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("in_bucket"))
    wanted = by_bucket.filter(F.exists(F.array(*ranks), inside)).drop("in_bucket")

    in_order = Window.partitionBy(*keys, "bucket").orderBy("value")
    located = (
        counted.join(wanted, [*keys, "bucket"])
        .withColumn("upto", F.col("before") + F.sum("rows").over(in_order))
        .withColumn("from", F.col("upto") - F.col("rows"))
    )
    here = lambda r: (r >= F.col("from")) & (r < F.col("upto"))
    picked = located.groupBy(*keys).agg(
        *[
            F.max(F.when(here(rank[name]), F.col("value"))).alias(f"_{side}_{name}")
            for name in quantiles
            for side, rank in (("low", low), ("high", high))
        ],
        *[F.max(position[name] - low[name]).alias(f"_share_{name}") for name in quantiles],
    )
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_low_{name}")
                + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * F.col(f"_share_{name}")
            ).alias(name)
            for name in quantiles
        ],
    )
