"""Bitmaps of ids, to keep rows that cannot match out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.kept import release

#: Bits for each id, and the most bits (16 MB): beyond that more rows pass, and the join after it does the work.
BITS_PER_ID = 16
MOST_BITS = 1 << 27


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each value of the long column ``id``, in 64-bit words, sized by the number of ids."""
    n = ids.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (BITS_PER_ID * n).bit_length()))
    at = F.pmod("id", F.lit(bits))
    words = ids.select(at.alias("at")).selectExpr("at >> 6 AS word", "1L << cast(at & 63 AS int) AS bit")
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def maybe_member(ids: DataFrame, value: Column) -> Column:
    """False for rows whose long ``value`` is certainly not among ``ids`` (hashes, column ``id``)."""
    words = bitmap(ids)

    @F.arrow_udf("boolean")
    def maybe(places: pa.Array) -> pa.Array:
        release()
        at = places.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return maybe(F.pmod(value, F.lit(64 * len(words))))
