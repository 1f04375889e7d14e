"""Which executed query came from which request.

Requests and executions meet on their SQL text, many to many. The matched sides
are kept apart in :class:`Matched`: reports first reduce each side per matching
key and multiply, so their work grows with the input even when one text repeats
millions of times on both sides. Only :meth:`Matched.pairs` writes out pairs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.functions.sqltext import (
    clean_query_text,
    digest,
    has_text,
    normalize_sql,
    normalize_sql_latency,
    sql_fragment,
)
from spendtrace.schemas import AGENT_TAG, REQUEST_LOG

CASCADE = (None, 100, 50)


def query_history_cost(
    query_history: DataFrame,
    query_attribution: DataFrame,
    as_of: X.Moment,
    days: int = 30,
    tags: Sequence[str] = (AGENT_TAG,),
    text_patterns: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Executions of the last ``days`` days with their attributed compute credits.

    ``how="inner"`` keeps queries with credits > 0. ``how="left"`` keeps all
    selected queries, counts missing credits as 0 and adds ``query_tag``.
    A query is selected by its tag or by any case-insensitive text pattern, in
    which ``_`` and ``%`` are wildcards.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    by_tag = F.col("query_tag").isin(list(tags))
    selected = reduce(lambda a, p: a | F.col("query_text").ilike(p), text_patterns, by_tag)
    queries = query_history.filter(
        (F.col("start_time") >= X.moment(X.days_before(as_of, days))) & X.up_to("start_time", as_of) & selected
    ).select(
        "query_id",
        "query_text",
        *(["query_tag"] if how == "left" else []),
        "start_time",
        "total_elapsed_time",
        "warehouse_name",
        "user_name",
    )
    attributed = query_attribution.select("query_id", "credits_attributed_compute")
    if how == "inner":
        attributed = attributed.filter(F.col("credits_attributed_compute") > 0)
    joined = queries.join(attributed, "query_id", how)
    if how == "left":
        joined = joined.fillna(0.0, ["credits_attributed_compute"])
    return joined.withColumn("cleaned_query_text", clean_query_text("query_text"))


@dataclass(frozen=True)
class Matched:
    """Both sides of a text match, each with ``match_key`` and ``match_tier``."""

    history: DataFrame
    logs: DataFrame
    match_text: Column  # the matched text, computed from request columns

    def pairs(self) -> DataFrame:
        """One row per (request, execution) pair: the reference's own row-level result."""
        executed = self.history.withColumnRenamed("user_name", "exec_user_name").drop("match_tier")
        joined = executed.join(self.logs, "match_key").withColumn("match_key", self.match_text)
        return joined.select(
            "match_key",
            "match_tier",
            *[c for c in executed.columns if c != "match_key"],
            *REQUEST_LOG.names,
            X.total_time("total_elapsed_time", "latency_ms").alias("total_time"),
            X.combined_credits("credits_attributed_compute", "request_credits").alias("total_credits"),
        )


def _tier_digests(text: Column, tiers: Sequence[int | None]) -> Column:
    return F.array(*[digest(sql_fragment(text, n)) for n in tiers])


def with_match_keys(
    df: DataFrame,
    column: str,
    tiers: Sequence[int | None] = CASCADE,
    repairs: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Add ``match_keys``, one digest per tier; NULL where there is no text.

    Saved with a table, the keys let every later match skip the SQL texts. The
    column's metadata names the tiers and repairs, so that a match can refuse others.
    """
    text = F.col("_text")
    keys = F.when(text != "", _tier_digests(text, tiers)).alias("match_keys", metadata={_MADE_BY: _recipe(tiers, repairs)})
    kept = [F.col(f"`{c}`") for c in df.columns if c != "match_keys"]
    return df.withColumn("_text", normalize_sql(column, repairs)).select(*kept, keys)


_MADE_BY = "made_by"


def _recipe(tiers: Sequence[int | None], repairs: Sequence[tuple[str, str]]) -> str:
    return json.dumps({"tiers": list(tiers), "repairs": [list(r) for r in repairs]})


def _check_saved_keys(df: DataFrame, tiers: Sequence[int | None], repairs: Sequence[tuple[str, str]]) -> None:
    """Raise unless the saved keys begin with these tiers and were made with these repairs."""
    made = df.schema["match_keys"].metadata.get(_MADE_BY)
    if made is None:
        raise ValueError("match_keys do not say how they were made: use with_match_keys")
    saved, wanted = json.loads(made), json.loads(_recipe(tiers, repairs))
    if saved["tiers"][: len(tiers)] != wanted["tiers"] or saved["repairs"] != wanted["repairs"]:
        raise ValueError(f"match_keys were made with {saved}, not with {wanted}")


def _usable(df: DataFrame, column: str, tiers, repairs) -> DataFrame:
    """Rows with text and their ``match_keys``, taken as saved or computed."""
    if "match_keys" in df.columns:
        _check_saved_keys(df, tiers, repairs)
        return df.filter(F.col("match_keys").isNotNull())
    # Repairs may empty a text; without them the cheap test says the same.
    text = normalize_sql(column, repairs)
    rows = df.filter(text != "" if repairs else has_text(column)).withColumn("_text", text)
    return rows.withColumn("match_keys", _tier_digests(F.col("_text"), tiers)).drop("_text")


def _first_matching_tier(h: DataFrame, l: DataFrame, tiers: Sequence[int | None]) -> DataFrame:
    """One row: the first tier (from 1) in which the usable sides share a key, or NULL."""
    # Exploding a new array, not the column itself, keeps the optimizer from
    # adding a size test that would normalise every text a second time.
    each = F.array(*[F.get("match_keys", F.lit(i)) for i in range(len(tiers))])
    per_tier = lambda df, side: df.select(
        F.posexplode(each).alias("tier", "key"), F.lit(side).alias("side")
    )
    both = per_tier(h, 1).union(per_tier(l, 2)).groupBy("tier", "key").agg(F.bit_or("side").alias("sides"))
    return both.filter("sides = 3").agg((F.min("tier") + 1).alias("tier"))


def matching_tier(
    history: DataFrame,
    logs: DataFrame,
    tiers: Sequence[int | None] = CASCADE,
    repairs: Sequence[tuple[str, str]] = (),
) -> int:
    """The tier that :func:`match_requests` would choose (0 for none), found tier by tier.

    Each probe computes one digest per row, in binary form, and stops at the first text
    that both sides have; a later tier is probed only if the earlier ones share nothing.
    A text's earlier key determines its later ones, so the sides of a probe are
    reduced to distinct keys before they meet and a hot text is one row.
    """
    h = _usable(history, "cleaned_query_text", tiers, repairs)
    l = _usable(logs, "generated_sql", tiers, repairs)
    for tier in range(1, len(tiers) + 1):
        # A key that cannot be NULL spares the join a NULL test, which would compute the digest again.
        own = F.unhex(F.get("match_keys", F.lit(tier - 1)))
        keys = [df.select(F.coalesce(own, F.lit(side)).alias("key")).distinct() for df, side in ((h, b"h"), (l, b"l"))]
        shared = keys[0].join(keys[1], "key", "left_semi")
        if not shared.isEmpty():
            return tier
    return 0


def match_requests(
    history: DataFrame,
    logs: DataFrame,
    tiers: Sequence[int | None] = CASCADE,
    repairs: Sequence[tuple[str, str]] = (),
    known_tier: int | None = None,
) -> Matched:
    """Match on normalised SQL; a later, shorter prefix counts only if no earlier tier matched at all.

    The choice of tier is one small aggregate over digests of both sides, run as
    a scalar subquery of the same plan; the match itself then runs for that tier
    alone. Without any match the result is empty. Sides that carry
    ``match_keys`` must have been given these tiers (or more after them) and
    the same repairs, else ``ValueError``. ``known_tier`` is the result of
    :func:`matching_tier` for the same sides; the choice is then not made again.
    """
    h = _usable(history, "cleaned_query_text", tiers, repairs)
    l = _usable(logs, "generated_sql", tiers, repairs)
    if known_tier is not None:
        tier = F.lit(known_tier)
    elif len(tiers) == 1:
        tier = F.lit(1)
    else:
        tier = _first_matching_tier(h, l, tiers).scalar()

    def keyed(df: DataFrame, unmatched: str) -> DataFrame:
        # Without a tier each side gets a key the other never has. A key that
        # cannot be NULL also spares the join a NULL test over the whole text.
        key = F.coalesce(F.get("match_keys", F.col("match_tier") - 1), F.lit(unmatched))
        return df.withColumn("match_tier", tier).withColumn("match_key", key).drop("match_keys")

    text = normalize_sql("generated_sql", repairs)
    cases = [(F.col("match_tier") == i, sql_fragment(text, n)) for i, n in enumerate(tiers, 1)]
    matched_text = reduce(lambda c, case: c.when(*case), cases, F)
    return Matched(keyed(h, "history"), keyed(l, "logs"), matched_text)


def match_exact(history: DataFrame, logs: DataFrame, trim: bool = True) -> Matched:
    """Match the cleaned history text with the (trimmed) generated SQL as it stands."""
    text = F.trim(F.col("generated_sql")) if trim else F.col("generated_sql")
    tier = F.lit(1)
    h = history.filter(F.col("cleaned_query_text").isNotNull())
    l = logs.filter(F.col("generated_sql").isNotNull())
    return Matched(
        h.withColumns({"match_tier": tier, "match_key": digest("cleaned_query_text")}),
        l.withColumns({"match_tier": tier, "match_key": digest(text)}),
        text,
    )


def attribute_requests(
    history: DataFrame,
    logs: DataFrame,
    tiers: Sequence[int | None] = CASCADE,
    repairs: Sequence[tuple[str, str]] = (),
    normalize: bool = True,
    known_tier: int | None = None,
) -> DataFrame:
    """Row-level match with total time and combined credits per pair (``known_tier`` as in :func:`match_requests`)."""
    if normalize:
        return match_requests(history, logs, tiers, repairs, known_tier).pairs()
    return match_exact(history, logs).pairs()


# Factor ranges: the product of a sum and a count keeps all nine digits.
_SUM, _COUNT = "decimal(24,9)", "decimal(12,0)"


def _times(total: Column, count: Column) -> Column:
    return total.cast(_SUM) * count.cast(_COUNT)


PAIR_SUMS = (
    "pairs",
    "request_ids",
    "query_ids",
    "request_credits",
    "warehouse_credits",
    "total_credits",
    "latency_sum",
    "latency_count",
)


def pair_sums(matched: Matched | DataFrame, *groups: str | Column) -> DataFrame:
    """Counts and sums over all pairs per request-side group, without forming pairs.

    ``matched`` may also be a frame of pairs, for instance a saved table.
    """
    if isinstance(matched, DataFrame):
        compute, request = X.credits("credits_attributed_compute"), X.credits("request_credits")
        return matched.groupBy(*groups).agg(
            F.count("*").alias("pairs"),
            F.count("request_id").alias("request_ids"),
            F.count("query_id").alias("query_ids"),
            F.sum(request).alias("request_credits"),
            F.sum(compute).alias("warehouse_credits"),
            F.sum(compute + request).alias("total_credits"),
            F.sum("latency_ms").alias("latency_sum"),
            F.count("latency_ms").alias("latency_count"),
        )
    requests = matched.logs.groupBy("match_key", *groups).agg(
        F.count("*").alias("l_rows"),
        F.count("request_id").alias("l_ids"),
        X.sum_credits("request_credits").alias("l_credits"),
        F.count("request_credits").alias("l_priced"),
        F.sum("latency_ms").alias("l_latency"),
        F.count("latency_ms").alias("l_timed"),
    )
    names = [c for c in requests.columns if c != "match_key" and not c.startswith("l_")]
    executions = matched.history.groupBy("match_key").agg(
        F.count("*").alias("h_rows"),
        F.count("query_id").alias("h_ids"),
        X.sum_credits("credits_attributed_compute").alias("h_credits"),
        F.count("credits_attributed_compute").alias("h_priced"),
    )
    c = F.col
    total = lambda e, name: F.sum(e).cast("bigint").alias(name)
    return (
        requests.join(executions, "match_key")
        .groupBy(*names)
        .agg(
            total(_times(c("l_rows"), c("h_rows")), "pairs"),
            total(_times(c("l_ids"), c("h_rows")), "request_ids"),
            total(_times(c("h_ids"), c("l_rows")), "query_ids"),
            F.sum(_times(c("l_credits"), c("h_rows"))).alias("request_credits"),
            F.sum(_times(c("h_credits"), c("l_rows"))).alias("warehouse_credits"),
            F.sum(_times(c("l_credits"), c("h_priced")) + _times(c("h_credits"), c("l_priced"))).alias(
                "total_credits"
            ),
            total(_times(c("l_latency"), c("h_rows")), "latency_sum"),
            total(_times(c("l_timed"), c("h_rows")), "latency_count"),
        )
    )


def join_diagnostics(
    history: DataFrame, logs: DataFrame, repairs: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """One row: usable rows and distinct texts per side, shared texts, pairs, match rate.

    The match rate is full-text pairs per 100 requests, so repeats can lift it over 100.
    Saved ``match_keys`` are used where a side has them; their first tier must be
    the full text, and their repairs these, else ``ValueError``.
    """
    def side(df: DataFrame, column: str, h: int, l: int) -> DataFrame:
        if "match_keys" in df.columns:
            _check_saved_keys(df, (None,), repairs)
        else:
            df = with_match_keys(df, column, (None,), repairs)
        return df.select(F.get("match_keys", F.lit(0)).alias("key"), F.lit(h).alias("h"), F.lit(l).alias("l"))

    both = side(history, "cleaned_query_text", 1, 0).union(side(logs, "generated_sql", 0, 1))
    keys = both.groupBy("key").agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
    usable = F.col("key").isNotNull()
    h, l = F.col("h"), F.col("l")
    pairs = F.coalesce(F.sum(F.when(usable, _times(h, l))), F.lit(0))
    return keys.agg(
        F.coalesce(F.sum(F.when(usable, h)), F.lit(0)).alias("history_rows"),
        F.coalesce(F.sum(F.when(usable, l)), F.lit(0)).alias("log_rows"),
        F.count_if(usable & (h > 0)).alias("history_keys"),
        F.count_if(usable & (l > 0)).alias("log_keys"),
        F.count_if(usable & (h > 0) & (l > 0)).alias("shared_keys"),
        pairs.cast("bigint").alias("matched_pairs"),
        X.half_even(X.divide(pairs, F.sum("l")) * F.lit(100.0), 1).alias("match_rate"),
    )


@dataclass(frozen=True)
class LatencyMatch:
    """Requests and executions keyed by their comment-free text."""

    requests: DataFrame
    executions: DataFrame

    def pairs(self) -> DataFrame:
        """Every usable request, with each execution of its text or none."""
        joined = self.requests.join(self.executions, "match_key", "left").drop("match_key")
        return joined.withColumn(
            "total_latency_ms", X.total_latency("analyst_latency_ms", "execution_time_ms")
        ).withColumns(
            {
                "analyst_latency_sec": X.ms_to_s("analyst_latency_ms"),
                "execution_latency_sec": X.ms_to_s("execution_time_ms"),
                "total_latency_sec": X.ms_to_s("total_latency_ms"),
            }
        )


def match_latency(analyst: DataFrame, executions: DataFrame) -> LatencyMatch:
    """Match requests with executions on SQL text without comments."""

    def keyed(df: DataFrame, column: str) -> DataFrame:
        key = F.coalesce(digest(normalize_sql_latency(column)), F.lit(""))
        return df.filter(has_text(column)).withColumn("match_key", key)

    executed = keyed(executions, "query_text").select(
        "match_key", "query_id", "query_text", "execution_time_ms", "warehouse_name"
    )
    return LatencyMatch(keyed(analyst, "generated_sql"), executed)


def join_latency(analyst: DataFrame, executions: DataFrame) -> DataFrame:
    """Row-level latency join: total and per-part latency in milliseconds and seconds."""
    return match_latency(analyst, executions).pairs()
