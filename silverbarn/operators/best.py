"""Best-provider view of bars: one row per instrument and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank and staleness in days of a provider without a rule.
NO_PRIORITY = 999
NO_STALENESS = 36500


def best_provider(
    bars: DataFrame, defaults: DataFrame, overrides: DataFrame, as_of: str, keys: Sequence[str] = ("canonical_id", "day"), provider: str = "provider"
) -> DataFrame:
    """The bar of the provider that ranks first.

    Order: priority (override, else default, else 999), fresh before stale
    (age in days within the override's, else the default's staleness, else
    36500), provider name. Priority and staleness of an override fall back
    independently. ``overrides`` has the first key, the provider, priority and
    staleness_days; ``defaults`` the provider, priority and staleness_days; of
    repeated rules the lowest priority and the longest staleness hold. One
    aggregate, folded on the map side: no window sorts the bars.
    """
    cid, day = keys
    rule = lambda rows, by, p, s: rows.groupBy(*by).agg(F.min("priority").alias(p), F.max("staleness_days").alias(s))
    d, o = rule(defaults, [provider], "_dp", "_ds"), rule(overrides, [cid, provider], "_op", "_os")
    joined = bars.join(d, provider, "left").join(o, [cid, provider], "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.col(day))
    ranked = joined.withColumns(
        {
            "prio": F.coalesce("_op", "_dp", F.lit(NO_PRIORITY)),
            "stale_days": F.coalesce("_os", "_ds", F.lit(NO_STALENESS)),
            "age_days": age,
        }
    ).drop("_dp", "_ds", "_op", "_os")
    fresh = F.when(F.col("age_days") <= F.col("stale_days"), 0).otherwise(1)
    rest = [c for c in ranked.columns if c not in keys]
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col("prio"), fresh.alias("late"), F.col(provider))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(ranked.columns)


#: Columns a caller may ask for, with their aliases.
BAR_COLUMNS = {"open": "open", "high": "high", "low": "low", "close": "close", "adj_close": "adj_close", "adjusted_close": "adj_close", "volume": "volume", "dividend": "dividend"}


def projected(bars: DataFrame, columns: Sequence[str] = ("close",), always: Sequence[str] = ("start_ts", "provider")) -> DataFrame:
    """The asked columns under the asked names, each once, after the columns that are always there; unknown names raise."""
    names = list(dict.fromkeys(c.strip().lower() for c in columns)) or ["close"]
    unknown = [c for c in names if c not in BAR_COLUMNS]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return bars.select(*always, *[F.col(BAR_COLUMNS[c]).alias(c) for c in names])


def between(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows within the bounds that are given, both inclusive; a null column drops out where a bound is given."""
    for bound, keep in ((start, F.col(column) >= F.lit(start).cast("date")), (end, F.col(column) <= F.lit(end).cast("date"))):
        df = df.where(keep) if bound is not None else df
    return df


def latest(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(column).alias(column))
