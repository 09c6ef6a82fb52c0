"""Implausible readings per source: robust decomposition, ESD limits, runs and ranges.

A series is one provider's bars of one instrument. Each field is decomposed on
the log scale into an edge-preserving robust trend (the nearer of the running
medians of the bars before and after, so that a lasting change of level leaves
no remainder), a weekday season and a remainder. Spikes are found by the
generalised extreme studentised deviate test in its robust, externally
studentised form: readings are taken out one by one, the most deviating first,
each measured by the spread of those that remain. Range and constant-run checks
are separate.

Series are cut into blocks of BLOCK_DAYS calendar days with a halo on either
side, so a task's share is bounded by days, not by the length of a series. All
work inside a block is vectorised over many series at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("close", "adj_close", "volume")
BLOCK_DAYS = 1024
HALO_DAYS = 128
#: Bars that a spike lasts at most; a longer stay is a change of level.
SPIKE = 3
#: Bars before and after a reading that give its level; most of them lie outside a spike.
SIDE = 2 * SPIKE - 1
#: From the median absolute deviation to the standard deviation of a normal distribution.
MAD = 1.4826
#: Level of the test. The remainders of ordinary readings have exponential, not normal tails (each scale further out
#: leaves about a quarter of them), so the level is far below a usual one: the limit is near 8 scales in long series.
ALPHA = 1e-12
#: Least number of bars of a run without change.
RUN = 5
#: Rows gathered before a vectorised step; a block is never cut.
STEP_ROWS = 150_000
NO_DAY = -(10**6)

_SCHEMA = "bar_id bigint, field_name string"


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h / a


@lru_cache(maxsize=100_000)
def esd_limit(n: int, alpha: float) -> float:
    """Limit for the most deviating of ``n`` readings, measured by the spread of the other n - 1 (two-sided).

    This is the t quantile behind Rosner's lambda, which measures by the spread
    of all n: a robust spread is not widened by the reading under test, so the
    bound (n - 1) / sqrt(n) of lambda would be reached by ordinary readings of
    short series.
    """
    if n < 4:
        return math.inf
    df, p = n - 2, alpha / (2 * n)
    lo, hi = 0.0, 1e9
    for _ in range(100):
        mid = (lo + hi) / 2
        if 0.5 * _beta_tail(df / 2, 0.5, df / (df + mid * mid)) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def rosner_lambda(n: int, alpha: float) -> float:
    """The limit in the tables of the test, for deviates measured by the spread of all n readings."""
    t = esd_limit(n, alpha)
    return (n - 1) * t / math.sqrt((n - 2 + t * t) * n)


def _group_median(values: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Median of every group; NaN for empty groups. ``group`` need not be sorted."""
    order = np.lexsort((values, group))
    v, counts = values[order], np.bincount(group, minlength=n_groups)
    start = np.cumsum(counts) - counts
    out = np.full(n_groups, np.nan)
    has = counts > 0
    low, high = start + (counts - 1) // 2, start + counts // 2
    out[has] = (v[low[has]] + v[high[has]]) / 2
    return out


def _side_median(x: np.ndarray, series: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the SIDE values before (step -1) or after (+1) each one in its series, and how many there are."""
    n = len(x)
    window = np.full((n, SIDE), np.inf)
    for k in range(1, SIDE + 1):
        if k >= n:
            break
        here, there = (slice(k, None), slice(None, -k)) if step < 0 else (slice(None, -k), slice(k, None))
        same = series[here] == series[there]
        window[here, k - 1] = np.where(same, x[there], np.inf)
    count = np.isfinite(window).sum(1)
    window.sort(1)
    rows = np.arange(n)
    mid = (window[rows, np.maximum(count - 1, 0) // 2] + window[rows, np.minimum(count // 2, SIDE - 1)]) / 2
    return np.where(count > 0, mid, np.nan), count


def _stay(dx: np.ndarray, ds: np.ndarray, slot: np.ndarray, value: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """Bars in a row around each entry that share its deviation, counted up to SPIKE on either side."""
    near = np.abs(rem) / 2
    length = np.ones(len(value), np.int64)
    for step in (-1, 1):
        going = rem != 0
        for k in range(1, SPIKE + 1):
            at = slot + step * k
            inside = (at >= 0) & (at < len(dx))
            at = np.clip(at, 0, len(dx) - 1)
            going = going & inside & (ds[at] == ds[slot]) & (np.abs(dx[at] - value) < near)
            length += going
    return length


def remainders(series: np.ndarray, day: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(remainder, least scale of its series) of distinct (series, day, log value) entries.

    The scale of a series is never below its usual movement from bar to bar.

    ``series`` counts from 0; entries are sorted by series and day, the last
    of a day stands for the day in the levels of its neighbours.
    """
    n = len(value)
    n_series = int(series[-1]) + 1 if n else 0
    last = np.ones(n, bool)
    last[:-1] = (series[1:] != series[:-1]) | (day[1:] != day[:-1])
    slot = np.cumsum(last) - last  # the day's place among the days
    ds, dx = series[last], value[last]
    (left, nl), (right, nr) = _side_median(dx, ds, -1), _side_median(dx, ds, 1)
    left, right, nl, nr = left[slot], right[slot], nl[slot], nr[slot]
    dl, dr = value - left, value - right
    # the remainder over the nearer level; 0 when the reading lies between both
    rem = np.where(np.sign(dl) == np.sign(dr), np.where(np.abs(dl) < np.abs(dr), dl, dr), 0.0)
    rem[(nl == 0) | (nr == 0)] = 0.0
    rem[_stay(dx, ds, slot, value, rem) > SPIKE] = 0.0
    cell = series * 7 + (day % 7)
    season = _group_median(rem, cell, n_series * 7)
    sizes = np.bincount(cell, minlength=n_series * 7)
    season[sizes < 12] = 0.0  # too few to tell a weekday's habit
    rem = rem - season[cell]
    rem[(nl == 0) | (nr == 0)] = 0.0
    # the usual movement: from bar to bar, days without any change left out
    same = np.zeros(len(dx), bool)
    same[1:] = ds[1:] == ds[:-1]
    move = np.zeros(len(dx))
    move[1:] = np.abs(np.diff(dx))
    moved = same & (move > 0)
    scale = np.fmax(MAD * _group_median(move[moved], ds[moved], n_series) / math.sqrt(2), 1e-6)
    return np.where(np.isfinite(rem), rem, 0.0), scale[series]


def esd_outliers(rem: np.ndarray, floor: np.ndarray, series: np.ndarray, alpha: float) -> np.ndarray:
    """Which remainders the generalised ESD test rejects.

    The most deviating reading of a series is taken out, the spread of the rest
    found anew (median absolute remainder, ``floor`` at least), and so on; the
    readings up to the last one above its limit are rejected. Up to half of a
    series can be, as beyond that the median itself would be an outlier's.
    """
    out = np.zeros(len(rem), bool)
    size = np.abs(rem)
    if not (size > 3 * floor).any():
        return out
    order = np.lexsort((size, series))
    a, s = size[order], series[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[begin, len(s)])
    start, count = np.repeat(begin, n), np.repeat(n, n)
    at = np.flatnonzero(a > 3 * floor[order])  # below that no limit lies
    place = at - start[at]
    left = place + 1  # readings not yet taken out, the one under test with them
    keep = left > (count[at] + 1) // 2
    at, place, left = at[keep], place[keep], left[keep]
    lo, hi = start[at] + np.maximum(place - 1, 0) // 2, start[at] + place // 2
    spread = MAD * (a[lo] + a[hi]) / 2
    kinds, inverse = np.unique(left, return_inverse=True)
    limit = np.array([esd_limit(int(k), alpha) for k in kinds])[inverse]
    above = a[at] > limit * np.maximum(spread, floor[order[at]])
    least = np.full(int(s.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, s[at[above]], place[above])
    out[order[at[place >= least[s[at]]]]] = True
    return out


def constant_runs(series: np.ndarray, day: np.ndarray, value: np.ndarray, quiet: np.ndarray) -> np.ndarray:
    """Entries within RUN or more bars in a row of one value, without the first day.

    ``quiet`` entries (a zero volume is reported) end a run. Entries are
    distinct by (series, day, value) and sorted by series and day.
    """
    n = len(value)
    out = np.zeros(n, bool)
    if not n:
        return out
    new_day = np.r_[True, (series[1:] != series[:-1]) | (day[1:] != day[:-1])]
    place = np.cumsum(new_day)
    use = np.flatnonzero(~quiet)
    order = use[np.lexsort((place[use], value[use], series[use]))]
    if not len(order):
        return out
    s, v, p = series[order], value[order], place[order]
    starts = np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1] + 1)]
    begin = np.flatnonzero(starts)
    length = np.diff(np.r_[begin, len(order)])
    out[order[np.repeat(length >= RUN, length) & ~starts]] = True
    return out


def judge(series: np.ndarray, day: np.ndarray, fields: dict[str, np.ndarray], alpha: float) -> dict[str, np.ndarray]:
    """Flags per row and field. Rows are sorted by series, day and arrival; NaN means missing."""
    volume = fields["volume"]
    out = {}
    for name, x in fields.items():
        bad = (x < 0) if name == "volume" else (x <= 0)
        flag = bad.copy()
        use = np.flatnonzero(np.isfinite(x) & ~bad & (day != NO_DAY))
        if len(use):
            s, d, v = series[use], day[use], x[use]
            quiet = volume[use] == 0
            # distinct readings of a day; one silent delivery silences the reading
            order = np.lexsort((v, d, s))
            so, do, vo = s[order], d[order], v[order]
            new = np.r_[True, (so[1:] != so[:-1]) | (do[1:] != do[:-1]) | (vo[1:] != vo[:-1])]
            entry = np.empty(len(use), np.int64)
            entry[order] = np.cumsum(new) - 1
            n = int(entry.max()) + 1
            arrival = np.zeros(n, np.int64)
            arrival[entry] = np.arange(len(use))  # the latest row of the reading
            still = np.zeros(n, bool)
            np.logical_or.at(still, entry, quiet)
            by = np.lexsort((arrival, d[arrival], s[arrival]))
            es, ed, ev = s[arrival[by]], d[arrival[by]], v[arrival[by]]
            hit = np.zeros(n, bool)
            hit[by] = constant_runs(es, ed, ev, still[by])
            pos = np.flatnonzero(ev > 0)
            if len(pos):
                ids, cs = np.unique(es[pos], return_inverse=True)
                rem, floor = remainders(cs, ed[pos], np.log(ev[pos]))
                hit[by[pos[esd_outliers(rem, floor, cs, alpha)]]] = True
            flag[use] |= hit[entry]
        out[name] = flag
    return out


def _flags(alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, day, core, bar = cols[:4]
            series = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            flags = judge(series, day, dict(zip(FIELDS, cols[4:])), alpha)
            ids, names = [], []
            for name, flag in flags.items():
                got = bar[flag & core]
                ids.append(got)
                names += [name] * len(got)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(names, pa.string())], ["bar_id", "field_name"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [c.astype(bool) if i == 2 else c.astype(float) if i > 3 else c for i, c in enumerate(cols)]
            held.append(cols)
            rows += batch.num_rows
            if rows >= STEP_ROWS:
                joined = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(joined[0], joined[0][-1], "left"))  # keys ascend
                if cut:
                    yield judged([c[:cut] for c in joined])
                held, rows = [[c[cut:] for c in joined]], len(joined[0]) - cut
        if held:
            yield judged([np.concatenate(c) for c in zip(*held)])

    return run


def implausible(bars: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(bar_id, field_name) of every implausible reading of close, adj_close and volume.

    * range: a price not above zero, a negative volume;
    * spike: beyond the ESD limit at ``alpha`` on both sides of its
      neighbourhood, so that the series returns; the first and last bar of a
      series cannot be told from a change of level and are no spikes;
    * run: RUN or more bars in a row with one value and no zero volume
      reported, without the first.

    Each delivery is judged by its own value; several deliveries of a day do
    not lengthen a run. Null and NaN readings are never flagged and do not
    interrupt a series. A bar without a date is only checked for its range,
    one without a bar_id not at all.
    Repeated rows give one result row per bar_id. Extra columns are ignored.
    """
    day = F.coalesce(F.unix_date("start_ts"), F.lit(NO_DAY))
    place = F.pmod(F.col("day"), F.lit(BLOCK_DAYS))
    block = F.floor(F.col("day") / BLOCK_DAYS).cast("int")
    rows = bars.where(F.col("bar_id").isNotNull()).select("bar_id", "canonical_id", "provider_id", day.alias("day"), *[F.col(f).cast("double") for f in FIELDS])
    blocks = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(True).alias("core")),
            F.when(place < HALO_DAYS, F.struct((block - 1).alias("block"), F.lit(False).alias("core"))),
            F.when(place >= BLOCK_DAYS - HALO_DAYS, F.struct((block + 1).alias("block"), F.lit(False).alias("core"))),
        )
    )
    keyed = rows.select("*", F.inline(blocks)).select(F.xxhash64("canonical_id", "provider_id", "block").alias("key"), "day", "core", "bar_id", *FIELDS)
    parts = keyed.repartition("key").sortWithinPartitions("key", "day", "bar_id")
    return parts.mapInArrow(_flags(alpha), _SCHEMA).distinct()
