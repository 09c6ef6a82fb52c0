"""Survivors by declared order and by the latent quality of sources."""

import math
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverbarn.llm import survivor

BAR = "bar_id bigint, canonical_id string, start_ts date, adj_close double, close double, volume double, provider_id int, ingested_at timestamp"
PRIORITY = "provider_id int, instrument_type string, priority int, staleness_days int"


def _bar(i, cid, day, close, provider, hour, adj=None, volume=None):
    return (i, cid, day, adj, close, volume, provider, datetime(2026, 6, 1, hour))


def test_survivor_order_of_preference(spark):
    day = date(2026, 6, 1)
    bars = [
        _bar(1, "sec:x", day, 1.0, 1, 1),
        _bar(2, "sec:x", day, None, 2, 2, adj=5.0),
        _bar(3, "sec:x", day, 3.0, 2, 1),
        _bar(4, "fx:a", day, 1.0, 9, 3),
        _bar(5, "fx:a", day, 2.0, 9, 3),
        _bar(6, "fx:b", day, 2.0, 9, 3),
        _bar(7, "etf:s", date(2020, 1, 1), 1.0, 3, 9),
        _bar(8, "etf:s", date(2020, 1, 1), 1.0, 4, 1),
    ]
    rules = [(1, None, 10, None), (2, "security", 5, 30), (2, "security", 5, 400), (2, None, 50, 1), (3, None, 7, 30), (4, None, 7, None)]
    got = {r.canonical_id: (r.close_bar_id, r.adj_close_bar_id, r.volume_bar_id) for r in survivor.survivors(spark.createDataFrame(bars, BAR), spark.createDataFrame(rules, PRIORITY)).collect()}
    assert got == {"sec:x": (3, 2, 0), "fx:a": (4, 0, 0), "etf:s": (8, 0, 0)}


def test_survivor_nulls_empty_and_clashing_columns(spark):
    bars = spark.createDataFrame([(1, None, None, 1.0, 1.0, 1.0, None, None), (2, None, None, 1.0, None, 1.0, 1, datetime(2026, 1, 1))], BAR)
    rules = spark.createDataFrame([], PRIORITY)
    row = survivor.survivors(bars.withColumns({"_rank": F.lit(1), "priority": F.lit(2)}), rules).collect()
    assert [tuple(r) for r in row] == [(None, None, 1, 2, 2)]
    assert survivor.survivors(spark.createDataFrame([], BAR), rules).count() == 0


def _world(seed, days=400):
    """Bars of five sources of known sensitivity; wrong values are each source's own. Source 5 counts volume in hundreds."""
    rng = np.random.default_rng(seed)
    right = {1: 0.98, 2: 0.95, 3: 0.9, 4: 0.35, 5: 0.8}
    bars, true, i = [], {}, 0
    for d in range(days):
        day = date(2024, 1, 1) + timedelta(days=d)
        close, volume = float(rng.uniform(10, 1000)), float(rng.uniform(1e5, 1e6))
        true[day] = close
        for p, s in right.items():
            if rng.random() < 0.8:
                i += 1
                told = close if rng.random() < s else close * float(np.exp(rng.choice([-1, 1]) * rng.uniform(0.1, 1)))
                bars.append(_bar(i, "sec:x", day, told * (1 + rng.uniform(-1e-4, 1e-4)), p, 5, volume=volume / (100 if p == 5 else 1)))
                if rng.random() < 0.2:
                    i += 1
                    bars.append(_bar(i, "sec:x", day, told * 3, p, 1))  # corrected later
    return bars, true, right


def test_truth_model_finds_planted_quality(spark):
    bars, true, right = _world(3, 1200)
    judged, quality = survivor.truth_model(spark.createDataFrame(bars, BAR))
    q = {(r.field, r.provider_id): r for r in quality.collect()}
    assert all(abs(q["close", p].sensitivity - s) < 0.05 for p, s in right.items())
    assert {p: q["volume", p].unit_power for p in right} == {1: 0, 2: 0, 3: 0, 4: 0, 5: -2}
    rows = [r for r in judged.collect() if r.field == "close"]
    told = {}
    for b in sorted(bars, key=lambda b: b[7]):
        told.setdefault(b[2], {})[b[6]] = b[4]
    best = {}
    for r in rows:
        best[r.start_ts] = max(best.get(r.start_ts, (0, 0)), (r.posterior, r.value))
    assert set(best) == set(told)  # every claimed group keeps a value
    near = lambda a, b: abs(math.log(a / b)) < 0.01
    contested = [d for d, t in told.items() if not all(near(a, b) for a in t.values() for b in t.values()) and any(near(v, true[d]) for v in t.values())]
    assert len(contested) > 200 and sum(near(best[d][1], true[d]) for d in contested) >= 0.95 * len(contested)


def test_truth_model_against_brute_force(spark):
    bars, _, _ = _world(5, 60)
    _, quality = survivor.truth_model(spark.createDataFrame(bars, BAR), ("close",))
    told = {}
    for b in sorted(bars, key=lambda b: b[7]):
        told.setdefault(b[2], {})[b[6]] = b[4]
    patterns = Counter()
    for t in told.values():
        facts = []
        for s, v in sorted(t.items(), key=lambda x: x[1]):
            if facts and math.log(v / facts[-1][-1][1]) <= 0.005:
                facts[-1].append((s, v))
            else:
                facts.append([(s, v)])
        for f in facts if len(t) > 1 else []:
            yes = frozenset(s for s, _ in f)
            patterns[yes, frozenset(t) - yes] += 1
    p = {k: len(k[0]) / (len(k[0]) + len(k[1])) for k in patterns}
    for _ in range(200):
        sens, spec = {}, {}
        for s in range(1, 6):
            seen = [(k, n) for k, n in patterns.items() if s in k[0] | k[1]]
            t, f = sum(n * p[k] for k, n in seen), sum(n * (1 - p[k]) for k, n in seen)
            sens[s] = (sum(n * p[k] for k, n in seen if s in k[0]) + 1.6) / (t + 2)
            spec[s] = (sum(n * (1 - p[k]) for k, n in seen if s in k[1]) + 1.8) / (f + 2)
        base = math.log((sum(n * p[k] for k, n in patterns.items()) + 1) / (sum(n * (1 - p[k]) for k, n in patterns.items()) + 1))
        for k in patterns:
            odds = base + sum(math.log(sens[s] / (1 - spec[s])) for s in k[0]) + sum(math.log((1 - sens[s]) / spec[s]) for s in k[1])
            p[k] = 1 / (1 + math.exp(-odds))
    for r in quality.collect():
        assert r.sensitivity == pytest.approx(sens[r.provider_id], abs=2e-3) and r.specificity == pytest.approx(spec[r.provider_id], abs=2e-3)


def test_a_field_keeps_all_values_judged_true_and_lone_claims(spark):
    bars, _, _ = _world(7, 120)
    days = [date(2025, 1, 1) + timedelta(days=d) for d in range(3)]
    n = 10_000
    bars += [_bar(n + p, "sec:y", days[0], 50.0 if p < 3 else 80.0, p, 1) for p in (1, 2, 3, 5)]  # two sources each
    bars += [_bar(n + 9, "sec:y", days[1], 7.0, 4, 1), _bar(n + 10, "sec:y", days[2], -1.0, 4, 1), _bar(n + 11, "sec:y", days[2], 0.0, 1, 1), _bar(n + 12, None, None, float("nan"), 1, 1), _bar(n + 13, "sec:z", days[0], 1.0, None, 1)]
    judged, _ = survivor.truth_model(spark.createDataFrame(bars, BAR).withColumn("source", F.lit("x")).withColumn("field", F.lit(1)), ("close",))
    got = {}
    for r in judged.where("canonical_id = 'sec:y' OR canonical_id IS NULL OR canonical_id = 'sec:z'").collect():
        got.setdefault(r.start_ts, set()).add(r.value)
    assert 50.0 in got[days[0]] and got[days[1]] == {7.0} and got[days[2]] and set(got) == set(days)
    empty, none = survivor.truth_model(spark.createDataFrame([], BAR), ("close",))
    assert empty.count() == 0 and none.count() == 0
