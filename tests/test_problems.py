"""Nested tables and outliers on small inputs."""

import json
from datetime import date, datetime, timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from silverbarn.operators import nested, outliers

BAR = "bar_id bigint, canonical_id string, start_ts date, adj_close double, close double, volume double, provider_id int, ingested_at timestamp"


def _bar(i, cid, day, close, provider, hour, adj=None, volume=None):
    return (i, cid, day, adj, close, volume, provider, datetime(2026, 6, 1, hour))


def test_intervals_enclose_descendants():
    doc = {"a": [{"b": 1}, [2, None]], "c": {"d": "x"}, "e": []}
    nodes = nested.walk(json.dumps(doc))
    spans = {(n[0], n[4]): (n[2], n[3]) for n in reversed(nodes)}
    inside = lambda x, y: spans[y][0] < spans[x][0] and spans[x][1] < spans[y][1]
    assert inside(("a.b", 0), ("a", 0)) and inside(("a", 0), ("a[]", 0)) and inside(("c.d", 0), ("c", 0))
    assert not inside(("c.d", 0), ("a[]", 0))
    assert sorted(n[2] for n in nodes) == list(range(len(nodes))) == sorted(n[3] for n in nodes)
    assert nested.walk("[1]") is None and nested.walk('{"a": ') is None and nested.walk("[" * 100_000) is None


def test_submissions_of_every_shape(spark):
    t = datetime(2026, 1, 1)
    full = {"tickers": ["A", None, "B"], "formerNames": {"name": "Old"}, "filings": {"files": [{"name": "p1"}, {"n": 2}], "recent": {"accessionNumber": ["1-2", "", "1-2", "3", None, "9"], "form": ["a"] * 5, "filingDate": ["d"] * 6}}}
    rows = [
        ("1", t, json.dumps(full)),
        ("1", t + timedelta(days=1), '{"damaged'),
        ("2", t, json.dumps({"tickers": "X", "filings": {"recent": [{"accessionNumber": "7-8", "form": None, "filingDate": "d"}, {"accessionNumber": "7-9", "form": "f"}, {"accessionNumber": "78", "form": "f", "filingDate": "d"}]}})),
        ("3", t, json.dumps({"filings": {"recent": {"accessionNumber": "5", "form": "f", "filingDate": "d"}, "files": {"name": "p"}}, "tickers": None})),
        ("3", t - timedelta(days=1), json.dumps({"tickers": ["OLD"]})),
        ("4", t, None),
        (None, t, json.dumps(full)),
    ]
    df = spark.createDataFrame(rows, "cik string, fetched_at timestamp, payload string").withColumn("tree", F.lit("x"))
    got = {tuple(r) for r in nested.submission_children(df).collect()}
    assert got == brute.submission_rows([r for r in rows if r[0]])
    assert nested.submission_children(df.limit(0)).count() == 0


def test_filing_rows(spark):
    recent = {"accessionNumber": ["1-2", "", "1-2", "3"], "form": ["a", "b", "c", "d"], "filingDate": ["2024-01-01", "x", "2024-01-03", "soon"], "reportDate": ["2023-12-31"]}
    df = spark.createDataFrame([("1", datetime(2026, 1, 1), json.dumps({"filings": {"recent": recent}})), ("2", None, "bad"), (None, None, "{}")], "cik string, fetched_at timestamp, payload string")
    assert [tuple(r) for r in nested.filing_rows(df).collect()] == [("1", "12", "a", date(2024, 1, 1), date(2023, 12, 31), None)]
    with pytest.raises(Exception, match="unreadable filing date"):
        nested.filing_rows(df, strict=True).collect()


def test_payloads_wrapped_as_text_and_fetched_within_a_millisecond(spark):
    wrap = lambda o, n: o if n == 0 else wrap(json.dumps(o), n - 1)
    t = datetime(2026, 1, 1, 0, 0, 0, 5)
    rows = [("1", t, wrap({"tickers": "NEW"}, 2)), ("1", t - timedelta(microseconds=1), wrap({"tickers": "OLD"}, 1)), ("2", None, wrap({"tickers": "X"}, 3)), ("3", t, '"plain text"'), ("3", t, '""'), ("3", t, "7")]
    got = {tuple(r) for r in nested.submission_children(spark.createDataFrame(rows, "cik string, fetched_at timestamp, payload string")).collect()}
    assert got == {("ticker", "1", 0, "NEW"), ("ticker", "2", 0, "X")}


def test_containment_links_as_the_stored_tables_do(spark):
    doc = json.dumps({"files": [{"name": "a", "members": [{"name": "x"}, {"size": 1}]}, {"members": {"name": "y"}}, {"name": "b", "members": []}]})
    t = nested.NodeTables(nested.walk(doc))
    near = {(p[2], c[5]) for p, c in nested.enclosing(t.of("files", "object"), t.of("files.members.name", "text"))}
    nodes = nested.label_nodes(spark.createDataFrame([("t", doc)], "tree string, text string"), "tree", "text")
    stored = nested.link(nested.nodes_of(nodes, "files", "object"), nested.nodes_of(nodes, "files.members.name", "text"))
    assert near == {(r.parent_pre, r.value) for r in stored.collect()} and len(near) == 2
    assert nested.file_tables(doc) == [("file", None, 0, "a"), ("file", None, 2, "b"), ("member", "a", 0, "x")]


def test_files_and_members(spark):
    kind = "cik string, accession string, base_url string, fetched_at timestamp, files array<struct<name: string, type: string, size: string, last_modified: string, members: array<struct<name: string, size: bigint>>>>"
    f = lambda n, m: (n, None, None, None, m)
    rows = [("1", "0-1", None, None, [f("a.zip", [("x", 1), ("y", None)]), f("b", None), f("c", [])]), ("1", "02", None, None, None), ("1", "03", None, None, []), ("1", None, None, None, [f("z", None)])]
    rows += rows[:1]
    got = [tuple(r) for r in nested.accession_children(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got) == [("file", "01", 0, "a.zip"), ("file", "01", 1, "b"), ("file", "01", 2, "c"), ("member", "01/a.zip", 0, "x"), ("member", "01/a.zip", 1, "y")]


def _series(n=260, seed=0):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), np.exp(rng.normal(12, 0.4, n))


def _implausible(spark, close, volume, adj=None):
    rows = [_bar(i, "sec:x", date(2024, 1, 1) + timedelta(days=i), None if c is None else float(c), 1, 1, None if adj is None else adj[i], None if v is None else float(v)) for i, (c, v) in enumerate(zip(close, volume))]
    return {tuple(r) for r in outliers.implausible(spark.createDataFrame(rows, BAR)).collect()}


def test_spikes_runs_and_ranges(spark):
    close, volume = _series()
    close[50] *= 1.5
    close[80:83] *= 0.6
    close[150:] *= 1.8  # a lasting change of level
    close[100:106] = close[100]
    close[120] = -1.0
    volume[30] *= 1000
    volume[200] = -5
    volume[210:220] = 0
    close[210:220] = close[210]  # no trade, no change
    expected = {(50, "close"), (80, "close"), (81, "close"), (82, "close"), (120, "close"), (30, "volume"), (200, "volume")} | {(i, "close") for i in range(101, 106)}
    assert _implausible(spark, close, volume) == expected


def test_clean_and_short_series(spark):
    close, volume = _series(seed=4)
    assert _implausible(spark, close, volume) == set()
    assert _implausible(spark, [None, float("nan"), 0.0], [None, None, None]) == {(2, "close")}
    assert _implausible(spark, [], []) == set()


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    close, volume = _series(900, 7)
    close[[100, 500, 777]] *= 2
    close[395:405] = close[395]
    whole = _implausible(spark, close, volume)
    monkeypatch.setattr(outliers, "BLOCK_DAYS", 300)
    assert _implausible(spark, close, volume) == whole and len(whole) == 12


def test_each_delivery_is_judged_by_its_own_value(spark):
    close, volume = _series(120, 2)
    rows = [_bar(i, "sec:x", date(2024, 1, 1) + timedelta(days=i), float(c), 1, 1, None, float(v)) for i, (c, v) in enumerate(zip(close, volume))]
    day = date(2024, 1, 1) + timedelta(days=60)
    rows += [_bar(500, "sec:x", day, float(close[60] * 3), 1, 5), _bar(501, "sec:x", day, float(close[60] * 3), 1, 6), _bar(502, "sec:x", None, -1.0, 1, 6), _bar(None, "sec:x", day, -1.0, None, 6), _bar(503, None, day, 5.0, None, 6)]
    got = {tuple(r) for r in outliers.implausible(spark.createDataFrame(rows, BAR)).collect()}
    assert got == {(500, "close"), (501, "close"), (502, "close")}


def test_esd_limit_agrees_with_tables():
    # Rosner 1983: n = 54, alpha = 0.05 gives 3.16 for the first and 3.15 for the second deviate
    assert round(outliers.rosner_lambda(54, 0.05), 2) == 3.16
    assert round(outliers.rosner_lambda(53, 0.05), 2) == 3.15


def _esd_by_hand(rem, floor, alpha):
    left, taken, last = list(np.abs(rem)), [], 0
    order = np.argsort(-np.abs(rem), kind="stable")
    for i in range(len(rem) // 2):
        n = len(rem) - i
        rest = np.sort(left)[: n - 1]
        taken.append(order[i])
        if np.max(left) > outliers.esd_limit(n, alpha) * max(floor, outliers.MAD * np.median(rest)):
            last = i + 1
        left.remove(np.max(left))
    return set(taken[:last])


def test_esd_takes_readings_out_one_by_one():
    rng = np.random.default_rng(2)
    for k in range(30):
        rem = rng.normal(0, 1, 60)
        far = rng.choice(60, rng.integers(0, 29), replace=False)
        rem[far] += 40 * rng.choice([-1, 1], len(far)) * rng.uniform(1, 3, len(far))
        got = outliers.esd_outliers(np.r_[rem, rng.normal(0, 1, 20)], np.full(80, 0.5), np.r_[np.zeros(60, int), np.ones(20, int)], 1e-4)
        assert set(np.flatnonzero(got)) == _esd_by_hand(rem, 0.5, 1e-4) == set(far)


def test_many_spikes_of_a_short_series_and_none_of_plain_walks(spark):
    close, volume = _series(40, 11)
    at = list(range(2, 38, 4))
    close[at] *= 3
    assert _implausible(spark, close, volume) >= {(i, "close") for i in at}
    rng = np.random.default_rng(5)
    walks = np.exp(np.cumsum(rng.normal(0, 0.02, (2000, 20)), 1)).ravel()
    series, day = np.repeat(np.arange(2000), 20), np.tile(np.arange(20), 2000)
    flags = outliers.judge(series, day, {"close": walks, "volume": np.full(len(walks), np.nan)}, outliers.ALPHA)
    assert not flags["close"].any()
