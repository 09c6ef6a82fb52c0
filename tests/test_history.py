import random
from datetime import datetime, timedelta

import brute
from pyspark.sql import functions as F

from silverbarn.operators import history

MAP = "provider string, provider_entity_id string, entity_id string, active_from string, active_to string, metadata string, recorded_at timestamp"
SNAP = "provider string, provider_region_id string, region_id string, provider_name string, active_from string, active_to string, data_revision bigint"
KEY = ["provider", "provider_entity_id"]


def _updates(n, keys, seed):
    rnd = random.Random(seed)
    notations = ["%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S"]

    def day():
        if rnd.random() < 0.15:
            return rnd.choice([None, "", "  "])
        return (datetime(2015, 1, 1) + timedelta(days=rnd.randrange(300), hours=rnd.randrange(24))).strftime(rnd.choice(notations))

    rows = [("p", f"k{rnd.randrange(keys)}", f"e{rnd.randrange(4)}", day(), day(), None, datetime(2016, 1, 1) + timedelta(minutes=i)) for i in range(n)]
    rows += rows[:5]
    rnd.shuffle(rows)
    return rows


def _run(spark, rows):
    df = spark.createDataFrame(rows, MAP)
    out = history.interval_history(df, KEY, "entity_id", "active_from", "active_to", "recorded_at")
    return {((r.provider, r.provider_entity_id), r.value, r.valid_from, r.valid_to) for r in out.collect()}


def test_intervals_match_day_by_day(spark):
    rows = _updates(250, 30, 1)
    assert _run(spark, rows) == brute.interval_versions([((r[0], r[1]), r[2], r[3], r[4], r[6]) for r in rows])


def test_hot_key_takes_the_dyadic_way_with_the_same_result(spark, monkeypatch):
    rows = _updates(300, 3, 2)
    expected = brute.interval_versions([((r[0], r[1]), r[2], r[3], r[4], r[6]) for r in rows])
    monkeypatch.setattr(history, "HOT_ROWS", 5)
    assert _run(spark, rows) == expected


def test_nulls_and_empty_intervals(spark):
    at = datetime(2020, 1, 1)
    rows = [(None, "a", "e", "2020-01-01", None, None, at), ("p", "a", None, "2020-01-01", None, None, at), ("p", "a", "e", "2020-05-01", "2020-05-01", None, at), ("p", "b", "e", "soon", None, None, None)]
    assert _run(spark, rows) == {(("p", "b"), "e", "", "")}
    assert _run(spark, []) == set()


def test_snapshots_come_go_and_return(spark):
    rnd = random.Random(3)
    rows = []
    for rev in range(12):
        for k in range(8):
            if rnd.random() < 0.7:
                name = rnd.choice(["North  Town", "north town", " NORTH TOWN", "South"])
                rows.append(("p", f"k{k}", f"r{rnd.randrange(2)}", name, None, None, 1_600_000_000 + rev * 864_00 * 3))
    rows += rows[:9] + [("p", None, "r", "x", None, None, 1_600_000_000), ("q", "k", "r", None, None, None, 1_600_000_000)]
    df = spark.createDataFrame(rows, SNAP)
    got = {tuple(r) for r in history.snapshot_history(df, "provider", "provider_region_id", ["region_id"], ["provider_name"], "data_revision").collect()}
    assert got == brute.snapshot_versions([(r[0], r[1], r[2], r[3], r[6]) for r in rows if r[1] is not None])


def test_batches_append_to_what_is_stored(spark):
    rnd = random.Random(8)
    rows = [("p" + str(k % 2), f"k{k}", f"r{rnd.randrange(2)}", rnd.choice(["a", "b", "B "]), None, None, 1_600_000_000 + rev * 86_400) for rev in range(14) for k in range(10) for _ in range(rnd.randrange(3)) if rnd.random() < 0.7]
    df = spark.createDataFrame(rows, SNAP)
    whole = {tuple(r) for r in history.snapshot_history(df, *history.REGION).collect()}
    assert whole == brute.snapshot_versions([(r[0], r[1], r[2], r[3], r[6]) for r in rows])
    for n in (2, 5):
        assert {tuple(r) for r in history.region_history_in_batches(df, n).collect()} == whole
    first, second = df.where("data_revision < 1600600000"), df.where("data_revision >= 1600600000")
    held = history.load_snapshots(first, *history.REGION)
    again = history.load_snapshots(second, *history.REGION, stored=held)
    all_at_once = history.load_snapshots(df, *history.REGION)
    for part in ("mapping", "names"):
        get = lambda s: sorted(map(str, getattr(s, part).collect()))  # noqa: B023, E731
        assert get(held.plus(again)) == get(all_at_once) and get(held) and get(again)
    assert history.region_history_in_batches(df.limit(0)).count() == 0


def test_extra_columns_do_not_clash(spark):
    rows = _updates(20, 4, 5)
    df = spark.createDataFrame(rows, MAP).withColumns({"day": F.lit(1), "hash_diff": F.lit("x"), "_from": F.lit(2)})
    empty = spark.createDataFrame([], SNAP)
    assert history.mapping_history(df, empty).count() == len(brute.interval_versions([((r[0], r[1]), r[2], r[3], r[4], r[6]) for r in rows]))


def test_satellite_appends_only_changes(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("a", 3, None), ("a", 4, 7)], "k string, o int, d int")
    rows = history.satellite(df, ["k"], "o", "d")
    assert [r.o for r in rows.orderBy("o").collect()] == [1, 3, 4]
    view = history.satellite_view(rows, ["k"], "o", "d", "e")
    assert [(r.o, r.e) for r in view.orderBy("o").collect()] == [(1, 3), (4, None)]
