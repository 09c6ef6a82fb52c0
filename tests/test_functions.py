"""Scalar functions: tables of cases, nulls and empties included."""

import pytest
from pyspark.sql import functions as F

from silverbarn.functions import classify, markdown, metadata, periods, regions, text
from silverbarn.operators import entities, facts, ranges, upsert


def _each(spark, values, expr, kind="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "expr, cases",
    [
        (lambda c: text.slug(c), {"Énergie & Co_2!": "énergie-co-2", "--": "unknown", "": "unknown", None: "unknown"}),
        (lambda c: text.slug(c, "_", None), {" New  York, NY ": "new_york_ny", "": ""}),
        (text.name_key, {"BarwaQ.P.S.C. Co": "barwa-qpsc", "ACME Holdings Ltd": "acme", "": "", "A B C Corp": "abc", None: None}),
        (text.cik, {"CIK 320193": "0000320193", "no": None, "123456789012": "3456789012", None: None}),
        (text.unpadded, {"000": "0", "0012": "12", None: None}),
        (text.ticker, {"BRK.B": "brk", "a-b.c": "ab", ".x": None, None: None}),
        (text.symbol, {"^GSPC": "GSPC", "ABC-USD.L": "ABC", "": None}),
        (text.isin, {"us0378331005": "us0378331005", "US 0378-331005": "us0378331005", "123456789012": None, "US1": None}),
        (text.suffix_market, {"A.TWO": "ROCO", "a.to": "XTSE", "A.ZZ": None, "AB": None}),
        (lambda c: text.market(c, c, {"NMS": "XNAS"}), {"nms": "XNAS", "XLON": "XLON", "1.DE": "XFRA", "123": "UNKNOWN"}),
        (text.lenient_double, {"1.5": 1.5, "NA": None, "": None, "inf": None, " 2 ": 2.0, None: None}),
        (text.lenient_long, {"12.9": 12, "-3.7": -3, "x": None}),
        (text.revision, {"2026-01-12 14:43:38.223 Z": 1768229018, "bad": 0, None: 0}),
        (lambda c: text.crypto_id(c, F.lit("BTC-USD")), {"": "crypto:btc", " Ether X ": "crypto:ether-x", None: "crypto:btc"}),
        (lambda c: text.summary_name(c, F.lit("fallback")), {"Bitcoin (BTC) is": "Bitcoin", "Ether has many": "Ether", "": "fallback", None: "fallback"}),
        (lambda c: text.strip_state(c, F.lit("CA")), {"Fresno, ca": "Fresno", "Fresno CA": "Fresno", "Africa": "Africa"}),
        (lambda c: text.ignorable_file(F.lit("0001-02"), c), {"0001-02.TXT": True, "000102.txt": True, "x_lab.xml": True, "FilingSummary.xml": True, "a.css": True, "a.htm": False, None: False}),
        (classify.is_product_label, {"CALL DAX": True, "A1 B2": True, "Siemens AG": False, "12 34": True, "": False, None: False}),
        (classify.is_fund_name, {"Global Growth Fund": True, "X ETN": False, "Fundo Alfa SA": True, "COLL 5 SCHEME": True, "Apple Inc": False, "": False, None: False}),
        (classify.is_company_name, {"Apple Inc.": True, "APPLE INC": True, "APPLE": False, "Acme Ordinary Shares": False, "SIEMENS AG NA": False, "ACME ASA NA": False, "Growth Fund": False, None: False}),
    ],
)
def test_text_functions(spark, expr, cases):
    assert _each(spark, list(cases), expr) == list(cases.values())


def test_names_match(spark):
    df = spark.createDataFrame([("Acme Corp", "ACME Inc"), ("Acme", "Acmel"), ("Acme", "Bcme"), (None, "x")], "a string, b string")
    assert [r.m for r in df.select(text.names_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, True, False, False]


def test_regions(spark):
    rows = [("Metro", "Fresno, CA", "CA", None), ("neighborhood", "Old Town", "il", "Chicago"), ("state", "", "tx", None), ("national", None, None, None), ("county", "X", None, None), ("planet", "X", "ca", None), ("neighborhood", "X", "ca", " ")]
    df = spark.createDataFrame(rows, "t string, n string, s string, c string")
    t, n, s, c = (F.col(x) for x in "tnsc")
    us = F.lit("US")
    got = df.select(regions.region_id(t, n, s, c, us).alias("i"), regions.region_error(t, n, s, c).alias("e"), regions.parent_id(t, s, us).alias("p"), regions.alias_id(t, n, s, us).alias("a")).collect()
    assert [r.i for r in got] == ["region:metro:us:ca:fresno", "region:neighborhood:us:il:chicago:old_town", "region:admin1:us:tx", "region:national:us", None, None, None]
    assert [r.e for r in got] == [None, None, None, None, "state missing", "unsupported type", "city missing"]
    assert [r.p for r in got][:4] == ["region:admin1:us:ca", "region:admin1:us:il", "region:national:us", None]
    assert got[2].a == "region:state:us:tx"


def test_periods(spark):
    df = spark.createDataFrame([("2027-01-01", 1.0), ("2026-12-28", None), ("2027-01-03", 2.0), ("2027-02-01", 10.0), (None, 5.0)], "d string, v double").withColumn("d", F.to_date("d"))
    week = {r.period: (str(r.period_start), str(r.period_end), r.value, r.n) for r in periods.per_period(df, "d", "v", "week", "avg").collect()}
    assert week["2026-W53"] == ("2026-12-28", "2027-01-03", 1.5, 3)
    year = {r.period: (r.value, r.n) for r in periods.per_period(df, "d", "v", "year", "median").collect()}
    assert year == {"2026": (None, 1), "2027": (2.0, 3)}
    assert periods.per_period(df.limit(0), "d", "v", "month", "avg").count() == 0


def test_metadata(spark):
    df = spark.createDataFrame([(1, "a", '{"x":"1"}'), (2, "a", '{"y":"2","x":"3"}'), (3, "a", "bad"), (4, "b", None)], "o bigint, k string, t string")
    merged = {r.k: r.members for r in entities.metadata_by_key(df, "k", "t", "o").collect()}
    assert merged == {"a": {"x": "3", "y": "2"}, "b": {}}
    flags = {r.o: r.conflicts for r in entities.lag_conflict(df, "k", "t", "o").collect()}
    assert flags == {1: None, 2: True, 3: False, 4: None}
    built = spark.range(1).select(metadata.build(a=F.lit(" "), b=F.lit(" v "), c=F.lit(None).cast("string")).alias("j")).first().j
    assert built == '{"b":"v"}'


def test_merge_or_split(spark):
    rows = [(1, "s", "s.x", '{"a":"1"}'), (2, "s", "s.y", '{"b":"2"}'), (3, "s", "s.z", '{"b":"9"}'), (4, "t", "t.x", None)]
    df = spark.createDataFrame(rows, "o bigint, slug string, alt string, meta string")
    assert {r.row_idx: r.entity_id for r in entities.merge_or_split(df, "slug", "alt", "meta", "o").collect()} == {1: "s", 2: "s", 3: "s.z", 4: "t"}


def test_connected_rows_follow_chains(spark):
    links = [(i, f"v{i}") for i in range(40)] + [(i, f"v{i + 1}") for i in range(39)] + [(100, "w"), (101, "w"), (200, None)]
    got = {r.row_idx: r.group for r in entities.connected_rows(spark.createDataFrame(links, "row_idx bigint, link string")).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[101] == 100 and got[200] == 200


def test_gaps_and_clip(spark):
    d = lambda s: F.to_date(F.lit(s))
    req = spark.range(1).select(F.lit("k").alias("key"), d("2024-01-01").alias("start"), d("2024-01-10").alias("end"))
    cov = spark.createDataFrame([("k", "2024-01-03", "2024-01-04"), ("k", "2024-01-04", "2024-01-06"), ("k", "2024-02-01", "2024-02-02")], "key string, a string, b string").select("key", F.to_date("a").alias("from_day"), F.to_date("b").alias("to_day"))
    assert sorted((str(r.gap_start), str(r.gap_end)) for r in ranges.gaps(req, cov, "key").collect()) == [("2024-01-01", "2024-01-02"), ("2024-01-07", "2024-01-10")]
    assert [(str(r.gap_start), str(r.gap_end)) for r in ranges.gaps(req, cov.limit(0), "key").collect()] == [("2024-01-01", "2024-01-10")]
    life = spark.createDataFrame([("k", "2025-01-01", "2025-02-01")], "key string, a string, b string").select("key", F.to_date("a").alias("first"), F.to_date("b").alias("last"))
    assert ranges.clip(req, life, "key").count() == 0 and ranges.clip(req, life.limit(0), "key").count() == 1


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, s int")
    new = spark.createDataFrame([(2, None, 2), (2, "c", 3), (3, "d", 1)], "k int, v string, s int")
    once = upsert.upsert(old, new, ["k"], "s")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 3), (3, "d", 1)] == sorted(map(tuple, upsert.upsert(once, new, ["k"], "s").collect()))
    kept = upsert.upsert_keep_old(old, new.where("s = 2 OR k = 3"), ["k"], ["v"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 1), (2, "b", 2), (3, "d", 1)]


def test_null_keys_are_keys(spark):
    old = spark.createDataFrame([(None, "a", 1), (2, "b", 1)], "k int, v string, s int")
    new = spark.createDataFrame([(None, "c", 2), (3, None, 2)], "k int, v string, s int")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    once = upsert.upsert(old, new, ["k"], "s")
    assert key(once.collect()) == key([(None, "c", 2), (2, "b", 1), (3, None, 2)]) == key(upsert.upsert(once, new, ["k"], "s").collect())
    assert key(upsert.upsert_keep_old(old, spark.createDataFrame([(None, None, 7)], "k int, v string, s int"), ["k"], ["v"]).collect()) == key([(None, "a", 7), (2, "b", 1)])
    touched = upsert.touched(old, new, ["k"], "s", F.lit(99))
    assert key(touched.collect()) == key([(None, "c", 99), (3, None, 2)])


def test_runs(spark):
    run = upsert.started_run("p", "2026-01-01 00:00:00", spark, "r1")
    rows = spark.createDataFrame([("r1", 1.0), ("r1", -1.0)], "run_id string, v double")
    done = upsert.finished_run(run, upsert.audit(rows, ["run_id"], F.col("v") < 0), F.lit("2026-01-01 01:00:00").cast("timestamp"), "e", "n").first()
    assert (done.status, done.updated, done.failed, done.etag, done.notes) == ("partial", 1, 1, "e", "n") and run.first().status == "running"


def test_groups_of_a_hot_window_and_gapless_numbers(spark):
    d = F.to_date(F.lit("2024-01-01"))
    rows = spark.range(2000).select(F.format_string("k%05d", "id").alias("key"), d.alias("chunk_start"), d.alias("chunk_end"))
    rows = rows.unionByName(spark.createDataFrame([("k1",)], "key string").select("key", d.alias("chunk_start"), F.lit(None).cast("date").alias("chunk_end")))
    got = {(r.chunk_end, r.call): r["keys"] for r in ranges.window_groups(rows, "key", 300).collect()}
    assert [got[k][0] for k in sorted((k for k in got if k[0]), key=lambda k: k[1])] == [f"k{i:05d}" for i in range(0, 2000, 300)] and got[None, 0] == ["k1"]


def test_conflicts_across_parts(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("k"), "id", F.format_string('{"x":"%d"}', F.col("id").cast("int") % 2).alias("t"))
    got = entities.lag_conflict(rows, "k", "t", "id")
    assert got.where("conflicts").count() == 2999 and got.where("conflicts IS NULL").count() == 1


def test_aliases_and_filers(spark):
    kind = "provider string, provider_entity_id string, entity_id string, active_from string, active_to date, o int"
    m = spark.createDataFrame([("p", "1", "e", "2020", None, 1), ("p", "2", "e", "2020", None, 2), ("p", "3", "e", None, None, 3), ("p", "4", "e", None, None, 4), ("q", "9", "f", None, None, 5)], kind)
    assert sorted(r.provider_entity_id for r in entities.first_aliases(m, "o").collect()) == ["1", "3", "4", "9"]
    found, without = entities.filers_of(spark.createDataFrame([("e",), ("f",)], "entity_id string"), m, "p", F.lit("2024-01-01").cast("date"))
    assert sorted(r.cik for r in found.collect()) == ["1", "2", "3", "4"] and [r.entity_id for r in without.collect()] == ["f"]


def test_concept_look_up(spark):
    reg = spark.createDataFrame([("1", "Revenue", ["a:Rev"])], "cik string, concept string, qnames array<string>")
    seed = {"Revenue": ["us:Revenues"], "Assets": ["us:Assets"]}
    assert facts.look_up(reg, "1", "revenue ", seed) == ["a:Rev"] and facts.look_up(reg, "2", "Revenue", seed) == ["us:Revenues"] and facts.look_up(reg, "1", "assets", seed) == ["us:Assets"]
    with pytest.raises(ValueError):
        facts.look_up(reg, "1", "nothing", seed)


def test_markdown():
    page = "<div><script>x</script><b></b><p><b>Bold</b> and <i>it</i></p><ul><li>one</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table></div>"
    assert markdown.to_markdown(page) == "**Bold** and *it*\n\n- one\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n|  | 3 |"
    assert markdown.to_markdown("") == "" and markdown.to_markdown("<table><tr><td colspan=x>q</td></tr>") == ""
    assert markdown.to_markdown("<p>a<p>b<table><tr><td>1<td><i>2</i><tr><td><table><tr><td>in</td></tr></table></table>c") == "a\n\nb\n| in |\n| --- |\n\n| 1 | 2 |\n| --- | --- |\n|  |  |\nc"
    assert markdown.to_markdown("<b>" * 5000 + "x") == "**" * 5000 + "x" + "**" * 5000 and markdown.to_markdown("a </b>&amp; b<br>c") == "a & b\nc"
    assert markdown.wrapped_to_markdown("<document>\n<type>10-K\n<text><p>k</p></text></document>") == "k" == markdown.wrapped_to_markdown("<p>k")
    sgml = "<DOCUMENT><TYPE>XML</TYPE><FILENAME>r.htm</FILENAME><SEQUENCE>2</SEQUENCE><TEXT><p>hi</p></TEXT></DOCUMENT>"
    assert markdown.wrapped_to_markdown(sgml) == "### r.htm (sequence 2)\nhi\n---"
    assert "**x**" in markdown.textblocks_to_markdown("<r><PolicyTextBlock id='1'>&lt;b&gt;x&lt;/b&gt;</PolicyTextBlock><o>1</o></r>")


def test_file_lists_and_urls(spark):
    rows = [('{"directory":{"item":[{"name":"a"},{"name":"d/"},{"name":"a"},{"x":1}]}}', None, None), ("bad", '<a href="/x/y.xml">1</a>', None), (None, "<p>", '<a href="q.htm">1</a>'), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, j string, a string, b string").orderBy("i")
    assert [r.f for r in df.select(text.listed_files(F.col("j"), F.col("a"), F.col("b")).alias("f")).collect()] == [["a"], ["y.xml"], ["q.htm"], []]
    one = spark.range(1).select(text.accession_index_urls("http://h/", F.lit("0012"), F.lit("1-2"), F.lit("1-2")).alias("u"), text.submissions_url("http://h", F.lit("12")).alias("s"), text.filled_texts_of(F.array(F.lit(1), F.lit(None))).alias("t")).first()
    assert one.u == ["http://h/12/12/index.json", "http://h/12/12/", "http://h/12/12/1-2-index.htm"] and one.s == "http://h/CIK0000000012.json" and one.t == ["1"]
    stamps = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01 02:00:00+02:00",), ("2026-01-01 00:00:00",)], "v string")
    assert len({r.t for r in stamps.select(text.utc_timestamp(F.col("v")).alias("t")).collect()}) == 1


def test_links(spark):
    assert _each(spark, ['<a href="b">1</a><A class="q" HREF=\'a\'>2</A><a href="d/">3</a><a href="b">4</a>', "", None], markdown.links) == [["b", "a"], [], None]
