"""Scans, catalog, skills and streaming on files written here."""

import gzip
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from silverbarn import ingest, seeding
from silverbarn.catalog import Catalog
from silverbarn.skills import FACTS, QUOTES, Skills
from silverbarn.sources import archives, tables
from silverbarn.streaming import upserts


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


HOUSING = "REGION_TYPE\tREGION\tSTATE_CODE\tCITY\tTABLE_ID\tPROPERTY_TYPE_ID\tPROPERTY_TYPE\tPERIOD_BEGIN\tPERIOD_DURATION\tMEDIAN_SALE_PRICE\tHOMES_SOLD\tLAST_UPDATED\n"


def test_housing_with_a_truncated_file(spark, tmp_path):
    good = HOUSING + 'metro\t"Fresno, CA"\tCA\t\t7\t-1\tAll\t2024-01-01\t30\t100.5\t12.0\t2026-01-12 14:43:38.223 Z\nplanet\tX\tCA\t\t8\t-1\tAll\t2024-01-01\t30\tNA\t\t\n'
    (tmp_path / "a.tsv000.gz").write_bytes(gzip.compress(good.encode()))
    many = HOUSING + "".join(f"county\tC{i}\tTX\t\t{i}\t-1\tAll\t2024-01-01\t30\t{i}\t1\t\n" for i in range(20_000))
    whole = gzip.compress(many.encode())
    (tmp_path / "b.tsv000.gz").write_bytes(whole[: len(whole) // 2])
    df = tables.housing_tsv(spark, str(tmp_path), "p")
    fresno = df.where("region_id = 'region:metro:us:ca:fresno'").first()
    assert (fresno.median_sale_price, fresno.homes_sold, fresno.data_revision, fresno.inventory) == (100.5, 12, 1768229018, None)
    assert df.where("reject = 'unsupported type'").count() == 1
    assert 0 < df.where("region_id LIKE 'region:county%'").count() < 20_000


def test_bar_archive(spark, tmp_path):
    head = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"
    _zip(tmp_path / "d.zip", {"data/daily/us/nasdaq stocks/1/aapl.us.txt": head + "AAPL.US,D,20240102,000000,1,2,0.5,1.5,100,0\nAAPL.US,D,bad,000000,1,2,3,4,5,0\n", "data/world/indices/^dax.txt": head + "^DAX,D,20240102,000000,1,2,0.5,9,1,0\n", "readme.txt": "no header"})
    (tmp_path / "broken.zip").write_bytes(b"PK nonsense")
    rows = archives.bar_archive(archives.read_zip(spark, str(tmp_path)))
    assert sorted((r.canonical_id, r.start_ts, r.close) for r in rows.collect()) == [("index:stooq:^dax", date(2024, 1, 2), 9.0), ("sec:xnas:aapl", date(2024, 1, 2), 1.5)]


def test_submissions_with_pages(spark, tmp_path):
    _zip(tmp_path / "s.zip", {"CIK0000000001.json": '{"name": "A"}', "CIK0000000001-submissions-002.json": '{"p": 2}', "CIK0000000001-submissions-001.json": '{"p": 1}', "CIK0000000002-submissions-001.json": "{}"})
    (row,) = archives.submissions(archives.read_zip(spark, str(tmp_path))).collect()
    assert (row.cik, row.entity_name, row.n_pages) == ("0000000001", "A", 2)
    assert json.loads(row.payload) == {"name": "A", "pages": [{"p": 1}, {"p": 2}]}


def test_reference_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"}, "1": {"cik_str": 1, "ticker": "", "title": "x"}}))
    assert [tuple(r) for r in tables.company_tickers(spark, str(tmp_path / "t.json")).collect()] == [("0000320193", "AAPL", "Apple")]
    (tmp_path / "c.json").write_text(json.dumps({"USD": "Dollar", " ": "none"}))
    assert [tuple(r) for r in tables.currencies(spark, str(tmp_path / "c.json")).collect()] == [("ccy:usd", "USD", "Dollar")]
    (tmp_path / "l.csv").write_text('symbol,summary\nA,"two\nlines"\nB,x\nC,y\n')
    assert [r.symbol for r in tables.listed_csv(spark, str(tmp_path / "l.csv"), 2).collect()] == ["A", "B"]
    (tmp_path / "u.csv").write_text("Symbol,Name,Exchange\nA,Alpha,NYSE\nB,,NYSE\n")
    assert [r.symbol for r in tables.us_symbols(spark, str(tmp_path / "u.csv")).collect()] == ["A"]
    r = {x.kind: x.entity_id for x in tables.admin_regions(spark, [("us", "", "United States", "country"), ("us", "TX", "Texas", "State"), ("ca", "ON", "Ontario", "Province")]).collect()}
    assert r == {"national": "region:national:us", "state": "region:admin1:us:texas", "province": "region:admin1:ca:ontario"}
    e, codes = tables.exchanges(spark, [("XNAS", "Nasdaq", "US", "USD", ["NMS", "NGM"])])
    assert (e.first().traded_in, codes.count()) == ("ccy:usd", 2)


INSTANCE = """junk<?xml version="1.0"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
<context id="c1"><entity><identifier scheme="s">0001</identifier><segment><xbrldi:explicitMember dimension="a:Axis">a:M</xbrldi:explicitMember><xbrldi:typedMember dimension="a:T"><v/></xbrldi:typedMember></segment></entity><period><instant>2024-03-31</instant></period></context>
<context id="c2"><entity><identifier scheme="s">0001</identifier></entity><period><startDate>2024-01-01</startDate><endDate>2024-03-31T00:00:00Z</endDate></period></context>
<context id="c3"><period><forever/></period></context>
<unit id="u"><measure>iso4217:usd</measure></unit><unit id="r"><divide/></unit>
<us-gaap:Assets contextRef="c1" unitRef="u" decimals="-3" id="f1">1500</us-gaap:Assets><us-gaap:Loss contextRef="c2" unitRef="u" decimals="INF" sign="negative">-2.5</us-gaap:Loss>
<us-gaap:Gone contextRef="c3">1</us-gaap:Gone><us-gaap:Text contextRef="c1">words</us-gaap:Text><us-gaap:Bad contextRef="c1">nan</us-gaap:Bad></xbrl>"""


def test_xbrl_star(spark):
    df = spark.createDataFrame([("acc", bytearray(INSTANCE.encode())), ("no", bytearray(b"not xml")), ("none", None)], "path string, content binary")
    parsed = archives.xbrl(df).cache()
    facts = {r.qname: r for r in parsed.where("kind = 'fact'").collect()}
    assert set(facts) == {"2023:Assets", "2023:Loss"} and (facts["2023:Assets"].decimals, facts["2023:Loss"].decimals, facts["2023:Loss"].sign) == (-3, None, -1)
    dims = {r.axis: (r.member, r.typed_value) for r in parsed.where("kind = 'dimension'").collect()}
    assert dims["a:Axis"] == ("a:M", None) and dims["a:T"][1].startswith("HASH:")
    star = archives.star(parsed)
    joined = star["facts"].join(star["contexts"].drop("accession"), "context_id").join(star["units"].drop("accession"), "unit_id").collect()
    assert len(joined) == 2 and {r.measure for r in joined} == {"USD"}
    units = spark.createDataFrame([(0, ["x:shares"]), (1, ["m", "ISO4217:usd"]), (2, ["m", "n"]), (3, []), (4, None)], "i int, m array<string>")
    assert [r.u for r in units.orderBy("i").select(archives.unit_of(F.col("m")).alias("u")).collect()] == ["shares", "USD", "m", None, None]


def test_catalog_sources_and_cli(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "root"))
    head = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"
    (tmp_path / "z").mkdir()
    _zip(tmp_path / "z" / "d.zip", {"nyse/x.txt": head + "X.US,D,20240102,0,1,2,0.5,1.5,100,0\nX.US,D,20240102,0,1,2,0.5,1.7,100,0\n"})
    source = ingest.all_sources(cat).get("market")
    assert source.ensure_up_to_date(str(tmp_path / "z")) == {"candles": 1} == source.ensure_up_to_date(str(tmp_path / "z"))
    assert cat.read("candles").first().close == 1.7 and cat.versions("candles") == [1, 2] and "candles" in cat.describe()
    with pytest.raises(KeyError):
        cat.read("nothing")
    with pytest.raises(KeyError):
        ingest.all_sources(cat).get("nothing")
    assert [x.name for x in ingest.all_sources(cat).chosen([" Market "])] == ["market"] and len(ingest.all_sources(cat).chosen()) == 3
    with pytest.raises(ValueError):
        ingest.all_sources(cat).chosen(["nothing"])
    assert ingest.main(["update", "nothing", "x", "--data-root", str(tmp_path)]) == 1 == ingest.main(["seed", "nothing", "--data-root", str(tmp_path)])
    assert ingest.data_root("/x") == "/x" and ingest.data_root().endswith("data")
    cat.register()
    assert spark.sql("SELECT count(*) AS n FROM candles").first().n == 1


def test_only_touched_parts_are_written(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "root"))
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    assert cat.upsert("t", rows, ["k"], 8) == 500
    assert cat.upsert("t", spark.createDataFrame([("7", 1), ("new", 2)], "k string, v int"), ["k"], 8) == 2
    parts = [p.name for p in (tmp_path / "root" / "t" / "v2").iterdir() if p.name.startswith("_part")]
    assert 1 <= len(parts) <= 2
    now = {r.k: r.v for r in cat.read("t").collect()}
    assert len(now) == 501 and now["7"] == 1 and now["new"] == 2 and {r.v for r in cat.read("t", 1).collect()} == {0}
    (tmp_path / "root" / "t" / "v3").mkdir()  # a write that failed
    assert cat.write("t", rows.limit(3)) == 4 and cat.read("t").count() == 3 and cat.versions("t") == [1, 2, 4]
    assert cat.upsert("t", rows.limit(0), ["k"], 8) == 0 and cat.upsert("t", rows, ["k"], 8) == 500 and cat.read("t").count() == 500


def test_filings_in_order_with_markers(spark, tmp_path):
    import io

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("deep/inner.xml", INSTANCE)
        z.writestr("style.css", "x")
    files = [
        ("a1", "b.xml", b"not xml"), ("a1", "c.xml", INSTANCE.encode()), ("a1", "d.xml", INSTANCE.encode()), ("a1", "a.htm", b"<p>"), ("a1", "a1.txt", INSTANCE.encode()),
        ("a2", "pack.zip", packed.getvalue()), ("a3", "x.xml", b"no"), ("done", "x.xml", INSTANCE.encode()), ("a4", None, b""),
    ]
    df = spark.createDataFrame([(a, n, bytearray(b)) for a, n, b in files], "accession string, file_name string, content binary")
    members = archives.filing_members(df)
    assert sorted(r.file_name for r in members.where("accession = 'a2'").collect()) == ["inner.xml"]
    rows, report = archives.filing_facts(members, spark.createDataFrame([("done",)], "accession string"))
    assert {(r.accession, r.file_order) for r in rows.where("kind = 'fact'").collect()} == {("a1", "0|c.xml"), ("a2", "1|pack.zip|deep/inner.xml")}
    assert {r.accession: (r.files, r.failed, r.done) for r in report.collect()} == {"a1": (3, 1, True), "a2": (1, 0, True), "a3": (1, 1, False)}


def test_empty_main_document_takes_its_pages(spark, tmp_path):
    _zip(tmp_path / "s.zip", {"CIK0000000009.json": "{ }", "CIK0000000009-submissions-001.json": "[1]"})
    (row,) = archives.submissions(archives.read_zip(spark, str(tmp_path))).collect()
    assert json.loads(row.payload) == {"pages": [[1]]} and row.fetched_at is not None


def test_seeding_adds_what_is_missing(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "root"))
    assert seeding.seed(cat, "exchanges").entities > 70 and seeding.seed(cat, "exchanges") == seeding.Seeded(0, 0, 0, 0)
    (tmp_path / "e.csv").write_text("symbol,name,exchange,cusip,country\nACM,Acme Inc.,NMS,C1,United States\n,Nobody Ltd,NMS,,\n")
    done = seeding.seed(cat, "equities", str(tmp_path / "e.csv"))
    assert done.skipped == 1 and done.provider_ids == 2 and seeding.seed(cat, "equities", str(tmp_path / "e.csv")).entities == 0
    (tmp_path / "more.csv").write_text("symbol,name,exchange,cusip,country\nACM.L,Acme,LSE,C1,\n")
    seeding.seed(cat, "equities", str(tmp_path / "more.csv"))
    assert {r.entity_id for r in cat.read("provider_ids").where("provider_entity_id IN ('ACM', 'ACM.L')").collect()} == {"sec:ticker:acm"}
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "ACM", "title": "Acme Inc."}}))
    seeding.seed(cat, "companies", str(tmp_path / "t.json"))
    assert cat.read("provider_ids").where("provider = 'provider:filings' AND entity_id = 'company:us:acme-inc'").count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"USD": "Dollar", "XXX": ""}))
    assert seeding.seed(cat, "currencies", str(tmp_path / "c.json")).skipped == 1
    (tmp_path / "r.csv").write_text("country,code,name,kind\nus,TX,Texas,State\nus,,United States,Country\n")
    assert seeding.seed(cat, "regions", str(tmp_path / "r.csv")).entities == 2
    (tmp_path / "f.csv").write_text("symbol,name,family,exchange\nSPY,Fund A,Fam,NYQ\n")
    assert seeding.seed(cat, "etfs", str(tmp_path / "f.csv"), 5).entities == 2
    with pytest.raises(KeyError):
        seeding.seed(cat, "nothing")


def test_bars_of_a_provider(spark):
    class Fake:
        name = "p"

        def fetch(self, ids):
            kind = "provider_entity_id string, day date, open double, high double, low double, close double, adj_close double, volume double"
            rows = [("T1", date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 5.0), ("ABC", date(2024, 1, 2), 2.0, 2.0, 2.0, 2.0, 2.0, 5.0), ("ABC", date(2024, 1, 3), 2.0, 2.0, 2.0, None, 2.0, 5.0)]
            return spark.createDataFrame(rows, kind).join(ids, "provider_entity_id", "left_semi")

    mapping = spark.createDataFrame([("p", "T1", "sec:x", None), ("q", "T9", "sec:abc", None)], "provider string, provider_entity_id string, entity_id string, active_to date")
    wanted = spark.createDataFrame([("sec:x",), ("sec:abc",), ("sec:none",)], "entity_id string")
    got = ingest.provider_bars(Fake(), wanted, mapping, F.lit("2024-02-01").cast("date")).collect()
    assert sorted((r.canonical_id, r.close, r.provider) for r in got) == [("sec:abc", 2.0, "p"), ("sec:x", 1.0, "p")]


def _skills(spark):
    bars = spark.createDataFrame([("s", date(2024, 1, d), p, c) for d, p, c in ((1, "a", 1.0), (1, "b", 9.0), (2, "b", 3.0), (9, "a", 5.0))], "canonical_id string, start_ts date, provider string, close double")
    bars = bars.withColumns({c: F.lit(None).cast("double") for c in ("open", "high", "low", "adj_close", "volume", "dividend")})
    rule = spark.createDataFrame([("a", 1, None), ("b", 2, None)], "provider string, priority int, staleness_days int")
    over = spark.createDataFrame([], "canonical_id string, provider string, priority int, staleness_days int")
    star = archives.star(archives.xbrl(spark.createDataFrame([("acc", bytearray(INSTANCE.encode()))], "path string, content binary")))
    filings = spark.createDataFrame([("acc", "0000000001")], "accession string, cik string")
    mapping = spark.createDataFrame([("0000000001", "sec:x", None)], "provider_entity_id string, entity_id string, active_to date")
    return Skills({"candles": bars, "defaults": rule, "overrides": over, "filings": filings, "mapping": mapping, **{k: (v.drop("accession", "ref") if k in ("contexts", "units") else v) for k, v in star.items()}}, "2024-02-01")


def test_skills(spark):
    s = _skills(spark)
    got = s.execute_skill(QUOTES, {"symbol": "s", "columns": ["close"], "end": "2024-01-05"})
    assert [(str(r.start_ts), r.provider, r.close) for r in got.records.collect()] == [("2024-01-02", "b", 3.0), ("2024-01-01", "a", 1.0)] and got.metadata["row_count"] == 2
    week = s.execute_skill(QUOTES, {"symbol": "s", "aggregation": {"method": "avg", "period": "week"}})
    assert [(r.period, r.close, r.n) for r in week.records.collect()] == [("2024-W02", 5.0, 1), ("2024-W01", 2.0, 2)]
    facts = s.execute_skill(FACTS, {"symbol": "sec:x", "concepts": "2023:Assets"})
    assert [r.value for r in facts.records.collect()] == [1500.0]
    bad = [(QUOTES, {}), (QUOTES, {"symbol": "s", "start": "2024-02-01", "end": "2024-01-01"}), (QUOTES, {"symbol": "s", "columns": ["nope"]}), (QUOTES, {"symbol": "s", "start": "20240101"}),
           (QUOTES, {"symbol": "s", "aggregation": {"method": "sum"}}), (FACTS, {}), (FACTS, {"cik": "1", "limit": 0}), (FACTS, {"entity": "none"}), ("skill:none", {})]
    for skill, payload in bad:
        with pytest.raises(ValueError):
            s.execute_skill(skill, payload)


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    kind = "k string, v int, s int"
    write = lambda rows, n: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cat = Catalog(spark, str(tmp_path / "root"))
    run = lambda: upserts.upsert_stream(upserts.parquet_stream(spark, str(tmp_path / "in"), kind), cat, "t", ["k"], "s", str(tmp_path / "cp")).awaitTermination(120)
    write([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], 1)
    run()
    write([("b", 5, 9)], 2)
    run()
    run()
    assert sorted(map(tuple, cat.read("t").collect())) == [("a", 2, 2), ("b", 5, 9)]


def test_streaming_windows_and_repeats(spark, tmp_path):
    rows = [("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 00:04:00", 3.0), ("b", "2024-01-01 01:00:00", 5.0)]
    spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = upserts.parquet_stream(spark, str(tmp_path / "in"), "k string, t timestamp, v double")
    out = upserts.windowed(upserts.deduplicated(stream, ["k", "t"], "t", "10 minutes"), "t", None, "5 minutes", ["k"], "v")
    q = out.writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.k, r.n, r.total) for r in spark.table("win").collect()] == [("a", 2, 4.0)]
