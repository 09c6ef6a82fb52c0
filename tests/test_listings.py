from pyspark.sql import functions as F

from silverbarn.functions import blobs
from silverbarn.operators import listings as L
from silverbarn.sources import tables


def _rows(spark, rows, cols):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx bigint, " + ", ".join(f"{c} string" for c in cols.split()))


def _ids(df):
    return {r.provider_entity_id: r.entity_id for r in df.collect()}


def _edges(g):
    return {(r.src, r.dst, r.relation) for r in g.relations.collect()}


def test_products_merge_or_split(spark):
    rows = _rows(spark, [("SPY", "Fund A", "Fam", "NYQ", "USD"), ("SPY.L", "Fund A", "Fam", "", "USD"), ("SPY.DE", "Other", "Fam", "", "EUR"), ("", "none", "", "", "")], "symbol name family exchange currency")
    g = L.products(rows, "etf", "etf", "p")
    assert _ids(g.provider_ids) == {"SPY": "etf:spy", "SPY.L": "etf:spy", "SPY.DE": "etf:spy.de"}
    nodes = {r.entity_id: (r.name, r.members) for r in g.entities.collect()}
    assert nodes["etf:spy"] == ("Fund A", {"name": "Fund A", "currency": "USD"}) and nodes["fund_entity:fam"][0] == "Fam" and "mic:xlon" in nodes
    assert ("etf:spy", "mic:xlon", "listed_on") in _edges(g) and ("etf:spy", "fund_entity:fam", "managed_by") in _edges(g)
    assert L.products(rows.limit(0), "etf", "etf", "p").entities.count() == 0


def test_first_and_last_wins(spark):
    rows = _rows(spark, [("AB", "One", "btc", "Bitcoin (BTC) is"), ("AB.L", "Two", "BTC", "Bit, newer")], "symbol name cryptocurrency summary")
    assert _ids(L.funds(rows, "p").provider_ids) == {"AB": "fund:ab"}
    (r,) = L.cryptos(rows).entities.collect()
    assert (r.entity_id, r.name, r.members) == ("crypto:btc", "Bit", {"summary": "Bit, newer"})


def test_equities_collapse_on_the_company(spark):
    cols = "symbol name isin cusip exchange country sector industry currency"
    rows = _rows(spark, [
        ("ACM", "Acme Inc.", "US0378331005", "C1", "NMS", "United States", "Tech", "Chips", "USD"),
        ("ACM.DE", "Acme", "", "C1", "", "", "", "", "EUR"),
        ("ACX.L", "Acme Corporation", "", "", "", "", "", "", "GBP"),
        ("GRW", "Growth Fund", "", "", "NMS", "", "", "", "USD"),
        ("ODD", "CALL 123", "", "", "NMS", "", "", "", ""),
        ("NOX", "Nowhere Ltd", "", "", "??", "", "", "", ""),
    ], cols)
    g = L.equities(rows, "p", {"NMS": "XNAS"}, {"united states": "us"})
    by = {r.provider_entity_id: r.entity_id for r in g.provider_ids.where("provider = 'p'").collect()}
    assert by == {"ACM": "sec:isin:us0378331005", "ACM.DE": "sec:isin:us0378331005", "ACX.L": "sec:isin:us0378331005", "GRW": "sec:ticker:grw", "ODD": "sec:ticker:odd"}
    e = _edges(g)
    assert ("company:us:acme-inc", "sec:isin:us0378331005", "issued_security") in e and ("sec:isin:us0378331005", "mic:xlon", "listed_on") in e
    assert ("fund_entity:growth-fund", "sec:ticker:grw", "issued_security") in e and not any(d == "sec:ticker:odd" for _, d, r in e if r == "issued_security")
    assert g.provider_ids.where("provider = 'provider:cusip'").count() == 1
    filers = L.companies(_rows(spark, [("0000000001", "GRW", "Acme Inc."), ("0000000001", "ZZZ", "Acme Inc.")], "cik ticker name"), g.entities, "sec")
    (f,) = filers.entities.collect()
    assert f.members == {"cik": "0000000001", "ticker": "ZZZ"} and _edges(filers) == {("company:us:acme-inc", "sec:ticker:grw", "issued_security")}
    whole = L.merge_graphs(filers, g)
    assert whole.entities.where("entity_id = 'company:us:acme-inc'").count() == 1


def test_stored_companies_exchanges_currencies_symbols(spark):
    cols = "symbol name isin cusip exchange country"
    first = L.equities(_rows(spark, [("ACM", "Acme Inc.", "US0378331005", "C1", "NMS", "")], cols), "p")
    more = L.equities(_rows(spark, [("ACY.L", "Acme Trading plc", "", "C1", "", ""), ("ACZ.PA", "ACME Corp.", "", "", "", ""), ("NEW", "Brandnew Ltd", "", "", "LSE", "")], cols), "p", stored=first)
    by = {r.provider_entity_id: r.entity_id for r in more.provider_ids.where("provider = 'p'").collect()}
    assert by == {"ACY.L": "sec:isin:us0378331005", "ACZ.PA": "sec:isin:us0378331005", "NEW": "sec:ticker:new"}
    assert ("company:gb:brandnew-ltd", "sec:ticker:new", "issued_security") in _edges(more)
    added = L.missing_from(more, first)
    assert "mic:xlon" in {r.entity_id for r in added.entities.collect()} and not added.entities.where("entity_id = 'sec:isin:us0378331005'").count()
    assert L.skipped(_rows(spark, [("A", "x"), ("", "y"), (None, "z")], "symbol name"), "symbol").count() == 2
    ex = L.exchange_entities(*tables.exchanges(spark), "p")
    assert ex.provider_ids.where("provider_entity_id = 'TSE'").count() == 2 and ("mic:xnas", "ccy:usd", "traded_in") in _edges(ex) and ex.entities.where("entity_type = 'exchange'").count() == 70
    money, failed = L.currency_entities(spark.createDataFrame([("usd", "Dollar"), ("", "none"), ("EUR", None)], "code string, name string"), "p")
    assert _ids(money.provider_ids) == {"USD": "ccy:usd"} and failed.count() == 2
    us = L.us_symbol_entities(_rows(spark, [("A.B", "Alpha", "NYQ"), ("", "x", "NYQ")], "symbol name exchange"), "p", "q")
    assert {(r.provider, r.entity_id) for r in us.provider_ids.collect()} == {("p", "sec:ticker:a"), ("q", "sec:ticker:a")} and ("sec:ticker:a", "mic:xnys", "listed_on") in _edges(us)
    land = L.region_entities(tables.admin_regions(spark, [("us", "TX", "Texas", "State")]), "p")
    assert _ids(land.provider_ids) == {"region:admin1:us:texas": "region:admin1:us:texas"}


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([("a-1", "x/y.PDF", bytearray(b"hello")), ("a-1", "z.htm", bytearray(b"no")), ("a-2", "q.xls", None)], "accession string, file_name string, payload binary")
    back = df.select(blobs.decompressed(blobs.compressed(F.col("payload"))).alias("p"), blobs.decompressed(F.col("payload")).alias("bad")).collect()
    assert [None if r.p is None else bytes(r.p) for r in back] == [b"hello", b"no", None] and all(r.bad is None for r in back)
    (row,) = blobs.export_attachments(df, str(tmp_path)).collect()
    assert row.size == 5 and open(row.path, "rb").read() == b"hello" and row.path.endswith("x_y.PDF")
