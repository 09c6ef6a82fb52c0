"""Reference listings to entities, provider ids and relations.

Every pipeline returns a ``Graph`` of three tables: entities (entity_id,
entity_type, name, members), provider ids (provider, provider_entity_id,
entity_id) and relations (src, dst, relation). All are distinct by key; what a
relation refers to is created with it. Input rows carry ``row_idx``, the order
in which the first or last row of a key counts; absent columns count as null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverbarn.functions import classify, metadata, static, text
from silverbarn.operators import entities as ent
from silverbarn.operators.upsert import keep_first, keep_last, new_only
from silverbarn.session import cut_lineage

LISTED_ON, MANAGED_BY, SECTOR, INDUSTRY, ISSUED = "listed_on", "managed_by", "operates_in_sector", "operates_in_industry", "issued_security"


@dataclass
class Graph:
    entities: DataFrame
    provider_ids: DataFrame
    relations: DataFrame


def _col(rows: DataFrame, name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit("")) if name in rows.columns else F.lit(None).cast("string")


def _entity(rows: DataFrame, entity_id: Column, kind: str, name: Column, members: Column | None = None) -> DataFrame:
    out = rows.select(entity_id.alias("entity_id"), F.lit(kind).alias("entity_type"), name.alias("name"), "row_idx", (members if members is not None else F.create_map().cast(metadata.MAP)).alias("members"))
    return out.where(F.col("entity_id").isNotNull())


def _first_entities(*parts: DataFrame) -> DataFrame:
    """First row of every id over all parts; members, which cannot be compared, travel as JSON."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    rows = whole.withColumn("members", F.to_json("members"))
    first = keep_first(rows, ["entity_id"], F.struct("row_idx", "entity_type"))
    return first.select("entity_id", "entity_type", "name", F.from_json("members", metadata.MAP).alias("members"))


def _edges(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def _edge(rows: DataFrame, src: Column, dst: Column, relation: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))


def base_slug(rows: DataFrame, fallback: str) -> Column:
    """Base symbol, else family and name, else the fallback, as a slug."""
    named = F.concat_ws(" ", _col(rows, "family"), _col(rows, "name"))
    return F.coalesce(F.lower(text.symbol(_col(rows, "symbol"))), F.nullif(text.slug(named, "-", None), F.lit("")), F.lit(fallback))


def alternate_slug(rows: DataFrame, fallback: str) -> Column:
    """Base slug with the listing suffix of the symbol, dots as dashes; the plain base without a suffix."""
    suffix = F.regexp_extract(_col(rows, "symbol"), r"^[^.]*\.(.+)$", 1)
    return F.when(F.coalesce(suffix, F.lit("")) != "", F.concat_ws(".", base_slug(rows, fallback), F.lower(F.replace(suffix, F.lit("."), F.lit("-"))))).otherwise(base_slug(rows, fallback))


def products(rows: DataFrame, kind: str, fallback: str, provider: str, fields: tuple[str, ...] = ("currency", "category", "summary")) -> Graph:
    """Listed products (ETF, index, money market fund): one entity per slug, conflicting rows under an alternate id.

    Rows without a symbol are skipped. The venue is created with its edge, the
    family manages the base id.
    """
    rows = rows.where(_col(rows, "symbol").isNotNull())
    rows = rows.select("*", metadata.build(name=_col(rows, "name"), **{f: _col(rows, f) for f in fields}).alias("_meta"), base_slug(rows, fallback).alias("_slug"), alternate_slug(rows, fallback).alias("_alt"))
    placed = ent.merge_or_split(rows, "_slug", "_alt", "_meta", "row_idx").select("row_idx", F.concat(F.lit(f"{kind}:"), "entity_id").alias("_id"))
    rows = rows.join(placed, "row_idx")
    members = ent.metadata_by_key(rows, "_id", "_meta", "row_idx")
    mic = F.concat(F.lit("mic:"), F.lower(text.market(_col(rows, "exchange"), _col(rows, "symbol"), static.exchange_codes())))
    family = F.concat(F.lit("fund_entity:"), F.nullif(text.slug(_col(rows, "family"), "-", None), F.lit("")))
    own = _entity(rows.join(members, "_id"), F.col("_id"), kind, _col(rows, "name"), F.col("members"))
    nodes = _first_entities(own, _entity(rows, mic, "exchange", F.upper(F.substring_index(mic, ":", -1))), _entity(rows, family, "fund_entity", _col(rows, "family")))
    ids = rows.select(F.lit(provider).alias("provider"), _col(rows, "symbol").alias("provider_entity_id"), F.col("_id").alias("entity_id"), "row_idx")
    edges = _edges(_edge(rows, F.col("_id"), mic, LISTED_ON), _edge(rows, F.concat(F.lit(f"{kind}:"), "_slug"), family, MANAGED_BY))
    return Graph(nodes, keep_first(ids, ["provider", "provider_entity_id"], F.col("row_idx")).drop("row_idx"), edges)


def funds(rows: DataFrame, provider: str) -> Graph:
    """Funds: the first row of a slug counts, later ones are ignored."""
    rows = rows.where(_col(rows, "symbol").isNotNull()).withColumn("_slug", base_slug(rows, "fund"))
    first = rows.groupBy("_slug").agg(F.min("row_idx").alias("row_idx"))
    return products(rows.join(first, ["_slug", "row_idx"], "left_semi").drop("_slug"), "fund", "fund", provider)


def cryptos(rows: DataFrame) -> Graph:
    """Assets by code or symbol: the last row's name and summary hold; no provider ids."""
    own = text.crypto_id(_col(rows, "cryptocurrency"), _col(rows, "symbol"))
    name = text.summary_name(_col(rows, "summary"), _col(rows, "name"), _col(rows, "cryptocurrency"), _col(rows, "symbol"))
    kept = rows.select(own.alias("entity_id"), F.lit("crypto").alias("entity_type"), name.alias("name"), metadata.build(summary=_col(rows, "summary")).alias("m"), "row_idx").where("entity_id IS NOT NULL")
    last = keep_last(kept, ["entity_id"], F.col("row_idx")).select("entity_id", "entity_type", "name", metadata.parse(F.col("m")).alias("members"))
    spark = rows.sparkSession
    return Graph(last, spark.createDataFrame([], "provider string, provider_entity_id string, entity_id string"), spark.createDataFrame([], "src string, dst string, relation string"))


IDENTIFIERS = ("isin", "cusip", "figi", "composite_figi", "shareclass_figi")


def equities(rows: DataFrame, provider: str, markets: dict[str, str] | None = None, countries: dict[str, str] | None = None, stored: Graph | None = None) -> Graph:
    """Listed shares: rows of one company, by common identifiers or equal name keys, collapse onto its first security.

    Rows without a symbol or with a market neither in ``markets`` nor told by
    the suffix are skipped. A name that is neither a company's nor a fund's
    gives a security without an issuer. The security id is the ISIN's, else
    the ticker's. Chains of identifiers are followed to the end. The country is
    the row's, else that of its market, else the US. A group that meets a
    stored company, by an identifier of one of its securities or by its name
    key, belongs to it and takes its latest security.
    """
    markets = static.exchange_codes() if markets is None else markets
    countries = static.country_codes() if countries is None else countries
    symbol, name = _col(rows, "symbol"), _col(rows, "name")
    known = F.element_at(F.create_map(*[F.lit(x) for p in markets.items() for x in p]), F.upper(_col(rows, "exchange")))
    mic = F.coalesce(known, text.suffix_market(symbol))
    own = F.coalesce(F.concat(F.lit("sec:isin:"), text.isin(_col(rows, "isin"))), F.concat(F.lit("sec:ticker:"), text.ticker(symbol)))
    lookup = lambda table, c: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c)
    iso = F.coalesce(lookup(countries, F.lower(_col(rows, "country"))), lookup(static.market_countries(), F.upper(mic)))
    fund = classify.is_fund_name(name)
    rows = rows.select(
        "*", F.concat(F.lit("mic:"), F.lower(mic)).alias("_mic"), own.alias("_own"), text.name_key(name).alias("_key"), fund.alias("_fund"), (~fund & classify.is_company_name(name)).alias("_company"), iso.alias("_iso")
    ).where(symbol.isNotNull() & mic.isNotNull() & F.col("_own").isNotNull())
    rows = cut_lineage(rows)  # read by every table of the graph
    links = [rows.select("row_idx", F.concat(F.lit(f"{c}:"), F.upper(_col(rows, c))).alias("link")) for c in IDENTIFIERS if c in rows.columns]
    links.append(rows.select("row_idx", F.when(F.col("_company") & (F.col("_key") != ""), F.concat(F.lit("name:"), "_key")).alias("link")))
    whole = links[0]
    for part in links[1:]:
        whole = whole.unionByName(part)
    rows = rows.join(ent.connected_rows(whole), "row_idx")
    head = rows.groupBy("group").agg(
        F.min(F.when(F.col("_company"), F.struct("row_idx", F.concat(F.lit("company:"), F.coalesce("_iso", F.lit("us")), F.lit(":"), text.slug(_col(rows, "name"))).alias("id"), _col(rows, "name").alias("name"))))["id"].alias("company"),
        F.min(F.when(F.col("_company"), F.struct("row_idx", "_own")))["_own"].alias("first_security"),
    )
    if stored is not None:
        head = head.join(stored_companies(rows, stored), "group", "left")
        head = head.select("group", F.coalesce("stored_company", "company").alias("company"), F.coalesce("stored_security", "first_security").alias("first_security"))
    rows = rows.join(head, "group")
    rows = cut_lineage(rows.withColumn("security", F.when(F.col("company").isNotNull(), F.coalesce("first_security", "_own")).otherwise(F.col("_own"))))
    issuer = F.when(F.col("company").isNotNull(), F.col("company")).when(F.col("_fund"), F.concat(F.lit("fund_entity:"), F.nullif(text.slug(F.col("_key"), "-", None), F.lit(""))))
    place = lambda c, kind: F.concat(F.lit(f"{kind}:listed:"), F.nullif(text.slug(_col(rows, c), "-", None), F.lit("")))
    meta = metadata.parse(metadata.build(isin=_col(rows, "isin"), currency=F.concat(F.lit("ccy:"), F.lower(_col(rows, "currency")))))
    name = _col(rows, "name")
    nodes = _first_entities(
        _entity(rows, F.col("security"), "security", name, meta), _entity(rows, F.col("_mic"), "exchange", F.upper(F.substring_index("_mic", ":", -1))),
        _entity(rows.where("company IS NOT NULL"), F.col("company"), "company", name), _entity(rows.where("company IS NULL"), issuer, "fund_entity", name),
        _entity(rows, place("sector", "sector"), "sector", _col(rows, "sector")), _entity(rows, place("industry", "industry"), "industry", _col(rows, "industry")),
    )
    ids = [rows.select(F.lit(provider).alias("provider"), _col(rows, "symbol").alias("provider_entity_id"), F.col("security").alias("entity_id"), "row_idx")]
    ids += [rows.where("company IS NOT NULL").select(F.lit(f"provider:{c.rpartition('_')[2]}").alias("provider"), _col(rows, c).alias("provider_entity_id"), F.col("security").alias("entity_id"), "row_idx") for c in IDENTIFIERS if c in rows.columns]
    whole_ids = ids[0]
    for part in ids[1:]:
        whole_ids = whole_ids.unionByName(part)
    whole_ids = keep_first(whole_ids.where("provider_entity_id IS NOT NULL"), ["provider", "provider_entity_id"], F.col("row_idx")).drop("row_idx")
    edges = _edges(
        _edge(rows, F.col("security"), F.col("_mic"), LISTED_ON), _edge(rows, F.col("security"), place("sector", "sector"), SECTOR), _edge(rows, F.col("security"), place("industry", "industry"), INDUSTRY), _edge(rows, issuer, F.col("security"), ISSUED)
    )
    return Graph(nodes, whole_ids, edges)


def stored_companies(rows: DataFrame, stored: Graph) -> DataFrame:
    """(group, stored_company, stored_security): the stored company a group of listings belongs to, with its latest security.

    First by an identifier that the provider maps hold, then by the company's
    name key; of several hits that of the earliest row counts.
    """
    issued = stored.relations.where(F.col("relation") == ISSUED).select(F.col("src").alias("company"), F.col("dst").alias("security")).where(F.startswith("company", F.lit("company:")))
    held = [stored.provider_ids.where(F.col("provider") == f"provider:{c.rpartition('_')[2]}").select(F.upper("provider_entity_id").alias("identifier"), F.col("entity_id").alias("security")) for c in IDENTIFIERS if c in rows.columns]
    by_id = None
    if held:
        securities = held[0]
        for part in held[1:]:
            securities = securities.unionByName(part)
        upper = rows.select("row_idx", *[F.upper(_col(rows, c)).alias(c) for c in IDENTIFIERS if c in rows.columns])
        by_id = ent.by_identifier(upper, [c for c in IDENTIFIERS if c in rows.columns], securities.distinct(), issued).select("row_idx", F.lit(0).alias("rank"), "company")
    keys = stored.entities.where("entity_type = 'company'").select(text.name_key(F.col("name")).alias("key"), F.col("entity_id").alias("id"), F.col("entity_id").alias("row_idx"))
    named = rows.where(F.col("_company")).select("row_idx", F.col("_key").alias("key")).join(ent.by_name(keys, "key"), "key").select("row_idx", F.lit(1).alias("rank"), F.col("id").alias("company"))
    hits = (by_id.unionByName(named) if by_id is not None else named).join(rows.select("row_idx", "group"), "row_idx")
    first = hits.groupBy("group").agg(F.min(F.struct("rank", "row_idx", "company"))["company"].alias("stored_company"))
    latest = issued.groupBy("company").agg(F.max("security").alias("stored_security"))
    return first.join(latest, first["stored_company"] == latest["company"], "left").select("group", "stored_company", "stored_security")


def exchange_entities(entities: DataFrame, codes: DataFrame, provider: str) -> Graph:
    """Exchanges with the codes a provider uses for them; the currency they trade in is created with its edge."""
    rows = entities.withColumn("row_idx", F.lit(0).cast("bigint"))
    members = F.create_map(F.lit("country"), F.col("country")).cast(metadata.MAP)
    nodes = _first_entities(_entity(rows, F.col("entity_id"), "exchange", F.col("name"), members), _entity(rows, F.col("traded_in"), "currency", F.upper(F.substring_index("traded_in", ":", -1))))
    ids = codes.select(F.lit(provider).alias("provider"), F.col("code").alias("provider_entity_id"), "entity_id")
    return Graph(nodes, ids, _edges(_edge(rows, F.col("entity_id"), F.col("traded_in"), "traded_in")))


def currency_entities(rows: DataFrame, provider: str) -> tuple[Graph, DataFrame]:
    """(graph, failed) of (code, name): rows with a blank code or name fail."""
    good = (F.coalesce(F.trim("code"), F.lit("")) != "") & (F.coalesce(F.trim("name"), F.lit("")) != "")
    kept = rows.where(good).withColumn("row_idx", F.lit(0).cast("bigint"))
    own = F.concat(F.lit("ccy:"), F.lower(F.trim("code")))
    nodes = _first_entities(_entity(kept, own, "currency", F.trim("name")))
    ids = kept.select(F.lit(provider).alias("provider"), F.upper(F.trim("code")).alias("provider_entity_id"), own.alias("entity_id")).distinct()
    return Graph(nodes, ids, _edges(_edge(kept.where("false"), own, own, "none"))), rows.where(~good)


def us_symbol_entities(rows: DataFrame, provider: str, also: str) -> Graph:
    """Securities of (symbol, name, exchange), known to two providers by their symbol; the first row of a ticker counts."""
    rows = rows.where(_col(rows, "symbol").isNotNull() & _col(rows, "name").isNotNull() & _col(rows, "exchange").isNotNull())
    own = F.concat(F.lit("sec:ticker:"), text.ticker(F.col("symbol")))
    mic = F.concat(F.lit("mic:"), F.lower(text.market(F.col("exchange"), F.col("symbol"), static.exchange_codes())))
    nodes = _first_entities(_entity(rows, own, "security", F.trim("name")), _entity(rows, mic, "exchange", F.upper(F.substring_index(mic, ":", -1))))
    ids = rows.where(own.isNotNull()).select(F.explode(F.array(F.lit(provider), F.lit(also))).alias("provider"), F.trim("symbol").alias("provider_entity_id"), own.alias("entity_id"), "row_idx")
    return Graph(nodes, keep_first(ids, ["provider", "provider_entity_id"], F.col("row_idx")).drop("row_idx"), _edges(_edge(rows, own, mic, LISTED_ON)))


def region_entities(regions: DataFrame, provider: str) -> Graph:
    """National and first-order regions of (entity_id, name, kind), known to the provider by the last part of their id."""
    rows = regions.where("entity_id IS NOT NULL").withColumn("row_idx", F.lit(0).cast("bigint"))
    members = F.create_map(F.lit("kind"), F.col("kind")).cast(metadata.MAP)
    ids = rows.select(F.lit(provider).alias("provider"), F.col("entity_id").alias("provider_entity_id"), "entity_id").distinct()
    return Graph(_first_entities(_entity(rows, F.col("entity_id"), "region", F.col("name"), members)), ids, _edges(_edge(rows.where("false"), F.col("entity_id"), F.col("entity_id"), "none")))


def skipped(rows: DataFrame, *required: str) -> DataFrame:
    """Rows that a pipeline skips because one of the required fields is blank; absent columns count as blank."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | _col(rows, c).isNull()
    return rows.where(lacking)


def missing_from(graph: Graph, stored: Graph) -> Graph:
    """What of a graph is not stored yet: venues, currencies, companies, provider ids and edges to be created."""
    return Graph(
        new_only(graph.entities, stored.entities, ["entity_id"]),
        new_only(graph.provider_ids, stored.provider_ids, ["provider", "provider_entity_id"]),
        new_only(graph.relations, stored.relations, ["src", "dst", "relation"]),
    )


def companies(rows: DataFrame, existing: DataFrame, provider: str, country: str = "us") -> Graph:
    """Filers (cik, ticker, name): entity by name with members merged over those there are, and an edge to the ticker's security if it exists."""
    rows = rows.withColumn("entity_id", F.concat(F.lit(f"company:{country}:"), text.slug(_col(rows, "name"))))
    added = ent.metadata_by_key(rows.withColumn("_m", metadata.build(cik=_col(rows, "cik"), ticker=_col(rows, "ticker"))), "entity_id", "_m", "row_idx")
    old = existing.where("entity_type = 'company'").select("entity_id", F.col("members").alias("_old"))
    first = keep_first(rows.select("entity_id", _col(rows, "name").alias("name"), "row_idx"), ["entity_id"], F.col("row_idx"))
    nodes = first.join(added, "entity_id").join(old, "entity_id", "left")
    nodes = nodes.select("entity_id", F.lit("company").alias("entity_type"), "name", metadata.overlay(F.coalesce("_old", F.create_map().cast(metadata.MAP)), F.col("members")).alias("members"))
    ids = keep_first(rows.select(F.lit(provider).alias("provider"), F.col("cik").alias("provider_entity_id"), "entity_id", "row_idx"), ["provider", "provider_entity_id"], F.col("row_idx")).drop("row_idx")
    edges = _edge(rows, F.col("entity_id"), F.concat(F.lit("sec:ticker:"), text.ticker(_col(rows, "ticker"))), ISSUED)
    return Graph(nodes, ids, _edges(edges.join(existing.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "relation")))


def merge_graphs(*graphs: Graph) -> Graph:
    """One graph; of an entity the graph named first counts."""
    parts = [g.entities.withColumn("row_idx", F.lit(i).cast("bigint")) for i, g in enumerate(graphs)]
    ids, edges = graphs[0].provider_ids, graphs[0].relations
    for g in graphs[1:]:
        ids, edges = ids.unionByName(g.provider_ids), edges.unionByName(g.relations)
    return Graph(_first_entities(*parts), ids.distinct(), edges.distinct())
