"""Seeding: reference lists into the catalog's entities, provider ids and relations.

Every pipeline reads its list, looks up what is stored, writes only what is
missing and reports how many entities, ids and edges it added and how many rows
it skipped. Running one again adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbarn.catalog import Catalog
from silverbarn.functions import metadata
from silverbarn.operators import listings
from silverbarn.operators.listings import Graph
from silverbarn.session import cut_lineage
from silverbarn.sources import tables

LISTS, FILINGS, SYMBOLS, HISTORY, LAND = "provider:lists", "provider:filings", "provider:symbols", "provider:history", "provider:iso"

#: Tables of the graph with their keys.
KEYS = {"entities": ["entity_id"], "provider_ids": ["provider", "provider_entity_id"], "relations": ["src", "dst", "relation"]}
_SCHEMAS = {
    "entities": f"entity_id string, entity_type string, name string, members {metadata.MAP}",
    "provider_ids": "provider string, provider_entity_id string, entity_id string",
    "relations": "src string, dst string, relation string",
}


@dataclass
class Seeded:
    entities: int
    provider_ids: int
    relations: int
    skipped: int = 0


def stored_graph(catalog: Catalog) -> Graph:
    """What the catalog holds; empty tables where there is nothing yet."""
    read = lambda name: catalog.read(name) if catalog.exists(name) else catalog.spark.createDataFrame([], _SCHEMAS[name])
    return Graph(*[read(name) for name in KEYS])


def add(catalog: Catalog, graph: Graph, skipped: int = 0) -> Seeded:
    """Adds what of the graph is missing."""
    new = listings.missing_from(graph, stored_graph(catalog))
    # all three are read before the first is written
    parts = {name: cut_lineage(getattr(new, name).dropDuplicates(key)) for name, key in KEYS.items()}
    return Seeded(*[catalog.upsert(name, parts[name], key) for name, key in KEYS.items()], skipped)


def _products(kind: str, fallback: str) -> Callable:
    def run(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, DataFrame]:
        rows = tables.listed_csv(catalog.spark, path, limit)
        return listings.products(rows, kind, fallback, LISTS), listings.skipped(rows, "symbol")

    return run


def _funds(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, DataFrame]:
    rows = tables.listed_csv(catalog.spark, path, limit)
    return listings.funds(rows, LISTS), listings.skipped(rows, "symbol")


def _cryptos(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, DataFrame]:
    rows = tables.listed_csv(catalog.spark, path, limit)
    either = F.coalesce(F.nullif(F.trim("cryptocurrency"), F.lit("")), F.nullif(F.trim("symbol"), F.lit("")))
    return listings.cryptos(rows), rows.where(either.isNull())


def _equities(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, DataFrame]:
    rows = tables.listed_csv(catalog.spark, path, limit)
    return listings.equities(rows, LISTS, stored=stored_graph(catalog)), listings.skipped(rows, "symbol")


def _exchanges(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, None]:
    return listings.exchange_entities(*tables.exchanges(catalog.spark), LISTS), None


def _currencies(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, DataFrame]:
    return listings.currency_entities(tables.currency_codes(catalog.spark, path), LISTS)


def _symbols(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, None]:
    rows = tables.us_symbols(catalog.spark, path).withColumn("row_idx", F.monotonically_increasing_id())
    return listings.us_symbol_entities(rows, SYMBOLS, HISTORY), None


def _companies(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, None]:
    rows = tables.company_tickers(catalog.spark, path).withColumn("row_idx", F.monotonically_increasing_id())
    return listings.companies(rows, stored_graph(catalog).entities, FILINGS), None


def _regions(catalog: Catalog, path: str, limit: int | None) -> tuple[Graph, None]:
    rows = catalog.spark.read.options(header=True, quote='"', escape='"').csv(path).select("country", "code", "name", "kind")
    return listings.region_entities(tables.regions_of(rows), LAND), None


#: Name of a list to its pipeline.
PIPELINES: dict[str, Callable] = {
    "regions": _regions, "exchanges": _exchanges, "currencies": _currencies, "companies": _companies, "symbols": _symbols, "equities": _equities,
    "etfs": _products("etf", "etf"), "indices": _products("index", "index"), "moneymarkets": _products("moneymarket", "moneymarket"), "funds": _funds, "cryptos": _cryptos,
}


def seed(catalog: Catalog, name: str, path: str = "", limit: int | None = None) -> Seeded:
    """Runs the pipeline of a list; an unknown one is a KeyError."""
    graph, skipped = PIPELINES[name](catalog, path, limit)
    return add(catalog, graph, skipped.count() if skipped is not None else 0)
