"""Sources that load files into the catalog, and a small command line."""

from __future__ import annotations

import argparse
import os
import sys

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverbarn.catalog import Catalog, DataSource, Sources
from silverbarn.operators.entities import provider_ids_of
from silverbarn.operators.upsert import keep_last
from silverbarn.session import cut_lineage
from silverbarn.sources import archives, tables


def _store(catalog: Catalog, name: str, rows, key: list[str], sequence: str) -> int:
    """Upsert into the catalog; the row later in the load wins. The number of rows brought in."""
    rows = keep_last(rows, key, F.col(sequence))
    return catalog.upsert(name, rows.drop("load_order") if sequence == "load_order" else rows, key)


class Bars(DataSource):
    name, brief = "market", "daily bars of instruments by provider"

    def ensure_up_to_date(self, path: str) -> dict[str, int]:
        rows = archives.bar_archive(archives.read_zip(self.catalog.spark, path)).withColumn("load_order", F.monotonically_increasing_id())
        return {"candles": _store(self.catalog, "candles", rows, ["canonical_id", "start_ts", "provider"], "load_order")}


class Housing(DataSource):
    name, brief = "housing", "regional housing metrics by month and property type"

    def ensure_up_to_date(self, path: str) -> dict[str, int]:
        rows = tables.housing_tsv(self.catalog.spark, path, "housing").withColumn("load_order", F.monotonically_increasing_id())
        t = tables.housing_tables(rows)
        key = ["region_id", "property_type_id", "period_start_date", "period_granularity"]
        done = {name: _store(self.catalog, name, t[name], k, "load_order") for name, k in (("regions", ["region_id"]), ("region_provider_map", ["provider", "provider_region_id"]), ("property_types", ["property_type_id"]))}
        return {"market_metrics": _store(self.catalog, "market_metrics", t["market_metrics"], key, "load_order"), **done, "rejected": rows.where(F.col("reject").isNotNull()).count()}


class Filings(DataSource):
    name, brief = "filings", "company submissions with their pages"

    def ensure_up_to_date(self, path: str) -> dict[str, int]:
        rows = archives.submissions(archives.read_zip(self.catalog.spark, path))
        return {"submissions": _store(self.catalog, "submissions", rows, ["cik"], "fetched_at")}


class BarProvider(Protocol):
    """A source of daily bars: a name, and the bars it has of instruments by its own ids."""

    name: str

    def fetch(self, ids: DataFrame) -> DataFrame:
        """(provider_entity_id, day, open, high, low, close, adj_close, volume) of the ids in ``provider_entity_id``."""


def provider_bars(provider: BarProvider, wanted: DataFrame, mapping: DataFrame, as_of: Column) -> DataFrame:
    """Bars of the wanted entities from a provider: by the id it is known to use, else the last part of the entity's id in capitals.

    Bars without a day or close are dropped; an id without bars is simply absent.
    """
    known = provider_ids_of(wanted, mapping, provider.name, as_of)
    ids = wanted.select("entity_id").distinct().join(known, "entity_id", "left")
    ids = cut_lineage(ids.withColumn("provider_entity_id", F.coalesce("provider_entity_id", F.upper(F.substring_index("entity_id", ":", -1)))))
    rows = provider.fetch(ids.select("provider_entity_id").distinct()).join(ids, "provider_entity_id")
    return rows.where(F.col("day").isNotNull() & F.col("close").isNotNull()).select(
        F.col("entity_id").alias("canonical_id"), F.col("day").alias("start_ts"), F.lit(provider.name).alias("provider"), *("open", "high", "low", "close", "adj_close", "volume")
    )


def all_sources(catalog: Catalog) -> Sources:
    return Sources(Bars(catalog), Housing(catalog), Filings(catalog))


def data_root(given: str | None = None) -> str:
    """Where the tables lie: as given, else $SILVERBARN_DATA, else ./data."""
    return given or os.environ.get("SILVERBARN_DATA") or os.path.join(os.getcwd(), "data")


def main(args: list[str] | None = None) -> int:
    """``python -m silverbarn.ingest update SOURCE PATH`` or ``seed LIST [PATH] [--limit N]``, with ``--data-root ROOT``; exit code 1 for an unknown name."""
    from silverbarn import seeding
    from silverbarn.session import get_session

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("what", choices=("update", "seed"))
    p.add_argument("name")
    p.add_argument("path", nargs="?", default="")
    p.add_argument("--data-root")
    p.add_argument("--limit", type=int)
    a = p.parse_args(args)
    catalog = Catalog(get_session(), data_root(a.data_root))
    sources = all_sources(catalog)
    known = seeding.PIPELINES if a.what == "seed" else sources.by_name
    if a.name not in known:
        print(f"unknown name {a.name}; there are {', '.join(sorted(known))}", file=sys.stderr)
        return 1
    print(seeding.seed(catalog, a.name, a.path, a.limit) if a.what == "seed" else sources.get(a.name).ensure_up_to_date(a.path))
    return 0


if __name__ == "__main__":
    sys.exit(main())
