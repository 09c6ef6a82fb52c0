"""Delimited and JSON reference files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbarn.functions import regions, static, text
from silverbarn.operators.entities import with_parent
from silverbarn.operators.upsert import keep_last

#: Measures of a housing file and the columns they come from; fixed values.
HOUSING_DOUBLES = dict(
    median_sale_price="MEDIAN_SALE_PRICE", median_list_price="MEDIAN_LIST_PRICE", median_dom="MEDIAN_DOM", sale_to_list_ratio="AVG_SALE_TO_LIST",
    price_drops_pct="PRICE_DROPS", months_supply="MONTHS_OF_SUPPLY", avg_ppsf="MEDIAN_PPSF",
)
HOUSING_LONGS = dict(homes_sold="HOMES_SOLD", new_listings="NEW_LISTINGS", inventory="INVENTORY", pending_sales="PENDING_SALES")


def housing_tsv(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Rows of all gzip files of the path; a truncated file gives the rows that can be read.

    Missing measures, '' and 'NA' are null. Rows for which no region id can be
    built carry the reason in ``reject``.
    """
    raw = spark.read.options(sep="\t", header=True, quote='"', escape='"', ignoreCorruptFiles=True, pathGlobFilter="*.gz").csv(path)
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    region = (col("REGION_TYPE"), F.trim(col("REGION")), F.trim(col("STATE_CODE")), F.trim(col("CITY")))
    return raw.select(
        F.lit(provider).alias("source_provider"),
        F.coalesce(F.nullif(col("TABLE_ID"), F.lit("")), F.nullif(col("REGION_TYPE_ID"), F.lit("")), F.lit("")).alias("provider_region_id"),
        F.nullif(col("PARENT_METRO_REGION_METRO_CODE"), F.lit("")).alias("parent_code"),
        regions.region_id(*region, F.lit("us")).alias("region_id"),
        regions.region_error(*region).alias("reject"),
        region[1].alias("region_name"),
        F.coalesce(col("PROPERTY_TYPE_ID"), F.lit("")).alias("property_type_id"),
        F.coalesce(F.nullif(col("PROPERTY_TYPE"), F.lit("")), col("PROPERTY_TYPE_ID")).alias("property_type_name"),
        F.try_to_date(col("PERIOD_BEGIN"), "yyyy-MM-dd").alias("period_start_date"),
        col("PERIOD_DURATION").alias("period_granularity"),
        text.revision(col("LAST_UPDATED")).alias("data_revision"),
        *[text.lenient_double(col(c)).alias(n) for n, c in HOUSING_DOUBLES.items()],
        *[text.lenient_long(col(c)).alias(n) for n, c in HOUSING_LONGS.items()],
    )


def housing_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a housing load: regions with their parent, provider ids, property types and metrics, later rows winning.

    ``rows`` as ``housing_tsv`` gives them, with ``load_order``. A row with a
    reason to reject counts nowhere. The metrics' key leaves the revision out,
    so the row later in the load wins even if its revision is older.
    """
    good = rows.where(F.col("reject").isNull())
    last = lambda cols, key: keep_last(good.select(*cols, "load_order"), key, F.col("load_order"))
    regions_ = last([F.col("source_provider").alias("provider"), "region_id", "region_name", F.col("provider_region_id").alias("code"), "parent_code"], ["region_id"])
    metrics = last([c for c in good.columns if c not in ("reject", "parent_code", "region_name", "property_type_name", "provider_region_id", "load_order")], ["region_id", "property_type_id", "period_start_date", "period_granularity"])
    return {
        "regions": with_parent(regions_, "code", "parent_code"),
        "region_provider_map": last([F.col("source_provider").alias("provider"), "provider_region_id", "region_id", F.col("region_name").alias("provider_name"), "data_revision"], ["provider", "provider_region_id"]).where("provider_region_id <> ''"),
        "property_types": last(["property_type_id", "property_type_name"], ["property_type_id"]).where("property_type_id <> ''"),
        "market_metrics": metrics,
    }


def listed_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV with quoted line ends and ``row_idx`` by file and place; with ``limit`` the first rows only."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    rows = rows.withColumn("row_idx", F.monotonically_increasing_id())
    return rows.orderBy("row_idx").limit(limit) if limit else rows


def us_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, name, exchange); rows with a blank one are skipped. Column names in any letter case."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    cols = [F.trim(F.col(c)).alias(c.lower()) for c in ("Symbol", "Name", "Exchange")]
    return rows.select(*cols).where((F.col("symbol") != "") & (F.col("name") != "") & (F.col("exchange") != ""))


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(cik, ticker, name) of a JSON object keyed by ordinal; rows without ticker or title are dropped."""
    kind = "map<string,struct<cik_str:string,ticker:string,title:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", kind))).alias("r"))
    out = rows.select(text.cik(F.col("r.cik_str")).alias("cik"), F.trim("r.ticker").alias("ticker"), F.trim("r.title").alias("name"))
    return out.where((F.col("ticker") != "") & (F.col("name") != ""))


def currency_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a JSON object code to name, blank ones too."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "name"))


def currencies(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, code, name) of a JSON object code to name; blank codes are left out."""
    rows = currency_codes(spark, path)
    return rows.where(F.trim("code") != "").select(F.concat(F.lit("ccy:"), F.lower(F.trim("code"))).alias("entity_id"), F.upper(F.trim("code")).alias("code"), "name")


def regions_of(rows: DataFrame) -> DataFrame:
    """Region entities of (country, code, name, kind): the nation for a blank code, else state or province."""
    us_state = (F.lower("country") == "us") & F.lower("kind").isin("state", "district", "territory", "outlying area")
    kind = F.when(F.coalesce(F.col("code"), F.lit("")) == "", F.lit("national")).when(us_state, F.lit("state")).otherwise(F.lit("province"))
    return rows.select(regions.region_id(kind, F.col("name"), F.col("code"), F.lit(None), F.col("country")).alias("entity_id"), "name", kind.alias("kind"))


def admin_regions(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """``regions_of`` a list of the driver's."""
    return regions_of(spark.createDataFrame(rows, "country string, code string, name string, kind string"))


def exchanges(spark: SparkSession, rows: Sequence[tuple] = static.EXCHANGES) -> tuple[DataFrame, DataFrame]:
    """(entities, provider codes) of (mic, name, country, currency, codes)."""
    df = spark.createDataFrame([(*r[:4], list(r[4])) for r in rows], "mic string, name string, country string, currency string, codes array<string>")
    df = df.withColumn("entity_id", F.concat(F.lit("mic:"), F.lower("mic")))
    return df.select("entity_id", "name", "country", F.concat(F.lit("ccy:"), F.lower("currency")).alias("traded_in")), df.select("entity_id", F.explode("codes").alias("code"))
