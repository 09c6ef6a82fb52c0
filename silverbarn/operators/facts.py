"""Fact star schema: view, history and concept registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fact_view(facts: DataFrame, concepts: DataFrame, contexts: DataFrame, units: DataFrame) -> DataFrame:
    """Facts with their concept (inner), context and unit (left)."""
    return left_lookup(left_lookup(facts.join(concepts, "concept_id"), contexts, "context_id"), units, "unit_id")


def left_lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key, which find nothing, spread over all tasks."""
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(1009)) + 1).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumn("_salt", salt).join(dimension.withColumn("_salt", F.lit(0).cast("bigint")), [key, "_salt"], "left").drop("_salt")


def context_date(end: str = "end_date", instant: str = "instant_date", start: str = "start_date") -> Column:
    return F.coalesce(end, instant, start)


def fact_history(
    facts: DataFrame,
    concepts: DataFrame,
    contexts: DataFrame,
    units: DataFrame,
    filings: DataFrame,
    names: Sequence[str] | None = None,
    accession: str | None = None,
    period_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Newest facts of the filings: by context date, accession, then fact id, all descending, nulls last.

    Filters reach the dimension scans before the joins; the filings restrict
    the facts by a semi-join, so their number is unbounded. ``names`` are
    qualified names; None asks for all concepts, an empty list is an error.
    """
    if names is not None and not names:
        raise ValueError("at least one concept is required")
    concepts = concepts.where(F.col("qname").isin(*names)) if names is not None else concepts
    contexts = contexts.withColumn("as_of", context_date())
    for value, keep in ((period_type, F.col("period_type") == period_type), (start, F.col("as_of") >= F.lit(start).cast("date")), (end, F.col("as_of") <= F.lit(end).cast("date"))):
        contexts = contexts.where(keep) if value is not None else contexts
    facts = facts.where(F.col("accession") == accession) if accession is not None else facts
    rows = facts.join(filings.select("accession").distinct(), "accession", "left_semi").join(concepts, "concept_id").join(contexts, "context_id")
    rows = left_lookup(rows, units, "unit_id")
    ordered = rows.orderBy(F.col("as_of").desc_nulls_last(), F.col("accession").desc(), F.col("fact_id").desc())
    return ordered.limit(limit) if limit else ordered


def concept_registry(facts: DataFrame, filings: DataFrame, concepts: DataFrame, friendly: dict[str, str] | None = None, by: str = "qname") -> DataFrame:
    """Sorted set of concept names per company and friendly name.

    A filing shared by several companies counts for each. Names without a
    friendly name are dropped if a table is given; else the column ``by`` of
    the concepts is the friendly name.
    """
    pairs = facts.select("accession", "concept_id").distinct().join(filings.select("accession", "cik").distinct(), "accession").join(concepts, "concept_id")
    if friendly is not None:
        table = F.create_map(*[F.lit(x) for pair in friendly.items() for x in pair])
        pairs = pairs.withColumn("concept", F.element_at(table, F.col("qname"))).where(F.col("concept").isNotNull())
    else:
        pairs = pairs.withColumn("concept", F.col(by))
    return pairs.groupBy("cik", "concept").agg(F.array_sort(F.collect_set("qname")).alias("qnames"))


def look_up(registry: DataFrame, cik: str, concept: str, seed: dict[str, Sequence[str]]) -> list[str]:
    """Names under which a company reports a concept: those registered, else those of the seed list; an unknown concept is an error."""
    row = registry.where((F.col("cik") == cik) & (F.lower("concept") == concept.strip().lower())).select("qnames").first()
    if row and row["qnames"]:
        return list(row["qnames"])
    known = {k.lower(): list(v) for k, v in seed.items()}
    if concept.strip().lower() not in known:
        raise ValueError(f"unknown concept {concept}; there are {', '.join(sorted(seed))}")
    return known[concept.strip().lower()]


def by_dimension(facts: DataFrame, dimensions: DataFrame, axis: str | None = None, member: str | None = None) -> DataFrame:
    """Facts with the axes and members of their context, one row each; null for facts of the whole entity."""
    wanted = dimensions
    for value, column in ((axis, "axis"), (member, "member")):
        wanted = wanted.where(F.col(column) == value) if value is not None else wanted
    return facts.join(wanted, "context_id", "left" if axis is None and member is None else "inner")


def registry_json(registry: DataFrame) -> DataFrame:
    """One JSON object of concepts per company, keys in order."""
    entries = F.array_sort(F.collect_list(F.struct("concept", "qnames")))
    return registry.groupBy("cik").agg(F.to_json(F.map_from_entries(entries)).alias("concepts"))
