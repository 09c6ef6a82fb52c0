"""Identity resolution: provider ids, identifiers, names and slugs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silverbarn.functions import metadata
from silverbarn.session import cut_lineage


def active_strict(end: str, as_of: Column) -> Column:
    return F.col(end).isNull() | (F.col(end) > as_of)


def active_inclusive(end: str, as_of: Column) -> Column:
    return F.col(end).isNull() | (F.col(end) >= as_of)


def resolve(rows: DataFrame, mapping: DataFrame, key: Sequence[str], active: Column, newest: str | None = None, how: str = "left") -> DataFrame:
    """Rows with the active mapping of their provider id; of several the one with the greatest ``newest``."""
    held = mapping.where(active)
    if newest:
        rest = [c for c in held.columns if c not in key]
        held = held.groupBy(*key).agg(F.max(F.struct(F.col(newest).alias("_n"), *rest)).alias("_m")).select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest])
    return rows.join(held, list(key), how)


def identifiers_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row_idx, rank, identifier) for each identifier given, in order, each once per row."""
    array = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])))
    return rows.select("row_idx", F.posexplode(array).alias("rank", "identifier"))


def by_identifier(rows: DataFrame, columns: Sequence[str], securities: DataFrame, issuers: DataFrame) -> DataFrame:
    """(row_idx, company): identifier to security to issuing company; the first identifier with a hit wins."""
    hits = identifiers_of(rows, columns).join(securities, "identifier").join(issuers, "security")
    return hits.groupBy("row_idx").agg(F.min(F.struct("rank", "company")).alias("m")).select("row_idx", "m.company")


def latest_security(issuers: DataFrame) -> DataFrame:
    """Each company's security with the newest edge; ties fall to the greater id."""
    return issuers.groupBy("company").agg(F.max(F.struct("created_at", "security")).alias("m")).select("company", "m.security")


def by_name(rows: DataFrame, key: str) -> DataFrame:
    """(name key, id): the id registered first under each key."""
    return rows.where(F.col(key) != "").groupBy(key).agg(F.min(F.struct("row_idx", "id")).alias("m")).select(key, F.col("m.id").alias("id"))


def connected_rows(links: DataFrame, row: str = "row_idx", value: str = "link") -> DataFrame:
    """(row, group): rows joined through common values, group the least row; label propagation to the end.

    Each round shrinks every chain by the values' groups; lineage is cut into
    the shared folder each round, so a lost executor costs one round.
    """
    ties = cut_lineage(links.select(row, value).dropna().distinct())
    state = cut_lineage(links.select(row).distinct().withColumn("group", F.col(row)))
    while True:
        by_value = ties.join(state, row).groupBy(value).agg(F.min("group").alias("g"))
        least = ties.join(by_value, value).groupBy(row).agg(F.min("g").alias("g"))
        # jump: the group of the group found so far
        new = state.join(least, row, "left").select(row, F.least("group", F.coalesce("g", "group")).alias("g2"), F.col("group").alias("was"))
        heads = state.select(F.col(row).alias("g2"), F.col("group").alias("head"))
        new = cut_lineage(new.join(heads, "g2", "left").select(row, F.least("g2", F.coalesce("head", "g2")).alias("group"), "was"))
        state = new.select(row, "group")
        if new.where(F.col("group") < F.col("was")).isEmpty():
            return state


def _fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slug and order; only the open slug's members are held."""
    slug, held = None, {}
    for batch in batches:
        clash = []
        for s, members in zip(batch.column("slug").to_pylist(), batch.column("m").to_pylist()):
            if s != slug:
                slug, held = s, {}
            new = dict(members or ())
            bad = any(v is not None and held.get(k) is not None and held[k] != v for k, v in new.items())
            if not bad:
                held.update(new)
            clash.append(bad)
        yield pa.RecordBatch.from_arrays([batch.column("slug"), batch.column("a"), batch.column("t"), pa.array(clash, pa.bool_())], ["slug", "a", "t", "clash"])


def merge_or_split(rows: DataFrame, slug: str, alternate: str, text: str, order: str) -> DataFrame:
    """Entities of rows that share a slug: compatible rows merge, a conflicting row goes to its alternate id.

    A row is compared with what the slug's entity holds by then, so rows stream
    in row order within a slug, past nothing but the entity's members; a row
    without conflict adds its own. A repeated row always meets the fate of its
    first, so only distinct rows pass. Returns (slug, row order, entity id).
    """
    kept = rows.select(F.col(slug).alias("slug"), F.col(order).cast("bigint").alias("o"), F.col(alternate).alias("a"), F.col(text).alias("t"))
    distinct = kept.groupBy("slug", "a", "t").agg(F.min("o").alias("o"))
    ordered = distinct.withColumn("m", metadata.parse(F.col("t"))).repartition("slug").sortWithinPartitions("slug", "o")
    fate = ordered.select("slug", "a", "t", "m").mapInArrow(_fates, "slug string, a string, t string, clash boolean")
    fate = fate.select(F.col("slug").alias("s"), F.col("a").alias("a2"), F.col("t").alias("t2"), F.when(F.col("clash"), F.col("a")).otherwise(F.col("slug")).alias("entity_id"))
    same = F.col("slug").eqNullSafe(F.col("s")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("t").eqNullSafe(F.col("t2"))
    return kept.join(fate, same).select("slug", F.col("o").alias("row_idx"), F.coalesce("entity_id", "slug").alias("entity_id"))


def metadata_by_key(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, members): members of all rows of a key, later rows winning; a dictionary merge.

    Each member is folded by itself on the map side, so a key of any number of
    rows gathers no more than its distinct member names.
    """
    parsed = rows.select(key, F.col(order).alias("o"), F.explode_outer(metadata.parse(F.col(text))).alias("name", "value"))
    last = parsed.groupBy(key, "name").agg(F.max(F.struct("o", "value"))["value"].alias("value"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("members"))


def lag_conflict(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Whether each row conflicts with the row of the same key before it; null for the first.

    Split by range of key and order, so that a key of very many rows spreads:
    the first row of a part looks back at the last row of the part before.
    """
    parts = cut_lineage(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    inner = W.partitionBy(key, "_part").orderBy(order)
    last = parts.groupBy(key, "_part").agg(F.max_by(F.struct(F.col(text).alias("v")), order).alias("_last"))
    earlier = last.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.lag("_last").over(W.partitionBy(key).orderBy("_part")).alias("_earlier"))
    marked = parts.withColumns({"_first": F.row_number().over(inner) == 1, "_own": F.lag(text).over(inner)})
    joined = marked.join(earlier, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    before = F.when(F.col("_first"), F.col("_earlier.v")).otherwise(F.col("_own"))
    return joined.withColumn("conflicts", F.when(before.isNotNull(), metadata.conflict(metadata.parse(before), metadata.parse(F.col(text))))).select(*rows.columns, "conflicts")


def provider_ids_of(entities: DataFrame, mapping: DataFrame, provider: str, as_of: Column) -> DataFrame:
    """(entity_id, provider_entity_id): the reverse of ``resolve``, from entities to the ids a provider knows them by."""
    held = mapping.where((F.col("provider") == provider) & active_strict("active_to", as_of))
    return entities.select("entity_id").distinct().join(held.select("entity_id", "provider_entity_id").distinct(), "entity_id")


def filers_of(entities: DataFrame, mapping: DataFrame, provider: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(filers, unmatched): the set of filer ids of the entities, and the entities without one."""
    found = provider_ids_of(entities, mapping, provider, as_of)
    unmatched = entities.select("entity_id").distinct().join(found, "entity_id", "left_anti")
    return found.select(F.col("provider_entity_id").alias("cik")).distinct(), unmatched


def first_aliases(mapping: DataFrame, order: str) -> DataFrame:
    """The mapping without second aliases: of several ids of a provider for one entity with the same start the first holds.

    Rows without a start are no aliases of one another.
    """
    dated = mapping.where(F.col("active_from").isNotNull())
    first = dated.groupBy("provider", "entity_id", "active_from").agg(F.min_by(F.struct(*[c for c in mapping.columns if c not in ("provider", "entity_id", "active_from")]), order).alias("_m"))
    kept = first.select("provider", "entity_id", "active_from", "_m.*").select(mapping.columns)
    return kept.unionByName(mapping.where(F.col("active_from").isNull()))


def with_parent(regions: DataFrame, code: str, parent_code: str) -> DataFrame:
    """Regions with ``parent_region_id``: the region whose provider code is their parent code; of several the least id."""
    codes = regions.where(F.col(code).isNotNull()).groupBy("provider", F.col(code).alias("_code")).agg(F.min("region_id").alias("parent_region_id"))
    codes = codes.withColumnRenamed("provider", "_provider")
    return regions.join(codes, (F.col("provider") == F.col("_provider")) & (F.col(parent_code) == F.col("_code")), "left").drop("_provider", "_code")


def ordered_distinct(rows: DataFrame, key: str, value: Column, first: Column) -> DataFrame:
    """(key, values): each value of a key once, in order of its first appearance."""
    seen = rows.groupBy(key, value.alias("_v")).agg(F.min(first).alias("_f"))
    return seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_v"))), lambda x: x["_v"]).alias("values"))
