"""Writes as whole-table transformations: upserts, guards, resets and audits.

Parquet has no MERGE, so a write is the next version of the table: a union or
join on the key that any table format's MERGE can replace. Nothing here reads
and overwrites one path in one plan; ``catalog`` switches versions.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbarn.functions.text import fingerprint


def keep_last(rows: DataFrame, key: Sequence[str], sequence: Column) -> DataFrame:
    """One row per key, the one with the greatest ``sequence``; null keys are keys.

    Folded as one partial and final aggregate, so a hot key shrinks before the
    shuffle. Ties fall to the greater remaining columns, in column order.
    """
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(sequence.alias("_seq"), *rest)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(rows.columns)


def keep_first(rows: DataFrame, key: Sequence[str], sequence: Column) -> DataFrame:
    """One row per key, the one with the least ``sequence``."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min(F.struct(sequence.alias("_seq"), *rest)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(rows.columns)


def _same(key: Sequence[str], other: str) -> Column:
    """Null-safe equality of a key with its renamed twin: null keys are keys."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return out


def _keys(rows: DataFrame, key: Sequence[str], prefix: str = "_of_new_") -> DataFrame:
    return rows.select(*[F.col(k).alias(f"{prefix}{k}") for k in key]).distinct()


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], sequence: str | None = None) -> DataFrame:
    """Existing rows replaced or joined by incoming ones; of several incoming rows of a key the last by ``sequence``. Null keys are keys."""
    new = incoming if sequence is None else keep_last(incoming, key, F.col(sequence))
    kept = existing.join(_keys(new, key), _same(key, "_of_new_"), "left_anti")
    return kept.select(existing.columns).unionByName(new.select(existing.columns))


def upsert_keep_old(existing: DataFrame, incoming: DataFrame, key: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Upsert in which the columns ``keep`` hold their old value where the new one is null. Null keys are keys."""
    new = incoming.select(*[F.col(c).alias(f"_of_new_{c}") for c in existing.columns], F.lit(True).alias("_of_new_arrived"))
    arrived = F.col("_of_new_arrived").isNotNull()
    fresh = lambda c: F.col(f"_of_new_{c}")
    pick = lambda c: F.coalesce(fresh(c), F.col(c)) if c in key or c in keep else F.when(arrived, fresh(c)).otherwise(F.col(c))
    return existing.join(new, _same(key, "_of_new_"), "full").select(*[pick(c).alias(c) for c in existing.columns])


def touched(existing: DataFrame, incoming: DataFrame, key: Sequence[str], column: str, now: Column) -> DataFrame:
    """Incoming rows with ``column`` set to ``now`` where their key exists already: an update touches the row, an insert does not."""
    known = _keys(existing, key, "_of_old_").withColumn("_of_old_there", F.lit(True))
    rows = incoming.join(known, _same(key, "_of_old_"), "left")
    return rows.withColumn(column, F.when(F.col("_of_old_there"), now).otherwise(F.col(column))).select(incoming.columns)


def insert_if_absent(rows: DataFrame, key: Sequence[str], sequence: Column, attributes: Sequence[str]) -> DataFrame:
    """One row per key with, for each attribute, its last value that is not null."""
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col(a).isNotNull(), F.struct(sequence.alias("s"), F.col(a).alias("v"))))["v"].alias(a) for a in attributes])


def strict_insert(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): incoming rows whose key is new, and those whose key exists."""
    return incoming.join(existing.select(*key).distinct(), list(key), "left_anti"), incoming.join(existing.select(*key).distinct(), list(key), "left_semi")


def with_surrogate(rows: DataFrame, natural: Sequence[str], name: str) -> DataFrame:
    """Distinct natural keys with a surrogate of 256 bits that depends on nothing else, the same on every run."""
    return rows.select(*natural).dropna(how="all").distinct().withColumn(name, fingerprint(*[F.col(c) for c in natural]))


def new_only(incoming: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not known: unprocessed filings, new file names, missing venues."""
    return incoming.join(known.select(*key).distinct(), list(key), "left_anti")


def known_only(incoming: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is known."""
    return incoming.join(known.select(*key).distinct(), list(key), "left_semi")


def append_unprocessed(facts: DataFrame, markers: DataFrame, key: Sequence[str], file_order: str) -> DataFrame:
    """Facts of keys without a marker, and of each such key those of its first file only."""
    fresh = new_only(facts, markers, key)
    first = fresh.groupBy(*key).agg(F.min(file_order).alias("_first"))
    return fresh.join(first, list(key)).where(F.col(file_order) == F.col("_first")).drop("_first")


def reset(table: DataFrame, scope: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table without the rows of the scope."""
    return table.join(scope.select(*key).distinct(), list(key), "left_anti")


def reject_unreferenced(rows: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether the key stands in the dimension."""
    known = dimension.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def audit(runs: DataFrame, keys: Sequence[str], failed: Column) -> DataFrame:
    """Per run: rows updated and failed, and status success, partial or failed."""
    bad = F.count_if(failed)
    n = F.count(F.lit(1))
    return runs.groupBy(*keys).agg((n - bad).alias("updated"), bad.alias("failed")).withColumn(
        "status", F.when(F.col("failed") == 0, "success").when(F.col("updated") > 0, "partial").otherwise("failed")
    )


def started_run(provider: str, at: str, spark: SparkSession, run_id: str | None = None) -> DataFrame:
    """The audit row of a run that has begun, under a new random id unless one is given."""
    run_id = run_id or uuid4().hex
    row = [(run_id, provider, at, None, "running", None, None, None, None)]
    return spark.createDataFrame(row, RUN).withColumn("started_at", F.to_timestamp("started_at"))


#: Columns of the audit of runs.
RUN = "run_id string, provider string, started_at string, finished_at timestamp, status string, updated bigint, failed bigint, etag string, notes string"


def finished_run(run: DataFrame, outcome: DataFrame, at: Column, etag: str | None = None, notes: str | None = None) -> DataFrame:
    """The row of a run with the counts and status of its ``outcome`` (run_id, updated, failed, status), its end, etag and notes."""
    done = outcome.select(F.col("run_id").alias("_run"), *[F.col(c).alias(f"_{c}") for c in ("updated", "failed", "status")])
    new = {"finished_at": at, "status": F.col("_status"), "updated": F.col("_updated"), "failed": F.col("_failed"), "etag": F.lit(etag).cast("string"), "notes": F.lit(notes).cast("string")}
    return run.join(done, F.col("run_id") == F.col("_run")).withColumns(new).select(run.columns)


def evolve(table: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The table in the columns of ``schema`` (name to type): missing ones null, others dropped, order kept."""
    return table.select(*[(F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
