"""Planning of time ranges: clipping, gaps, chunks and common windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silverbarn.operators.upsert import keep_last
from silverbarn.session import cut_lineage


def clip(requests: DataFrame, lifecycles: DataFrame, key: str) -> DataFrame:
    """Requests (key, start, end) cut to the lifecycle (key, first, last); those outside it go, those without one stay."""
    joined = requests.join(lifecycles, key, "left")
    cut = joined.select(key, F.greatest("start", "first").alias("start"), F.least("end", "last").alias("end"))
    return cut.where(F.col("start") <= F.col("end"))


def chunks(requests: DataFrame, key: str, days: int) -> DataFrame:
    """Windows of ``days`` days, ends inclusive, the next starting the day after; the last may be shorter."""
    starts = F.explode(F.sequence("start", "end", F.expr(f"interval {int(days)} days")))
    return requests.select(key, "end", starts.alias("chunk_start")).select(key, "chunk_start", F.least(F.date_add("chunk_start", days - 1), "end").alias("chunk_end"))


def gaps(requests: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Parts (key, gap_start, gap_end) of the requests that no covered span (key, from_day, to_day) holds, ends inclusive."""
    inside = covered.join(requests, key).where((F.col("to_day") >= F.col("start")) & (F.col("from_day") <= F.col("end")))
    spans = inside.select(key, "start", "end", "from_day", "to_day").distinct()
    order = W.partitionBy(key, "start", "end").orderBy("from_day", "to_day")
    reach = F.max("to_day").over(order.rowsBetween(W.unboundedPreceding, -1))
    before = spans.select(key, F.coalesce(F.date_add(reach, 1), "start").alias("gap_start"), F.date_sub("from_day", 1).alias("gap_end"))
    last = spans.groupBy(key, "start", "end").agg(F.max("to_day").alias("m"))
    after = requests.join(last, [key, "start", "end"], "left").select(key, F.coalesce(F.date_add("m", 1), "start").alias("gap_start"), F.col("end").alias("gap_end"))
    return before.unionByName(after).where(F.col("gap_start") <= F.col("gap_end")).distinct()


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_n``: the place of every row within its group, from 0, in key order.

    Rows are split by range first and numbered within a part; what comes before
    a part is added. So a group of any size spreads over as many tasks as it
    needs.
    """
    parts = cut_lineage(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c")).select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_part").alias("_o_part"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inner = parts.withColumn("_n", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order)) - 1)
    same = F.col("_part") == F.col("_o_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return inner.join(offsets, same).withColumn("_n", F.col("_n") + F.col("_offset")).select(*rows.columns, "_n")


def window_groups(windows: DataFrame, key: str, size: int) -> DataFrame:
    """Keys with the same window in calls of at most ``size`` keys, in key order."""
    by = ["chunk_start", "chunk_end"]
    calls = numbered(windows.select(*by, key).distinct(), by, [key]).withColumn("call", F.floor(F.col("_n") / size).cast("int"))
    return calls.groupBy(*by, "call").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def planned_calls(requests: DataFrame, lifecycles: DataFrame, covered: DataFrame, key: str, days: int, size: int) -> DataFrame:
    """The calls that fetch what is missing: requests cut to the lifecycle, less what is covered, in windows of ``days`` days,
    keys of one window together in calls of ``size`` keys."""
    missing = gaps(clip(requests, lifecycles, key), covered, key).select(key, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    return window_groups(chunks(missing, key, days), key, size)


def combined(stored: DataFrame, fetched: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """What is stored with what the calls brought, later calls winning; columns by name, missing ones null."""
    parts = [p.withColumn("_call", F.lit(i)) for i, p in enumerate([stored, *fetched])]
    return keep_last(union_sources(parts), key, F.col("_call")).drop("_call")


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All sources by column name, missing columns null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
