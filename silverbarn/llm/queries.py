"""Queries of the text problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silverbarn.llm import leakage, names, packing, sentences, survivor
from silverbarn.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    return names.party_pairs(names.name_records(read("entities"), read("sec_rows"), read("edgar_submissions")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared order of trust, which the statement of problem 2 fixes; see the README on the model."""
    return survivor.survivors(table(spark, sf_dir, "candles_raw"), table(spark, sf_dir, "provider_priority"))


def p2_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of close, adj_close and volume judged true by the two-sided source quality model."""
    return survivor.truth_model(table(spark, sf_dir, "candles_raw"))[0]


def p2_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.truth_model(table(spark, sf_dir, "candles_raw"))[1]


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_truth, p2_source_quality, p6_packing, p7_found, p8_found)}

_P2 = """
WITH rule AS (
  SELECT provider_id, instrument_type, min(coalesce(priority, 999)) AS p FROM provider_priority GROUP BY ALL
), ruled AS (
  SELECT r.provider_id, r.instrument_type, r.p, max(coalesce(q.staleness_days, 36500)) AS s
  FROM rule r JOIN provider_priority q ON q.provider_id = r.provider_id
    AND q.instrument_type IS NOT DISTINCT FROM r.instrument_type AND coalesce(q.priority, 999) = r.p
  GROUP BY ALL
), bars AS (
  SELECT c.*, CASE split_part(canonical_id, ':', 1) WHEN 'sec' THEN 'security' WHEN 'fx' THEN 'currency_pair'
    ELSE split_part(canonical_id, ':', 1) END AS kind FROM candles_raw c
), trusted AS (
  SELECT b.*, coalesce(t.p, d.p, 999) AS prio,
    CASE WHEN date '2026-07-01' - b.start_ts > coalesce(t.s, d.s, 36500) THEN 1 ELSE 0 END AS stale
  FROM bars b
  LEFT JOIN ruled t ON t.provider_id = b.provider_id AND t.instrument_type = b.kind
  LEFT JOIN ruled d ON d.provider_id = b.provider_id AND d.instrument_type IS NULL
), ranked AS (
  SELECT canonical_id, start_ts, bar_id, close, adj_close, volume,
    row_number() OVER (PARTITION BY canonical_id, start_ts
      ORDER BY prio, stale, ingested_at DESC NULLS LAST, provider_id, bar_id) AS r
  FROM trusted
)
SELECT canonical_id, strftime(start_ts, '%Y-%m-%d') AS bar_date,
  coalesce(arg_min(bar_id, r) FILTER (close IS NOT NULL), 0) AS close_bar_id,
  coalesce(arg_min(bar_id, r) FILTER (adj_close IS NOT NULL), 0) AS adj_close_bar_id,
  coalesce(arg_min(bar_id, r) FILTER (volume IS NOT NULL), 0) AS volume_bar_id
FROM ranked GROUP BY canonical_id, start_ts HAVING count(*) >= 2
"""

#: The others are not expressible in SQL over whole texts; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {"p2_found": _P2}
