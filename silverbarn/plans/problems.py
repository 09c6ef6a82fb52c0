"""Queries of the general data problems over their whole tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silverbarn.operators import history, nested, outliers
from silverbarn.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.mapping_history(table(spark, sf_dir, "provider_entity_map"), table(spark, sf_dir, "region_provider_map"))


def p3_region_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region history from two loads, the second appending to the satellites of the first."""
    return history.region_history_in_batches(table(spark, sf_dir, "region_provider_map"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_tables(table(spark, sf_dir, "edgar_submissions"), table(spark, sf_dir, "accession_index"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.implausible(table(spark, sf_dir, "candles_raw"))


QUERIES = {f.__name__: f for f in (p3_found, p3_region_batches, p4_found, p5_found)}

_P3 = r"""
WITH parsed AS (
  SELECT provider, provider_entity_id AS k, entity_id AS v, recorded_at,
    coalesce(try_cast(nullif(regexp_replace(coalesce(active_from, ''), '^\s*(\d{4})[-/. ]?(\d{2})[-/. ]?(\d{2}).*$', '\1-\2-\3'), '') AS date), date '0001-01-01') AS f,
    coalesce(try_cast(nullif(regexp_replace(coalesce(active_to, ''), '^\s*(\d{4})[-/. ]?(\d{2})[-/. ]?(\d{2}).*$', '\1-\2-\3'), '') AS date), date '9999-12-31') AS t
  FROM provider_entity_map
), spans AS (SELECT DISTINCT * FROM parsed WHERE f < t),
cuts AS (SELECT provider, k, f AS d FROM spans UNION SELECT provider, k, t FROM spans),
held AS (
  SELECT c.provider, c.k, c.d, arg_max(s.v, (s.recorded_at, s.v)) AS v
  FROM cuts c LEFT JOIN spans s ON s.provider = c.provider AND s.k = c.k AND s.f <= c.d AND c.d < s.t GROUP BY ALL
), firsts AS (
  SELECT provider, k, d, v FROM (SELECT *, row_number() OVER w AS i, lag(v) OVER w AS p FROM held WINDOW w AS (PARTITION BY provider, k ORDER BY d))
  WHERE i = 1 OR v IS DISTINCT FROM p
), ended AS (SELECT *, lead(d) OVER (PARTITION BY provider, k ORDER BY d) AS e FROM firsts),
snaps AS (
  SELECT DISTINCT provider, provider_region_id AS k, region_id AS v,
    trim(regexp_replace(lower(coalesce(provider_name, '')), '\s+', ' ', 'g')) AS n, data_revision AS r FROM region_provider_map
), revs AS (
  SELECT provider, r, row_number() OVER w AS i, lead(r) OVER w AS nxt FROM (SELECT DISTINCT provider, r FROM snaps) WINDOW w AS (PARTITION BY provider ORDER BY r)
), runs AS (
  SELECT s.provider, s.k, s.v, s.n, s.r, v2.i, v2.nxt, v2.i - row_number() OVER (PARTITION BY s.provider, s.k, s.v, s.n ORDER BY v2.i) AS g
  FROM snaps s JOIN revs v2 ON v2.provider = s.provider AND v2.r = s.r
), regions AS (
  SELECT provider, k, v, min(r) AS a, arg_max(coalesce(nxt, -1), i) AS b FROM runs GROUP BY provider, k, v, n, g
)
SELECT DISTINCT 'provider_entity_map' AS source_table, provider, k AS provider_key, v AS mapped_id,
  CASE WHEN d = date '0001-01-01' THEN '' ELSE strftime(d, '%Y-%m-%d') END AS valid_from,
  CASE WHEN e = date '9999-12-31' OR e IS NULL THEN '' ELSE strftime(e, '%Y-%m-%d') END AS valid_to
FROM ended WHERE v IS NOT NULL
UNION
SELECT DISTINCT 'region_provider_map', provider, k, v, strftime(to_timestamp(a) AT TIME ZONE 'UTC', '%Y-%m-%d'),
  CASE WHEN b < 0 THEN '' ELSE strftime(to_timestamp(b) AT TIME ZONE 'UTC', '%Y-%m-%d') END FROM regions
"""

_P3_REGIONS = "WITH snaps AS (" + _P3.split("snaps AS (")[1].split("SELECT DISTINCT 'provider_entity_map'")[0] + """
SELECT DISTINCT provider, k AS provider_region_id, v AS region_id, strftime(to_timestamp(a) AT TIME ZONE 'UTC', '%Y-%m-%d') AS valid_from,
  CASE WHEN b < 0 THEN '' ELSE strftime(to_timestamp(b) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS valid_to FROM regions
"""

_P4 = r"""
WITH readable AS (
  SELECT cik, epoch_us(fetched_at) AS us, sha256(payload) AS h,
    CASE WHEN NOT json_valid(payload) THEN NULL WHEN json_type(payload) = 'OBJECT' THEN cast(payload AS json)
      WHEN json_type(payload) = 'VARCHAR' AND json_valid(json_extract_string(payload, '$')) AND json_type(json_extract_string(payload, '$')) = 'OBJECT'
        THEN cast(json_extract_string(payload, '$') AS json) END AS o
  FROM edgar_submissions WHERE cik IS NOT NULL
), latest AS (
  SELECT cik, arg_max(o, row(coalesce(us, -9223372036854775807), h)) AS o FROM readable WHERE o IS NOT NULL GROUP BY cik
), members(kind, path, key) AS (VALUES ('ticker', '$.tickers', ''), ('former_name', '$.formerNames', '$.name'), ('page', '$.filings.files', '$.name')),
lists AS (
  SELECT cik, kind, key, json_extract(o, path) AS v FROM latest, members
), items AS (
  SELECT cik, kind, key, CASE json_type(v) WHEN 'ARRAY' THEN cast(v AS json[]) ELSE [v] END AS l FROM lists WHERE v IS NOT NULL
), children AS (
  SELECT cik, kind, key, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM items
), named AS (
  SELECT kind, cik, pos, CASE WHEN key = '' THEN json_extract_string(x, '$') WHEN json_type(json_extract(x, key)) = 'VARCHAR' THEN json_extract_string(x, key) END AS child_key
  FROM children WHERE key <> '' OR json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL')
), recent AS (
  SELECT cik, json_extract(o, '$.filings.recent') AS r FROM latest
), columns_ AS (
  SELECT cik, [CASE json_type(v) WHEN 'ARRAY' THEN cast(v AS json[]) ELSE [v] END FOR v IN [json_extract(r, '$.accessionNumber'), json_extract(r, '$.form'), json_extract(r, '$.filingDate')]] AS c
  FROM recent WHERE json_type(r) = 'OBJECT' AND json_exists(r, '$.accessionNumber') AND json_exists(r, '$.form') AND json_exists(r, '$.filingDate')
), placed AS (
  SELECT cik, unnest(c[1][: least(len(c[1]), len(c[2]), len(c[3]))]) AS a, generate_subscripts(c[1][: least(len(c[1]), len(c[2]), len(c[3]))], 1) - 1 AS pos FROM columns_
  UNION ALL
  SELECT cik, json_extract(x, '$.accessionNumber'), pos FROM (SELECT cik, unnest(cast(r AS json[])) AS x, generate_subscripts(cast(r AS json[]), 1) - 1 AS pos FROM recent WHERE json_type(r) = 'ARRAY')
  WHERE json_exists(x, '$.accessionNumber') AND json_exists(x, '$.form') AND json_exists(x, '$.filingDate')
), filings AS (
  SELECT 'filing' AS kind, cik, min(pos) AS pos, replace(json_extract_string(a, '$'), '-', '') AS child_key
  FROM placed WHERE coalesce(json_extract_string(a, '$'), '') <> '' GROUP BY cik, replace(json_extract_string(a, '$'), '-', '')
), indexed AS (
  SELECT replace(accession, '-', '') AS accession, unnest(files) AS f, generate_subscripts(files, 1) - 1 AS pos FROM accession_index WHERE accession IS NOT NULL
), archived AS (
  SELECT accession || '/' || f.name AS parent, unnest(f.members) AS m, generate_subscripts(f.members, 1) - 1 AS pos FROM indexed WHERE f.name IS NOT NULL
)
SELECT DISTINCT kind, cik AS parent_key, pos, child_key FROM named WHERE child_key IS NOT NULL
UNION ALL SELECT kind, cik, pos, child_key FROM filings
UNION SELECT 'file', accession, pos, f.name FROM indexed WHERE f.name IS NOT NULL
UNION SELECT 'member', parent, pos, m.name FROM archived WHERE m.name IS NOT NULL
"""

ORACLE = {"p3_found": _P3, "p3_region_batches": _P3_REGIONS, "p4_found": _P4}
