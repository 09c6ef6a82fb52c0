"""Queries of the engine's own operators over whole test tables, each with its SQL.

The test tables stand in for the engine's tables: events for provider bars,
lineitem/part/orders/supplier for the fact star, orders for daily values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silverbarn.functions import blobs, classify, markdown, metadata, periods, regions, static, text
from silverbarn.operators import best, entities, facts, listings, nested, ranges, upsert
from silverbarn.session import table
from silverbarn.sources import archives, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Read = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table reader as a query, with its SQL."""

    def add(f: Callable[[Read], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def concat(*cs: Column | str) -> Column:
    return F.concat(*cs)


# --- best provider -----------------------------------------------------------

_PRIORITIES = [("click", 10, 7), ("view", 10, 20), ("purchase", 5, 3), ("signup", 20, None)]
_BEST = """
WITH bars AS (
  SELECT user_id, cast(ts AS date) AS day, event_type AS provider, arg_max(value, row(ts, event_id)) AS close
  FROM events GROUP BY ALL
), d(provider, priority, staleness_days) AS (VALUES ('click', 10, 7), ('view', 10, 20), ('purchase', 5, 3), ('signup', 20, NULL)),
o AS (SELECT DISTINCT user_id, 'error' AS provider, 1 AS priority, 10 AS staleness_days FROM events WHERE user_id % 10 = 0),
r AS (
  SELECT b.*, coalesce(o.priority, d.priority, 999) AS prio, coalesce(o.staleness_days, d.staleness_days, 36500) AS stale_days,
    date '2024-01-31' - b.day AS age_days
  FROM bars b LEFT JOIN d USING (provider) LEFT JOIN o ON o.user_id = b.user_id AND o.provider = b.provider
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day
    ORDER BY prio, CASE WHEN age_days <= stale_days THEN 0 ELSE 1 END, provider) AS rn FROM r) WHERE rn = 1
)
"""


def _event_bars(read: Read) -> DataFrame:
    bars = read("events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), "ts", "event_id", F.col("value").alias("close"))
    return upsert.keep_last(bars, ["user_id", "day", "provider"], F.struct("ts", "event_id")).drop("ts", "event_id")


def _best(read: Read) -> DataFrame:
    bars = _event_bars(read)
    spark = bars.sparkSession
    defaults = spark.createDataFrame(_PRIORITIES, "provider string, priority int, staleness_days int")
    over = read("events").where("user_id % 10 = 0").select("user_id", F.lit("error").alias("provider"), F.lit(1).alias("priority"), F.lit(10).alias("staleness_days")).distinct()
    return best.best_provider(bars, defaults, over, "2024-01-31", ("user_id", "day"))


@query(_BEST + "SELECT user_id, day, provider, close, prio, stale_days, age_days FROM best")
def best_provider_bars(read: Read) -> DataFrame:
    return _best(read).select("user_id", "day", "provider", "close", "prio", "stale_days", "age_days")


@query(_BEST + "SELECT day AS start_ts, provider, close, close AS adj_close FROM best WHERE user_id = 20 AND day BETWEEN date '2024-01-05' AND date '2024-01-20'")
def bars_range_projection(read: Read) -> DataFrame:
    rows = best.between(_best(read).where("user_id = 20"), "day", "2024-01-05", "2024-01-20")
    rows = rows.select(F.col("day").alias("start_ts"), "provider", "close", F.col("close").alias("adj_close"))
    return best.projected(rows, [" Close", "close", "adj_close"]).orderBy(F.desc("start_ts"))


@query("SELECT user_id, max(cast(ts AS date)) AS day FROM events GROUP BY 1")
def latest_bar_date(read: Read) -> DataFrame:
    return best.latest(read("events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day")


# --- periods -----------------------------------------------------------------

_LABELS = {"week": "strftime(d, '%G-W%V')", "month": "strftime(d, '%Y-%m')", "year": "strftime(d, '%Y')"}
_ENDS = {"week": "cast(date_trunc('week', d) AS date) + 6", "month": "last_day(d)", "year": "make_date(year(d), 12, 31)"}


def _period_query(period: str, method: str) -> None:
    stat = {"avg": "cast(sum(cast(x AS decimal(18,2))) AS double) / count(x)", "median": "median(x)"}[method]
    sql = f"""SELECT {_LABELS[period]} AS period, cast(date_trunc('{period}', d) AS date) AS period_start, cast({_ENDS[period]} AS date) AS period_end,
      {stat} AS value, count(*) AS n FROM (SELECT cast(o_orderdate AS date) AS d, o_totalprice AS x FROM orders) GROUP BY 1, 2, 3"""

    def run(read: Read) -> DataFrame:
        return periods.per_period(read("orders"), "o_orderdate", "o_totalprice", period, method)

    run.__name__ = f"period_{method}_{period}"
    query(sql)(run)


for _p in periods.PERIODS:
    for _m in ("avg", "median"):
        _period_query(_p, _m)

# --- fact star ---------------------------------------------------------------

_STAR = """
WITH facts AS (
  SELECT l_orderkey AS accession, l_partkey AS concept_id, l_orderkey AS context_id, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END AS unit_id,
    l_extendedprice AS value, l_linenumber AS line,
    concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity AS integer), cast(l_extendedprice * 100 AS bigint), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d')) AS fact_id
  FROM lineitem
), concepts AS (SELECT p_partkey AS concept_id, p_brand AS qname, p_type AS local_name FROM part),
contexts AS (
  SELECT o_orderkey AS context_id, CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) END AS end_date,
    CASE WHEN o_orderstatus = 'O' THEN cast(o_orderdate AS date) END AS instant_date,
    CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 2 = 0 THEN cast(o_orderdate AS date) END AS start_date,
    CASE WHEN o_orderstatus = 'O' THEN 'instant' ELSE 'duration' END AS period_type FROM orders
), units AS (SELECT s_suppkey AS unit_id, s_name AS measure FROM supplier),
filings AS (SELECT o_orderkey AS accession, o_custkey AS cik FROM orders)
"""


def _star(read: Read) -> dict[str, DataFrame]:
    li, o = read("lineitem"), read("orders")
    day, st = F.to_date("o_orderdate"), F.col("o_orderstatus")
    fid = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("bigint"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"))
    return {
        "facts": li.select(F.col("l_orderkey").alias("accession"), F.col("l_partkey").alias("concept_id"), F.col("l_orderkey").alias("context_id"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("unit_id"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("line"), fid.alias("fact_id")),
        "concepts": read("part").select(F.col("p_partkey").alias("concept_id"), F.col("p_brand").alias("qname"), F.col("p_type").alias("local_name")),
        "contexts": o.select(F.col("o_orderkey").alias("context_id"), F.when(st == "F", day).alias("end_date"), F.when(st == "O", day).alias("instant_date"), F.when((st != "P") | (F.col("o_orderkey") % 2 == 0), day).alias("start_date"), F.when(st == "O", "instant").otherwise("duration").alias("period_type")),
        "units": read("supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("measure")),
        "filings": o.select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik")),
    }


@query(_STAR + """SELECT f.accession, f.fact_id, c.qname, x.period_type, x.end_date, u.measure, f.value FROM facts f JOIN concepts c USING (concept_id)
  LEFT JOIN contexts x USING (context_id) LEFT JOIN units u USING (unit_id)""")
def fact_view(read: Read) -> DataFrame:
    s = _star(read)
    return facts.fact_view(s["facts"], s["concepts"], s["contexts"], s["units"]).select("accession", "fact_id", "qname", "period_type", "end_date", "measure", "value")


@query(_STAR + """SELECT f.accession, f.fact_id, c.qname, u.measure, f.value, coalesce(x.end_date, x.instant_date, x.start_date) AS as_of
  FROM facts f JOIN concepts c USING (concept_id) JOIN contexts x USING (context_id) LEFT JOIN units u USING (unit_id)
  WHERE f.accession IN (SELECT accession FROM filings JOIN customer ON cik = c_custkey WHERE c_mktsegment = 'MACHINERY')
    AND c.qname IN ('Brand#2', 'Brand#17')
    AND coalesce(x.end_date, x.instant_date, x.start_date) >= date '1997-01-01' AND coalesce(x.end_date, x.instant_date, x.start_date) <= date '2000-12-31'
  ORDER BY as_of DESC NULLS LAST, f.accession DESC, f.fact_id DESC LIMIT 100""")
def fact_history_topn(read: Read) -> DataFrame:
    s = _star(read)
    cust = read("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("cik"))
    filings = s["filings"].join(cust, "cik", "left_semi")
    rows = facts.fact_history(s["facts"], s["concepts"], s["contexts"], s["units"], filings, ["Brand#2", "Brand#17"], start="1997-01-01", end="2000-12-31")
    return rows.select("accession", "fact_id", "qname", "measure", "value", "as_of")


@query(_STAR + """SELECT f.fact_id, f.accession, f.value, x.period_type FROM facts f JOIN contexts x USING (context_id) JOIN concepts USING (concept_id)
  WHERE x.period_type = 'instant' AND f.accession IN (SELECT accession FROM filings)""")
def fact_history_instant(read: Read) -> DataFrame:
    s = _star(read)
    return facts.fact_history(s["facts"], s["concepts"], s["contexts"], s["units"], s["filings"], period_type="instant", limit=None).select("fact_id", "accession", "value", "period_type")


@query(_STAR + """SELECT g.cik, c.local_name AS concept, string_agg(DISTINCT c.qname, ',' ORDER BY c.qname) AS qnames
  FROM facts f JOIN filings g USING (accession) JOIN concepts c USING (concept_id) GROUP BY 1, 2""")
def concept_registry(read: Read) -> DataFrame:
    s = _star(read)
    return facts.concept_registry(s["facts"], s["filings"], s["concepts"], by="local_name").withColumn("qnames", F.array_join("qnames", ","))


_FRIENDLY = {"Brand#2": "two", "Brand#3": "three"}


@query(_STAR + """SELECT cik, string_agg(concept || '=' || qnames, ';' ORDER BY concept) AS concepts FROM (
  SELECT g.cik, CASE c.qname WHEN 'Brand#2' THEN 'two' ELSE 'three' END AS concept, string_agg(DISTINCT c.qname, ',' ORDER BY c.qname) AS qnames
  FROM facts f JOIN filings g USING (accession) JOIN concepts c USING (concept_id) WHERE c.qname IN ('Brand#2', 'Brand#3') GROUP BY 1, 2) GROUP BY 1""")
def registry_dump(read: Read) -> DataFrame:
    s = _star(read)
    reg = facts.registry_json(facts.concept_registry(s["facts"], s["filings"], s["concepts"], _FRIENDLY))
    parsed = F.map_entries(F.from_json("concepts", "map<string,array<string>>"))
    return reg.select("cik", F.array_join(F.transform(parsed, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("concepts"))


@query(_STAR + "SELECT DISTINCT accession, cik FROM filings WHERE accession IN (SELECT accession FROM facts)")
def accession_to_cik(read: Read) -> DataFrame:
    s = _star(read)
    return upsert.known_only(s["filings"], s["facts"], ["accession"]).distinct()


# --- writes ------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2")
def upsert_keep_last(read: Read) -> DataFrame:
    e = read("events").select("user_id", "event_type", "ts", "event_id", "value")
    seq = F.struct("ts", "event_id")
    old = upsert.keep_last(e.where("event_id % 2 = 0"), ["user_id", "event_type"], seq)
    new = upsert.keep_last(e, ["user_id", "event_type"], seq)
    return upsert.upsert(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")



@query("""SELECT user_id, arg_max(value, event_id) FILTER (value IS NOT NULL AND event_type = 'purchase') AS purchase, arg_max(props, event_id) AS props FROM events GROUP BY 1""")
def insert_if_absent(read: Read) -> DataFrame:
    rows = read("events").withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return upsert.insert_if_absent(rows, ["user_id"], F.col("event_id"), ["purchase", "props"])



_LOADS = """WITH a AS (SELECT user_id, cast(ts AS date) AS day, max(value) AS value, min(event_id) AS first_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
b AS (SELECT user_id, cast(ts AS date) AS day, CASE WHEN user_id % 3 <> 0 THEN max(value) END AS value, min(event_id) AS first_id FROM events WHERE event_type IS DISTINCT FROM 'purchase' GROUP BY 1, 2)
"""


def _loads(read: Read) -> tuple[DataFrame, DataFrame]:
    """Per user and day, the purchases as the old load and all other events as the new one; together every event."""
    e = read("events").withColumn("day", F.to_date("ts"))
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    a = e.where(bought).groupBy("user_id", "day").agg(F.max("value").alias("value"), F.min("event_id").alias("first_id"))
    b = e.where(~bought).groupBy("user_id", "day").agg(F.when(F.col("user_id") % 3 != 0, F.max("value")).alias("value"), F.min("event_id").alias("first_id"))
    return a, b


@query(_LOADS + """SELECT user_id, day, coalesce(b.value, a.value) AS value, CASE WHEN b.user_id IS NOT NULL THEN b.first_id ELSE a.first_id END AS first_id
  FROM a FULL JOIN b USING (user_id, day)""")
def upsert_coalesce(read: Read) -> DataFrame:
    return upsert.upsert_keep_old(*_loads(read), ["user_id", "day"], ["value"])


@query(_LOADS + "SELECT user_id, day, CASE WHEN (user_id, day) IN (SELECT (user_id, day) FROM a) THEN 'rejected' ELSE 'accepted' END AS outcome FROM b")
def strict_insert(read: Read) -> DataFrame:
    yes, no = upsert.strict_insert(*_loads(read), ["user_id", "day"])
    return yes.withColumn("outcome", F.lit("accepted")).unionByName(no.withColumn("outcome", F.lit("rejected"))).select("user_id", "day", "outcome")


@query("SELECT DISTINCT p_brand, p_type, sha256(p_brand || chr(31) || p_type) AS id FROM part")
def surrogate_keys(read: Read) -> DataFrame:
    return upsert.with_surrogate(read("part"), ["p_brand", "p_type"], "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def processed_anti(read: Read) -> DataFrame:
    done = read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return upsert.new_only(read("customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def entity_exists_semi(read: Read) -> DataFrame:
    return upsert.known_only(read("part").select("p_partkey", "p_name"), read("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT accession, f.name FROM (SELECT replace(accession, '-', '') AS accession, unnest(files) AS f FROM accession_index) WHERE f.name NOT LIKE '%-01.%' GROUP BY ALL")
def new_files_anti(read: Read) -> DataFrame:
    files = read("accession_index").select(text.digits(F.col("accession")).alias("accession"), F.explode("files").alias("f")).select("accession", "f.name").distinct()
    return upsert.new_only(files, files.where(F.contains("name", F.lit("-01."))), ["accession", "name"])


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  AND l_linenumber = (SELECT min(m.l_linenumber) FROM lineitem m WHERE m.l_orderkey = lineitem.l_orderkey)""")
def append_first_file(read: Read) -> DataFrame:
    rows = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    done = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return upsert.append_unprocessed(rows, done, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def scoped_reset(read: Read) -> DataFrame:
    scope = read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return upsert.reset(read("lineitem"), scope, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AS known FROM supplier")
def referential_report(read: Read) -> DataFrame:
    dim = read("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    ok, bad = upsert.reject_unreferenced(read("supplier"), dim, "s_nationkey")
    return ok.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False))).select("s_suppkey", "known")


@query("""SELECT event_type, count(*) FILTER (value <= 90) AS updated, count(*) FILTER (value > 90) AS failed,
  CASE WHEN count(*) FILTER (value > 90) = 0 THEN 'success' WHEN count(*) FILTER (value <= 90) > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY 1""")
def run_audit(read: Read) -> DataFrame:
    return upsert.audit(read("events"), ["event_type"], F.col("value") > 90)


@query("SELECT o_orderkey AS accession, cast(NULL AS varchar) AS note, cast(o_totalprice AS varchar) IS NOT NULL AS priced FROM orders")
def schema_evolution(read: Read) -> DataFrame:
    rows = read("orders").select(F.col("o_orderkey").alias("accession"), F.col("o_totalprice").isNotNull().alias("priced"), F.lit("gone").alias("dropped"))
    return upsert.evolve(rows, {"accession": "bigint", "note": "string", "priced": "boolean"})


# --- mappings and regions ----------------------------------------------------

_SPANS = """WITH m AS (SELECT user_id, event_type, event_id AS entity, cast(ts AS date) AS active_from,
  cast(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS date) AS active_to FROM events)"""


def _spans(read: Read) -> DataFrame:
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read("events").select("user_id", "event_type", F.col("event_id").alias("entity"), F.to_date("ts").alias("active_from"), F.to_date(F.lead("ts").over(order)).alias("active_to"))


def _active_query(name: str, sign: str, rule: Callable) -> None:
    sql = _SPANS + f"""SELECT user_id, event_type, max(entity) AS entity FROM (
      SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY active_from DESC) AS r FROM m
      WHERE (active_to IS NULL OR active_to {sign} date '2024-01-15') AND active_from <= date '2024-01-15') WHERE r = 1 GROUP BY 1, 2"""

    def run(read: Read) -> DataFrame:
        keys = read("events").select("user_id", "event_type").distinct()
        held = _spans(read).where(F.col("active_from") <= F.lit("2024-01-15").cast("date")).withColumn("newest", F.struct("active_from", "entity"))
        out = entities.resolve(keys, held, ["user_id", "event_type"], rule("active_to", F.lit("2024-01-15").cast("date")), "newest", "inner")
        return out.select("user_id", "event_type", "entity")

    run.__name__ = name
    query(sql)(run)


_active_query("active_mapping_strict", ">", entities.active_strict)
_active_query("active_mapping_inclusive", ">=", entities.active_inclusive)


@query("""SELECT n.n_name, 'region:metro:us:' || lower(r.r_name[1:2]) || ':' || coalesce(nullif(trim(regexp_replace(lower(n.n_name), '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), ''), 'unknown') AS region_id,
  'region:admin1:us:' || lower(r.r_name[1:2]) AS parent_id FROM nation n JOIN region r ON n_regionkey = r_regionkey""")
def region_ids(read: Read) -> DataFrame:
    rows = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    state, us = F.substring("r_name", 1, 2), F.lit("us")
    name = F.concat("n_name", F.lit(", "), F.lower(state))
    return rows.select("n_name", regions.region_id(F.lit("Metro"), name, state, F.lit(None), us).alias("region_id"), regions.parent_id(F.lit("metro"), state, us).alias("parent_id"))


@query("SELECT 'c:' || a.c_custkey AS region_id, 'c:' || b.c_custkey AS parent_region_id FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_nationkey")
def region_parent_join(read: Read) -> DataFrame:
    rows = read("customer").select(F.lit("p").alias("provider"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("region_id"), F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("parent"))
    return entities.with_parent(rows, "code", "parent").select("region_id", "parent_region_id")


# --- text and identifiers ----------------------------------------------------



@query(r"SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM documents")
def slug_dash(read: Read) -> DataFrame:
    return read("documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug FROM part")
def slug_underscore(read: Read) -> DataFrame:
    return read("part").select("p_partkey", text.slug(F.col("p_name"), "_").alias("slug"))


_KEYED = r"""WITH w AS (SELECT entity_id, name, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') AS t
  FROM (SELECT DISTINCT entity_id, name FROM entities WHERE name IS NOT NULL)),
u AS (SELECT entity_id, name, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM w),
g AS (SELECT *, CASE WHEN length(tok) = 1 AND lag(length(tok)) OVER (PARTITION BY entity_id, name ORDER BY i) = 1 THEN 0 ELSE 1 END AS s FROM u),
h AS (SELECT *, sum(s) OVER (PARTITION BY entity_id, name ORDER BY i) AS grp FROM g),
j AS (SELECT entity_id, name, grp, string_agg(tok, '' ORDER BY i) AS tok FROM h GROUP BY ALL),
k AS (SELECT w.entity_id, w.name, coalesce((SELECT string_agg(tok, '-' ORDER BY grp) FROM j WHERE j.entity_id = w.entity_id AND j.name = w.name
  AND tok NOT IN ('company','co','corp','corporation','inc','ltd','limited','llc','plc','nv','sa','ag','gmbh','ab','spac','group','adr','hold','holding','holdings','et','expl','p','g','cl','a','pg')), '') AS key FROM w)
"""


@query(_KEYED + "SELECT entity_id, name, key FROM k")
def name_normalize(read: Read) -> DataFrame:
    rows = read("entities").where("name IS NOT NULL").select("entity_id", "name").distinct()
    return rows.select("entity_id", "name", text.name_key(F.col("name")).alias("key"))


@query(_KEYED + "SELECT key, min(entity_id) AS entity_id FROM k WHERE key <> '' GROUP BY 1")
def name_first_registered(read: Read) -> DataFrame:
    rows = read("entities").where("name IS NOT NULL").select(text.name_key(F.col("name")).alias("key"), F.col("entity_id").alias("id"), F.col("entity_id").alias("row_idx"))
    return entities.by_name(rows, "key").withColumnRenamed("id", "entity_id")


@query("""SELECT DISTINCT entity_id, name,
  len(list_intersect(t, ['CALL','PUT','TB','LG','B','OP','BONUS','CASH','BARRIER','WRAP','CW','BON','CORR','USD','EUR','TR','ETC','ETF','STW','ADX','LEG','BOOST','CDI','ORD','CLASS','SWAP','RETURN','CDS','COUPON','FLR','FIX','FLOAT','PERP','RATE','YIELD','ETN'])) > 0
  OR (len(t) <= 4 AND len(list_filter(t, lambda x: NOT regexp_full_match(x, '[A-Z0-9]*[0-9][A-Z0-9]*'))) = 0)
  OR (len(t) > 1 AND (regexp_matches(u, '[0-9]') OR NOT regexp_matches(u, '\\p{L}'))) AS product
  FROM (SELECT entity_id, name, upper(trim(name)) AS u, list_filter(regexp_split_to_array(upper(trim(name)), '[\\s/\\\\-]+'), lambda x: x <> '') AS t FROM entities WHERE name IS NOT NULL)""")
def classify_product(read: Read) -> DataFrame:
    return read("entities").where("name IS NOT NULL").select("entity_id", "name", classify.is_product_label(F.col("name")).alias("product")).distinct()


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NAMED = _KEYED + f""", c1 AS (SELECT entity_id, name, key, trim(name) AS s, upper(trim(name)) AS u FROM k),
c2 AS (SELECT *, list_filter(regexp_split_to_array(u, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t, list_filter(regexp_split_to_array(u, '[\\s/\\\\-]+'), lambda x: x <> '') AS pt,
  list_filter(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS raw FROM c1),
c3 AS (SELECT *, list_transform(raw, lambda x: upper(x)) AS ct, list_transform(raw, lambda x: lower(x)) AS lt, coalesce(t[-1], '') AS l, len(pt) > 0 AND (len(list_intersect(pt, {_list(classify.PRODUCT_WORDS)})) > 0
  OR (len(pt) <= 4 AND len(list_filter(pt, lambda x: NOT regexp_full_match(x, '[A-Z0-9]*[0-9][A-Z0-9]*'))) = 0) OR (len(pt) > 1 AND (regexp_matches(u, '\\p{{Nd}}') OR NOT regexp_matches(u, '\\p{{L}}')))) AS product FROM c2),
c4 AS (SELECT *, CASE WHEN len(t) = 0 OR l = 'ETN' THEN false WHEN l IN {_list(classify.FUND_LAST)} OR starts_with(key, 'fund') OR ends_with(key, 'qpsc') OR list_contains(t, 'QPSC') THEN true
  WHEN list_contains(t, 'COLL') AND regexp_matches(s, '\\p{{Nd}}') THEN true WHEN product THEN false ELSE regexp_matches(u, '{"|".join(classify.FUND_MARKERS)}') END AS fund, coalesce(ct[-1], '') AS cl FROM c3)
SELECT DISTINCT entity_id, name, fund, CASE WHEN s = '' OR fund OR cl = 'ETN' THEN false WHEN cl IN ('R', 'RE') AND len(list_intersect(ct, {_list(classify.COMPANY_SUFFIXES)})) > 0 THEN false
  WHEN regexp_matches(u, ' O\\.N\\.?$|PRE-ROLL|PREROLL') THEN false WHEN cl IN ('NA', 'NAM') AND len(list_intersect(ct, ['ASA', 'AG'])) > 0 THEN false
  WHEN lower(cl) NOT IN {_list(classify.FINAL_FORMS)} AND (len(list_filter(lt, lambda x: list_contains({_list(classify.VEHICLE_WORDS)}, x))) >= 3 OR (starts_with(lower(cl), 'reg') AND len(lt) > 1)) THEN false
  WHEN product OR len(list_intersect(lt, {_list(classify.SECURITY_WORDS)})) > 0 OR regexp_matches(u, 'C/W|HD-') THEN false WHEN regexp_matches(s, '\\p{{Ll}}') THEN true
  ELSE len(list_intersect(ct, {_list(classify.COMPANY_SUFFIXES)})) > 0 END AS company FROM c4"""


@query(_NAMED)
def classify_names(read: Read) -> DataFrame:
    name = F.col("name")
    return read("entities").where("name IS NOT NULL").select("entity_id", "name", classify.is_company_name(name).alias("company"), classify.is_fund_name(name).alias("fund")).distinct()


@query(r"""SELECT DISTINCT c_custkey, lpad(right(regexp_replace(c_name, '\D', '', 'g'), 10), 10, '0') AS cik, coalesce(nullif(ltrim(regexp_replace(c_name, '\D', '', 'g'), '0'), ''), '0') AS bare FROM customer""")
def normalize_cik(read: Read) -> DataFrame:
    return read("customer").select("c_custkey", text.cik(F.col("c_name")).alias("cik"), text.unpadded(text.digits(F.col("c_name"))).alias("bare")).distinct()


@query(r"""SELECT DISTINCT accession, regexp_replace(accession, '\D', '', 'g') AS plain,
  'https://filings.example/data/' || coalesce(nullif(ltrim(cik, '0'), ''), '0') || '/' || regexp_replace(accession, '\D', '', 'g') || '/' AS url FROM accession_index""")
def accession_urls(read: Read) -> DataFrame:
    acc = F.col("accession")
    return read("accession_index").select("accession", text.digits(acc).alias("plain"), text.accession_url("https://filings.example/data", F.col("cik"), acc).alias("url")).distinct()


@query(r"""SELECT DISTINCT ticker, nullif(lower(regexp_replace(upper(split_part(ticker, '.', 1)), '[^A-Z0-9]', '', 'g')), '') AS plain,
  nullif(regexp_replace(upper(split_part(split_part(regexp_replace(trim(ticker), '^\^', ''), '-', 1), '.', 1)), '[^A-Z0-9]', '', 'g'), '') AS base FROM sec_rows""")
def ticker_symbols(read: Read) -> DataFrame:
    t = F.col("ticker")
    return read("sec_rows").select("ticker", text.ticker(t).alias("plain"), text.symbol(t).alias("base")).distinct()


@query(r"""SELECT doc_id, CASE WHEN regexp_full_match(k, '[A-Z]{2}[A-Z0-9]{10}') THEN lower(k) END AS isin FROM (
  SELECT doc_id, upper(regexp_replace('US' || lpad(cast(doc_id AS varchar), CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 10 END, '0'), '[^\p{L}\p{N}]', '', 'g')) AS k FROM documents)""")
def isin_normalize(read: Read) -> DataFrame:
    raw = F.concat(F.lit("us-"), F.lpad(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, 9).otherwise(10), F.lit("0")))
    return read("documents").select("doc_id", text.isin(raw).alias("isin"))


@query("""SELECT canonical_id, x AS listed, CASE x WHEN 'AB.L' THEN 'XLON' WHEN 'AB.TWO' THEN 'ROCO' WHEN 'AB.T' THEN 'XTKS' WHEN 'AB.de' THEN 'XFRA' END AS market
  FROM (SELECT DISTINCT canonical_id FROM candles_raw), (SELECT unnest(['AB.L', 'AB.TWO', 'AB.T', 'AB.de', 'AB', 'AB.QQ']) AS x)""")
def suffix_exchange(read: Read) -> DataFrame:
    ids = read("candles_raw").select("canonical_id").distinct()
    listed = ids.select("canonical_id", F.explode(F.array(*[F.lit(x) for x in ("AB.L", "AB.TWO", "AB.T", "AB.de", "AB", "AB.QQ")])).alias("listed"))
    return listed.withColumn("market", text.suffix_market(F.col("listed")))


@query(r"""SELECT cik, f.name AS name, try_cast(nullif(f.size, '') AS double) AS size, cast(trunc(try_cast(nullif(f.size, '') AS double)) AS bigint) AS whole, split_part(f.name, '.', -1) AS ending,
  regexp_matches(lower(f.name), '\.(pdf|xlsx|xslx|xls)$') AS attachment, regexp_matches(lower(f.name), '\.(xml|txt)$') AS xbrl,
  regexp_matches(lower(f.name), '(_def\.xml|_pre\.xml|_cal\.xml|_lab\.xml|\.css|\.js|\.png|\.jpg|\.jpeg|\.gif|\.svg|\.ico|\.map|\.woff|\.ttf|\.eot|\.mp4|\.jsonld|\.webmanifest|\.rdf|\.xsd)$') AS ignorable
  FROM (SELECT DISTINCT cik, unnest(files) AS f FROM accession_index)""")
def file_attributes(read: Read) -> DataFrame:
    rows = read("accession_index").select("cik", "accession", F.explode("files").alias("f")).select("cik", "accession", F.col("f").alias("f")).distinct()
    rows = rows.dropDuplicates(["cik", "f"])
    name = F.col("f.name")
    return rows.select("cik", name.alias("name"), text.lenient_double(F.col("f.size")).alias("size"), text.lenient_long(F.col("f.size")).alias("whole"), text.last_segment(name, ".").alias("ending"),
                       text.is_attachment(name).alias("attachment"), text.is_xbrl_file(name).alias("xbrl"), text.ignorable_file(F.col("accession"), name).alias("ignorable"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS revision, cast(ts AS date) AS day FROM events")
def revision_parse(read: Read) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS 'Z'")
    return read("events").select("event_id", text.revision(stamp).alias("revision"), text.compact_day(F.date_format("ts", "yyyyMMdd")).alias("day"))


@query(r"""SELECT entity_id, coalesce(nullif(trim(regexp_extract(trim(s), '(?i)^([^(\n]+?)(?:\s*\(|\s+is\b|\s+has\b|,|$)', 1)), ''), entity_id) AS label
  FROM (SELECT DISTINCT entity_id, coalesce(name, '') || ' is listed' AS s FROM entities WHERE entity_type = 'crypto')""")
def crypto_names(read: Read) -> DataFrame:
    rows = read("entities").where("entity_type = 'crypto'").select("entity_id", concat(F.coalesce("name", F.lit("")), F.lit(" is listed")).alias("s")).distinct()
    return rows.select("entity_id", text.summary_name(F.col("s"), F.col("entity_id")).alias("label"))


# --- metadata ----------------------------------------------------------------


@query("SELECT entity_id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.country') END AS country FROM (SELECT DISTINCT entity_id, metadata FROM entities)")
def json_field(read: Read) -> DataFrame:
    return read("entities").select("entity_id", "metadata").distinct().select("entity_id", F.try_element_at(metadata.parse(F.col("metadata")), F.lit("country")).alias("country"))


@query("""SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'ccy:' || c_nationkey END AS currency FROM customer""")
def metadata_build(read: Read) -> DataFrame:
    ccy = F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("ccy:"), F.col("c_nationkey").cast("string"))).otherwise(F.lit(" "))
    rows = read("customer").select("c_custkey", metadata.build(segment=F.col("c_mktsegment"), currency=ccy).alias("j"))
    return rows.select("c_custkey", metadata.field(F.col("j"), "segment").alias("segment"), metadata.field(F.col("j"), "currency").alias("currency"))


@query("SELECT user_id, arg_max(json_extract_string(props, '$.k'), event_id) AS k, max(event_id) AS last FROM events GROUP BY 1")
def metadata_merge(read: Read) -> DataFrame:
    e = read("events").select("user_id", "event_id", F.to_json(F.struct(metadata.field(F.col("props"), "k").alias("k"), F.col("event_id").cast("string").alias("last"))).alias("j"))
    merged = entities.metadata_by_key(e, "user_id", "j", "event_id")
    return merged.select("user_id", F.element_at("members", "k").alias("k"), F.element_at("members", "last").cast("bigint").alias("last"))


@query("""SELECT event_id, CASE WHEN lag(props) OVER w IS NOT NULL THEN json_extract_string(lag(props) OVER w, '$.k') <> json_extract_string(props, '$.k') END AS conflicts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def metadata_conflict(read: Read) -> DataFrame:
    return entities.lag_conflict(read("events"), "user_id", "props", "event_id").select("event_id", "conflicts")


# --- first, last, distinct ---------------------------------------------------


@query("SELECT p_name, arg_min(p_brand, p_partkey) AS p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def fund_first_wins(read: Read) -> DataFrame:
    return upsert.keep_first(read("part").select("p_name", "p_brand", "p_partkey"), ["p_name"], F.col("p_partkey"))


@query("SELECT p_name, arg_max(p_brand, p_partkey) AS p_brand, max(p_partkey) AS p_partkey FROM part GROUP BY 1")
def crypto_last_wins(read: Read) -> DataFrame:
    return upsert.keep_last(read("part").select("p_name", "p_brand", "p_partkey"), ["p_name"], F.col("p_partkey"))


@query("SELECT count(DISTINCT canonical_id) AS assets, count(DISTINCT provider_id) AS providers FROM candles_raw")
def unique_assets(read: Read) -> DataFrame:
    return read("candles_raw").agg(F.countDistinct("canonical_id").alias("assets"), F.countDistinct("provider_id").alias("providers"))


@query("""SELECT cik, string_agg(accession, ',' ORDER BY first) AS accessions FROM (SELECT cik, replace(accession, '-', '') AS accession, min(row(fetched_at, accession)) AS first FROM accession_index GROUP BY 1, 2) GROUP BY 1""")
def distinct_ordered(read: Read) -> DataFrame:
    seen = entities.ordered_distinct(read("accession_index"), "cik", text.digits(F.col("accession")), F.struct("fetched_at", "accession"))
    return seen.select("cik", F.array_join("values", ",").alias("accessions"))


_SLUG = r"coalesce(nullif(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-'), ''), 'unknown')"


@query(f"""SELECT slug, row_idx, CASE WHEN p_type = first_value(p_type) OVER (PARTITION BY slug ORDER BY row_idx) THEN slug ELSE slug || '.' || lower(p_type) END AS entity_id
  FROM (SELECT p_partkey AS row_idx, p_type, {_SLUG.format('p_name')} AS slug FROM part)""")
def slug_merge_or_split(read: Read) -> DataFrame:
    rows = read("part").select(text.slug(F.col("p_name")).alias("slug"), concat(text.slug(F.col("p_name")), F.lit("."), F.lower("p_type")).alias("alt"), metadata.build(type=F.col("p_type")).alias("meta"), F.col("p_partkey").alias("o"))
    return entities.merge_or_split(rows, "slug", "alt", "meta", "o")


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS r, 'n' || c_nationkey || ':' || (c_custkey // 40) AS v FROM customer UNION ALL SELECT c_custkey, 's' || c_mktsegment || ':' || (c_custkey // 25) FROM customer),
e AS (SELECT DISTINCT a.r AS a, b.r AS b FROM l a JOIN l b USING (v)), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT a AS row_idx, min(b) AS "group" FROM t GROUP BY 1""")
def equities_groups(read: Read) -> DataFrame:
    c = read("customer")
    part = lambda col, tag, n: c.select(F.col("c_custkey").alias("row_idx"), F.concat(F.lit(tag), F.col(col).cast("string"), F.lit(":"), F.expr(f"cast(c_custkey div {n} as string)")).alias("link"))
    return entities.connected_rows(part("c_nationkey", "n", 40).unionByName(part("c_mktsegment", "s", 25)))


@query("""WITH p AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 25)
SELECT l_orderkey * 10 + l_linenumber AS row_idx, coalesce(min(p_brand), min('region ' || n_regionkey)) AS company FROM lineitem
  LEFT JOIN p ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def identifier_hops(read: Read) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    rows = read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), tag("p:", "l_partkey").alias("first"), tag("s:", "l_suppkey").alias("second"))
    parts = read("part").where("p_size > 25")
    securities = parts.select(tag("p:", "p_partkey").alias("identifier"), "p_brand").withColumnRenamed("p_brand", "security")
    securities = securities.unionByName(read("supplier").select(tag("s:", "s_suppkey").alias("identifier"), tag("n:", "s_nationkey").alias("security")))
    issuers = parts.select(F.col("p_brand").alias("security"), F.col("p_brand").alias("company")).distinct()
    issuers = issuers.unionByName(read("nation").select(tag("n:", "n_nationkey").alias("security"), tag("region ", "n_regionkey").alias("company")))
    return entities.by_identifier(rows, ["first", "second"], securities, issuers)


@query("SELECT o_custkey AS company, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS security FROM orders GROUP BY 1")
def latest_security(read: Read) -> DataFrame:
    return entities.latest_security(read("orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("security"), F.col("o_orderdate").alias("created_at")))


# --- ranges ------------------------------------------------------------------

_REQ = "WITH q AS (SELECT user_id, cast(min(ts) AS date) AS s, cast(max(ts) AS date) AS e FROM events GROUP BY 1)"


def _requests(read: Read) -> DataFrame:
    return read("events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))


@query(_REQ + "SELECT user_id, greatest(s, date '2024-01-10') AS \"start\", least(e, date '2024-01-12' + cast(user_id % 20 AS integer)) AS \"end\" FROM q WHERE greatest(s, date '2024-01-10') <= least(e, date '2024-01-12' + cast(user_id % 20 AS integer))")
def lifecycle_clip(read: Read) -> DataFrame:
    r = _requests(read)
    life = r.select("user_id", F.lit("2024-01-10").cast("date").alias("first"), F.date_add(F.lit("2024-01-12").cast("date"), (F.col("user_id") % 20).cast("int")).alias("last"))
    return ranges.clip(r, life, "user_id")


@query(_REQ + "SELECT user_id, cast(c AS date) AS chunk_start, least(cast(c AS date) + 6, e) AS chunk_end FROM (SELECT user_id, e, unnest(generate_series(cast(s AS timestamp), cast(e AS timestamp), interval 7 day)) AS c FROM q)")
def chunk_ranges(read: Read) -> DataFrame:
    return ranges.chunks(_requests(read), "user_id", 7)


@query(_REQ + """, d AS (SELECT user_id, cast(unnest(generate_series(cast(s AS timestamp), cast(e AS timestamp), interval 1 day)) AS date) AS d FROM q),
m AS (SELECT user_id, d FROM d WHERE (user_id, d) NOT IN (SELECT DISTINCT user_id, cast(ts AS date) FROM events WHERE event_type IN ('click', 'view'))),
g AS (SELECT *, d - cast(row_number() OVER (PARTITION BY user_id ORDER BY d) AS integer) AS k FROM m)
SELECT user_id, min(d) AS gap_start, max(d) AS gap_end FROM g GROUP BY user_id, k""")
def coverage_gaps(read: Read) -> DataFrame:
    seen = read("events").where(F.col("event_type").isin("click", "view")).select("user_id", F.to_date("ts").alias("from_day")).distinct()
    return ranges.gaps(_requests(read), seen.withColumn("to_day", F.col("from_day")), "user_id")


@query(_REQ + """, c AS (SELECT user_id, cast(c AS date) AS chunk_start, least(cast(c AS date) + 6, e) AS chunk_end FROM (SELECT user_id, e, unnest(generate_series(cast(s AS timestamp), cast(e AS timestamp), interval 7 day)) AS c FROM q)),
n AS (SELECT *, cast((row_number() OVER (PARTITION BY chunk_start, chunk_end ORDER BY user_id) - 1) // 5 AS integer) AS call FROM c)
SELECT chunk_start, chunk_end, call, string_agg(user_id, ',' ORDER BY user_id) AS keys FROM n GROUP BY 1, 2, 3""")
def window_groups(read: Read) -> DataFrame:
    g = ranges.window_groups(ranges.chunks(_requests(read), "user_id", 7), "user_id", 5)
    return g.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query("SELECT event_id, event_type AS source, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type IS DISTINCT FROM 'click'")
def union_sources(read: Read) -> DataFrame:
    e = read("events").withColumnRenamed("event_type", "source")
    clicks = F.coalesce(F.col("source") == "click", F.lit(False))
    return ranges.union_sources([e.where(clicks).select("event_id", "source", "value"), e.where(~clicks).select("event_id", "source")])


@query("SELECT p_brand FROM part WHERE p_size > 40 EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1000")
def set_difference(read: Read) -> DataFrame:
    p = read("part")
    return upsert.new_only(p.where("p_size > 40").select("p_brand").distinct(), p.where("p_retailprice > 1000").select("p_brand"), ["p_brand"])


# --- housing, filings and pages ----------------------------------------------


def _housing(read: Read) -> DataFrame:
    """Rows of a housing load made of the orders in the order of their keys; later rows have older revisions."""
    nation = F.col("c_nationkey").cast("string")
    return read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("housing").alias("source_provider"), nation.alias("provider_region_id"), F.when(F.col("c_nationkey") % 2 == 1, (F.col("c_nationkey") - 1).cast("string")).alias("parent_code"),
        F.concat(F.lit("region:national:"), nation).alias("region_id"), F.when(F.col("o_orderstatus") == "P", "unsupported type").alias("reject"), F.concat(F.lit("Region "), nation).alias("region_name"),
        F.col("o_orderpriority").alias("property_type_id"), F.lower("o_orderpriority").alias("property_type_name"), F.date_trunc("month", "o_orderdate").cast("date").alias("period_start_date"), F.lit("30").alias("period_granularity"),
        (-F.col("o_orderkey")).alias("data_revision"), F.col("o_totalprice").alias("median_sale_price"), F.col("o_orderkey").alias("load_order"),
    )


@query("""SELECT 'region:national:' || c_nationkey AS region_id, o_orderpriority AS property_type_id, cast(date_trunc('month', o_orderdate) AS date) AS period_start_date,
  -max(o_orderkey) AS data_revision, arg_max(o_totalprice, o_orderkey) AS median_sale_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3""")
def housing_metrics_upsert(read: Read) -> DataFrame:
    return tables.housing_tables(_housing(read))["market_metrics"].select("region_id", "property_type_id", "period_start_date", "data_revision", "median_sale_price")


@query("""WITH n AS (SELECT DISTINCT c_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
SELECT 'region:national:' || a.k AS region_id, 'Region ' || a.k AS region_name, 'region:national:' || b.k AS parent_region_id FROM n a LEFT JOIN n b ON a.k % 2 = 1 AND b.k = a.k - 1""")
def housing_regions(read: Read) -> DataFrame:
    return tables.housing_tables(_housing(read))["regions"].select("region_id", "region_name", "parent_region_id")


@query("""SELECT 'housing' AS provider, cast(c_nationkey AS varchar) AS provider_region_id, 'region:national:' || c_nationkey AS region_id, -max(o_orderkey) AS data_revision
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_nationkey""")
def housing_provider_map(read: Read) -> DataFrame:
    return tables.housing_tables(_housing(read))["region_provider_map"].select("provider", "provider_region_id", "region_id", "data_revision")


@query("SELECT DISTINCT o_orderpriority AS property_type_id, lower(o_orderpriority) AS property_type_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'")
def housing_property_types(read: Read) -> DataFrame:
    return tables.housing_tables(_housing(read))["property_types"].select("property_type_id", "property_type_name")


@query("""SELECT DISTINCT cik, 'https://x.example/' || n AS link FROM (SELECT cik, unnest([f.name for f in files]) AS n FROM accession_index) WHERE n IS NOT NULL""")
def html_links(read: Read) -> DataFrame:
    anchor = lambda f: F.concat(F.lit('<a class="x" href="https://x.example/'), f["name"], F.lit('">f</a> <A HREF="dir/">d</A>'))
    pages = read("accession_index").where("files IS NOT NULL").select("cik", F.array_join(F.transform("files", anchor), "\n").alias("html"))
    return pages.select("cik", F.explode(markdown.links(F.col("html"))).alias("link")).distinct()


@query()
def html_to_markdown(read: Read) -> DataFrame:
    """Every document as a page: its lines as a list, its text as a paragraph, what is known of it as a table."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    items = F.array_join(F.transform(F.split(safe, "\n"), lambda line: F.concat(F.lit("<li>"), line, F.lit("</li>"))), "")
    page = F.concat(F.lit("<div><b></b><p><b>"), "source", F.lit("</b></p><ul>"), items, F.lit("</ul><p>"), safe, F.lit("</p><table><tr><th>id</th><th>lang</th></tr><tr>"), cell("doc_id"), cell("lang"), F.lit("</tr></table></div>"))
    return read("documents").select("doc_id", markdown.markdown(page).alias("markdown"))



@query("""SELECT 'acc' || o_orderkey AS accession, 'TotalPrice' AS local_name, cast(o_orderdate AS date) AS instant_date, 'USD' AS measure, o_totalprice AS value,
  CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS decimals FROM orders""")
def xbrl_facts(read: Read) -> DataFrame:
    return _instance_facts(read("orders"))


def _instances(orders: DataFrame) -> DataFrame:
    xml = F.format_string(
        '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:f="http://x.example/f"><context id="c"><entity><identifier scheme="s">%s</identifier><segment><d:explicitMember xmlns:d="http://xbrl.org/2006/xbrldi" dimension="f:Priority">%s</d:explicitMember></segment></entity><period><instant>%s</instant></period></context>'
        '<unit id="u"><measure>iso4217:usd</measure></unit><f:TotalPrice contextRef="c" unitRef="u" decimals="%s">%s</f:TotalPrice><f:Note contextRef="c">none</f:Note></xbrl>',
        F.col("o_custkey"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "2").otherwise("INF"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
    )
    files = orders.select(F.concat(F.lit("acc"), F.col("o_orderkey").cast("string")).alias("path"), F.encode(xml, "UTF-8").alias("content"))
    return archives.xbrl(files).withColumnRenamed("path", "accession")


def _instance_facts(orders: DataFrame) -> DataFrame:
    parsed = _instances(orders)
    contexts = parsed.where("kind = 'context'").select("accession", F.col("ref").alias("context_ref"), F.col("instant_date"))
    units = parsed.where("kind = 'unit'").select("accession", F.col("ref").alias("unit_ref"), "measure")
    fact = parsed.where("kind = 'fact'").select("accession", F.col("name").alias("local_name"), "context_ref", "unit_ref", "value", "decimals")
    return fact.join(contexts, ["accession", "context_ref"]).join(units, ["accession", "unit_ref"], "left").select("accession", "local_name", "instant_date", "measure", "value", "decimals")


@query("""SELECT 'sec:xnas:u' || user_id AS canonical_id, cast(ts AS date) AS start_ts, value AS close FROM events""")
def bar_files(read: Read) -> DataFrame:
    line = F.format_string("U%s.US,D,%s,000000,1,2,0.5,%s,100,0\nbad,D,,,,,,,,\n", F.col("user_id"), F.date_format("ts", "yyyyMMdd"), F.col("value").cast("string"))
    files = read("events").select(F.concat(F.lit("us/nasdaq stocks/"), F.col("event_id").cast("string"), F.lit(".txt")).alias("member"), F.encode(F.concat(F.lit("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"), line), "UTF-8").alias("content"))
    return archives.bar_archive(files).select("canonical_id", "start_ts", "close")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def blob_round_trip(read: Read) -> DataFrame:
    packed = read("documents").select("doc_id", blobs.compressed(F.encode("text", "UTF-8")).alias("b"))
    return packed.select("doc_id", F.sha2(blobs.decompressed("b"), 256).alias("digest"))


@query(r"""WITH r AS (SELECT p_partkey AS i, upper(replace(p_name, ' ', '')) || ['', '.L', '.DE'][p_partkey % 3 + 1] AS symbol, p_name AS name, p_type AS category FROM part),
s AS (SELECT *, lower(regexp_replace(split_part(split_part(symbol, '-', 1), '.', 1), '[^A-Z0-9]', '', 'g')) AS base, lower(split_part(symbol, '.', 2)) AS ending FROM r),
h AS (SELECT *, first_value(name) OVER w AS n0, first_value(category) OVER w AS c0 FROM s WINDOW w AS (PARTITION BY base ORDER BY i)),
e AS (SELECT *, 'etf:' || CASE WHEN name = n0 AND category = c0 OR ending = '' THEN base ELSE base || '.' || ending END AS entity_id FROM h)
SELECT 'provider:list' AS provider, symbol AS provider_entity_id, arg_min(entity_id, i) AS entity_id FROM e GROUP BY symbol""")
def etf_listings(read: Read) -> DataFrame:
    p = read("part")
    sym = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.element_at(F.array(F.lit(""), F.lit(".L"), F.lit(".DE")), (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = p.select(F.col("p_partkey").alias("row_idx"), sym.alias("symbol"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"), F.col("p_type").alias("category"))
    return listings.products(rows, "etf", "etf", "provider:list").provider_ids


@query()
def equity_listings(read: Read) -> DataFrame:
    rows = read("sec_rows").distinct().select(F.xxhash64("cik", "ticker", "name").alias("row_idx"), F.col("ticker").alias("symbol"), "name", F.col("cik").alias("cusip"), F.lit("NMS").alias("exchange"))
    return listings.equities(rows, "provider:list").relations


@query(r"""SELECT DISTINCT 'company:us:' || coalesce(nullif(trim(regexp_replace(lower(trim(name)), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'unknown') AS entity_id FROM sec_rows""")
def sec_companies(read: Read) -> DataFrame:
    rows = read("sec_rows").select(F.xxhash64("cik", "ticker", "name").alias("row_idx"), "cik", "ticker", "name").distinct()
    held = read("entities").where("entity_type = 'company'").select("entity_id", "entity_type", metadata.parse(F.col("metadata")).alias("members")).dropDuplicates(["entity_id"])
    return listings.companies(rows, held, "provider:filings").entities.select("entity_id")


@query("""SELECT 'acc' || o_orderkey AS accession, 'f:Priority' AS axis, o_orderpriority AS member, o_totalprice AS value FROM orders""")
def fact_dimensions(read: Read) -> DataFrame:
    star = archives.star(_instances(read("orders")), "accession")
    return facts.by_dimension(star["facts"], star["dimensions"], axis="f:Priority").select("accession", "axis", "member", "value")


# --- reference tables and runs -----------------------------------------------

_EXCHANGE_ROWS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r[:4]) + ", [" + ", ".join(f"'{c}'" for c in r[4]) + "])" for r in static.EXCHANGES)


@query(f"""SELECT 'mic:' || lower(mic) AS entity_id, name, country, 'ccy:' || lower(currency) AS traded_in, string_agg(code, ',' ORDER BY code) AS codes
  FROM (SELECT mic, name, country, currency, unnest(codes) AS code FROM (VALUES {_EXCHANGE_ROWS}) AS x(mic, name, country, currency, codes)) GROUP BY ALL""")
def exchange_list(read: Read) -> DataFrame:
    listed, codes = tables.exchanges(read("nation").sparkSession)
    per = codes.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return listed.join(per, "entity_id")


@query("SELECT p_partkey, fold AS fingerprint FROM (SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || cast(p_size AS varchar)) AS fold FROM part)")
def row_fingerprint(read: Read) -> DataFrame:
    return read("part").select("p_partkey", text.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("fingerprint"))


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%dividend%' OR source LIKE 'f%'")
def like_filter(read: Read) -> DataFrame:
    return read("documents").where(F.col("text").ilike("%dividend%") | F.col("source").like("f%")).select("doc_id", "source")


@query("""WITH old AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), new AS (SELECT DISTINCT user_id FROM events WHERE event_type IS DISTINCT FROM 'purchase')
SELECT user_id, user_id IN (SELECT user_id FROM old) AS updated FROM new""")
def touch_updated(read: Read) -> DataFrame:
    e = read("events")
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    new = e.where(~bought).select("user_id").distinct().withColumn("updated", F.lit(False))
    return upsert.touched(e.where(bought).select("user_id"), new, ["user_id"], "updated", F.lit(True))


@query("""SELECT 'run ' || event_type AS run_id, event_type AS provider, min(ts) AS started_at, max(ts) AS finished_at, count(*) FILTER (value <= 90) AS updated, count(*) FILTER (value > 90) AS failed,
  CASE WHEN count(*) FILTER (value > 90) = 0 THEN 'success' WHEN count(*) FILTER (value <= 90) > 0 THEN 'partial' ELSE 'failed' END AS status, 'tag' AS etag FROM events GROUP BY event_type""")
def run_rows(read: Read) -> DataFrame:
    e = read("events").withColumn("run_id", concat(F.lit("run "), "event_type"))
    begun = e.groupBy("run_id", F.col("event_type").alias("provider")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("_last"))
    blank = {"finished_at": F.lit(None).cast("timestamp"), "status": F.lit("running"), "updated": F.lit(None).cast("bigint"), "failed": F.lit(None).cast("bigint"), "etag": F.lit(None).cast("string"), "notes": F.lit(None).cast("string")}
    outcome = upsert.audit(e, ["run_id"], F.col("value") > 90)
    return upsert.finished_run(begun.withColumns(blank), outcome, F.col("_last"), "tag").select("run_id", "provider", "started_at", "finished_at", "updated", "failed", "status", "etag")


@query(_SPANS + """SELECT DISTINCT user_id AS cik FROM m WHERE event_type = 'click' AND (active_to IS NULL OR active_to > date '2024-01-15')""")
def canonical_filers(read: Read) -> DataFrame:
    mapping = _spans(read).select(F.col("event_type").alias("provider"), F.col("user_id").alias("provider_entity_id"), F.col("entity").alias("entity_id"), "active_to")
    filers, _ = entities.filers_of(read("events").select(F.col("event_id").alias("entity_id")), mapping, "click", F.lit("2024-01-15").cast("date"))
    return filers


@query(_REQ + """, g AS (SELECT user_id, cast(unnest(generate_series(cast(greatest(s, date '2024-01-05') AS timestamp), cast(e AS timestamp), interval 1 day)) AS date) AS d FROM q WHERE greatest(s, date '2024-01-05') <= e),
m AS (SELECT user_id, d, d - cast(row_number() OVER (PARTITION BY user_id ORDER BY d) AS integer) AS k FROM g WHERE (user_id, d) NOT IN (SELECT DISTINCT user_id, cast(ts AS date) FROM events)),
r AS (SELECT user_id, min(d) AS s, max(d) AS e FROM m GROUP BY user_id, k),
c AS (SELECT user_id, cast(c AS date) AS chunk_start, least(cast(c AS date) + 6, e) AS chunk_end FROM (SELECT user_id, e, unnest(generate_series(cast(s AS timestamp), cast(e AS timestamp), interval 7 day)) AS c FROM r)),
n AS (SELECT *, cast((row_number() OVER (PARTITION BY chunk_start, chunk_end ORDER BY user_id) - 1) // 5 AS integer) AS call FROM c)
SELECT chunk_start, chunk_end, call, string_agg(user_id, ',' ORDER BY user_id) AS keys FROM n GROUP BY 1, 2, 3""")
def planned_calls(read: Read) -> DataFrame:
    r = _requests(read)
    life = r.select("user_id", F.lit("2024-01-05").cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    seen = read("events").select("user_id", F.to_date("ts").alias("from_day")).distinct().withColumn("to_day", F.col("from_day"))
    g = ranges.planned_calls(r, life, seen, "user_id", 7, 5)
    return g.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query("""SELECT user_id, event_type, arg_max(value, row(part, event_id)) AS value FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS part FROM events) GROUP BY 1, 2""")
def combined_calls(read: Read) -> DataFrame:
    e = read("events").select("user_id", "event_type", "event_id", "value")
    last = upsert.keep_last(e, ["user_id", "event_type"], F.col("event_id"))
    late = F.col("event_type").isin("click", "view")
    return ranges.combined(last.where(~late), [last.where(late).withColumn("value", F.col("value"))], ["user_id", "event_type"]).select("user_id", "event_type", "value")


@query("""WITH j AS (SELECT cik, fetched_at, CASE WHEN json_valid(payload) THEN json_extract(payload, '$.filings.recent') END AS r FROM edgar_submissions WHERE cik IS NOT NULL),
l AS (SELECT cik, fetched_at, cast(json_extract(r, '$.accessionNumber') AS varchar[]) AS a, cast(json_extract(r, '$.form') AS varchar[]) AS f, cast(json_extract(r, '$.filingDate') AS varchar[]) AS d FROM j
  WHERE json_type(r) = 'OBJECT' AND json_type(r, '$.accessionNumber') = 'ARRAY' AND json_type(r, '$.form') = 'ARRAY' AND json_type(r, '$.filingDate') = 'ARRAY'),
e AS (SELECT cik, fetched_at, i, a[i] AS a, f[i] AS form, try_cast(d[i] AS date) AS day FROM (SELECT *, unnest(range(1, least(len(a), len(f), len(d)) + 1)) AS i FROM l))
SELECT cik, replace(a, '-', '') AS accession, arg_min(form, row(-epoch_us(fetched_at), i)) AS form, arg_min(day, row(-epoch_us(fetched_at), i)) AS filing_date
  FROM e WHERE coalesce(a, '') <> '' AND day IS NOT NULL GROUP BY 1, 2""")
def filing_rows(read: Read) -> DataFrame:
    return nested.filing_rows(read("edgar_submissions")).select("cik", "accession", "form", "filing_date")
