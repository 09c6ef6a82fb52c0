"""One surviving record per group of duplicate records.

Two operators share the group definition:

* ``survivors`` chooses, field by field, the row that supplies the value, by a
  declared order of trust (priority, staleness, recency). It is one partial
  plus final aggregation; a group of any size is folded on the map side.
* ``truth_model`` infers the sensitivity and specificity of every source, field
  by field, by expectation-maximisation over the claims of all groups and keeps
  every value judged true, so a field may keep several values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverbarn.session import cut_lineage

#: Fixed values of the trust rules.
NO_PRIORITY = 999
NO_STALENESS = 36500
INSTRUMENT_TYPES = {"sec": "security", "fx": "currency_pair"}


def instrument_type(canonical_id: Column) -> Column:
    prefix = F.substring_index(canonical_id, ":", 1)
    out = prefix
    for short, long in INSTRUMENT_TYPES.items():
        out = F.when(prefix == short, F.lit(long)).otherwise(out)
    return out


def with_trust(bars: DataFrame, priority: DataFrame) -> DataFrame:
    """Adds ``_priority`` and ``_staleness`` to every bar.

    The provider's row for the instrument's type holds, else its row with NULL
    type, else 999 and 36500 days. Among several rows the lowest priority,
    then the longest staleness. The dimension is aggregated to one row per
    provider and type; Spark broadcasts it only if its measured size permits.
    """
    ranked = (
        priority.where(F.col("provider_id").isNotNull())
        .select(
            F.col("provider_id").alias("_pp_id"),
            F.col("instrument_type").alias("_pp_type"),
            F.struct(
                F.coalesce("priority", F.lit(NO_PRIORITY)).alias("p"),
                (-F.coalesce("staleness_days", F.lit(NO_STALENESS))).alias("s"),
            ).alias("_rule"),
        )
        .groupBy("_pp_id", "_pp_type")
        .agg(F.min("_rule").alias("_rule"))
    )
    typed = ranked.where(F.col("_pp_type").isNotNull()).withColumnsRenamed({"_pp_id": "_t_id", "_pp_type": "_t_type", "_rule": "_t_rule"})
    default = ranked.where(F.col("_pp_type").isNull()).select(F.col("_pp_id").alias("_d_id"), F.col("_rule").alias("_d_rule"))
    joined = bars.join(
        typed,
        (F.col("provider_id") == F.col("_t_id")) & (instrument_type(F.col("canonical_id")) == F.col("_t_type")),
        "left",
    ).join(default, F.col("provider_id") == F.col("_d_id"), "left")
    rule = F.coalesce("_t_rule", "_d_rule")
    return joined.withColumns(
        {
            "_priority": F.coalesce(rule["p"], F.lit(NO_PRIORITY)),
            "_staleness": F.coalesce(-rule["s"], F.lit(NO_STALENESS)),
        }
    ).drop("_t_id", "_t_type", "_t_rule", "_d_id", "_d_rule")


def survivors(
    bars: DataFrame,
    priority: DataFrame,
    fields: Sequence[str] = ("close", "adj_close", "volume"),
    as_of: str = "2026-07-01",
    least_rows: int = 2,
) -> DataFrame:
    """One row per (canonical_id, start_ts): the bar that supplies each field.

    Order of preference among the rows where the field is not null: lowest
    priority, fresh before stale, latest ``ingested_at`` (null last), lowest
    ``provider_id`` (null last), lowest ``bar_id``. ``<field>_bar_id`` is 0 if
    the field is null in all rows. A null ``start_ts`` is never stale and
    forms a group of its own. Extra columns of ``bars`` are ignored; an empty
    table gives an empty result. Repeated rows tie and give the same bar_id.
    """
    needed = bars.select("bar_id", "canonical_id", "start_ts", "provider_id", "ingested_at", *fields)
    trusted = with_trust(needed, priority)
    stale = F.coalesce((F.datediff(F.lit(as_of).cast("date"), "start_ts") > F.col("_staleness")).cast("int"), F.lit(0))
    rank = F.struct(
        F.col("_priority"),
        stale.alias("stale"),
        F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**63 - 1)).alias("age"),
        F.coalesce(F.col("provider_id").cast("long"), F.lit(2**63 - 1)).alias("provider"),
        F.col("bar_id"),
    )
    best = trusted.withColumn("_rank", rank).groupBy("canonical_id", "start_ts").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(F.when(F.col(f).isNotNull(), F.col("_rank"))).alias(f) for f in fields],
    )
    return best.where(F.col("_n") >= least_rows).select(
        "canonical_id",
        F.date_format("start_ts", "yyyy-MM-dd").alias("bar_date"),
        *[F.coalesce(F.col(f)["bar_id"], F.lit(0)).cast("bigint").alias(f"{f}_bar_id") for f in fields],
    )


#: Values of a group are one claim as long as each is within this distance of the next on the log scale.
TOLERANCE = {"close": 0.005, "adj_close": 0.005, "volume": 0.1}
#: Fields that sources may count in units of their own, which are powers of ten.
OWN_UNITS = ("volume",)
#: Patterns that one task of a round takes.
PATTERNS = 50_000
#: Weak prior counts of the two qualities (told right, told wrong).
SENSITIVE, SPECIFIC = (1.6, 0.4), (1.8, 0.2)


@dataclass
class Quality:
    """What the model has learnt: odds of a claim being true by field, and both qualities by field and source."""

    base: dict[str, float]
    sensitivity: dict[tuple[str, int], float]
    specificity: dict[tuple[str, int], float]
    rounds: int = 0


def current_claims(bars: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(canonical_id, start_ts, said): what each source claims of a group at last, field by field.

    A later delivery of a source corrects its earlier one; null and NaN claim
    nothing, nor does a bar without a source. ``said`` has one entry a source,
    so its size is bounded by the number of sources, however often a bar is
    delivered: deliveries are folded on the map side first.
    """
    newest = F.struct("ingested_at", "bar_id")
    real = lambda f: F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")), newest)
    rows = bars.where(F.col("provider_id").isNotNull()).select("canonical_id", "start_ts", F.col("provider_id").cast("bigint").alias("source"), "ingested_at", "bar_id", *fields)
    last = rows.groupBy("canonical_id", "start_ts", "source").agg(*[F.max(F.when(real(f).isNotNull(), F.struct(newest.alias("at"), F.col(f).cast("double").alias("v"))))["v"].alias(f) for f in fields])
    return last.groupBy("canonical_id", "start_ts").agg(F.array_sort(F.collect_list(F.struct("source", *fields))).alias("said"))


def source_units(claims: DataFrame, field: str) -> dict[int, int]:
    """Power of ten by which each source's figures of a field differ from those of the other sources of its groups.

    The median over all groups of the distance to the median of the others; a
    source that shares no group counts in the common unit. One row a source
    reaches the driver.
    """
    log = lambda v: F.log10(v)
    told = F.filter("said", lambda s: s[field] > 0)
    others = lambda me: F.array_sort(F.transform(F.filter("told", lambda s: s["source"] != me["source"]), lambda s: log(s[field])))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    rows = claims.select(told.alias("told")).where(F.size("told") > 1)
    far = rows.select(F.inline(F.transform("told", lambda s: F.struct(s["source"].alias("source"), _let(others(s), lambda a: log(s[field]) - middle(a)).alias("far")))))
    return {r["source"]: round(r["m"]) for r in far.groupBy("source").agg(F.percentile_approx("far", 0.5, 1000).alias("m")).collect() if r["m"] is not None}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def value_clusters(told: Column, distance: float) -> Column:
    """Entries (source, value) sorted by value and cut wherever two neighbours are further apart than the distance."""
    place = lambda v: F.when(v > 0, F.log(v)).when(v == 0, F.lit(-1e6)).otherwise(F.lit(-2e6) - F.log(-v))
    entries = F.array_sort(F.transform(told, lambda s: F.struct(place(s["value"]).alias("x"), s["source"].alias("source"), s["value"].alias("value"))))

    def cut(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(e, i)["x"] - F.get(e, i - 1)["x"] > distance))
        return _let(starts, lambda st: F.transform(st, lambda at, k: F.slice(e, at + 1, F.coalesce(F.get(st, k + 1), F.size(e)) - at)))

    return F.when(F.size(told) > 0, _let(entries, cut))


def claimed_facts(claims: DataFrame, fields: Sequence[str], tolerance: Mapping[str, float], units: Mapping[str, Mapping[int, int]]) -> DataFrame:
    """(field, canonical_id, start_ts, sources, facts): the facts of every group with a claim, each the entries that assert it."""

    def of(field: str) -> Column:
        scale = {k: 10.0**v for k, v in units.get(field, {}).items() if v}
        told = F.filter("said", lambda s: s[field].isNotNull())
        told = F.transform(told, lambda s: F.struct(s["source"].alias("source"), (s[field] / _known(scale, s["source"], 1.0)).alias("value")))
        whole = lambda t: F.struct(F.lit(field).alias("field"), F.transform(t, lambda s: s["source"]).alias("sources"), value_clusters(t, tolerance[field]).alias("facts"))
        return _let(told, whole)

    rows = claims.select("canonical_id", "start_ts", F.inline(F.array(*[of(f) for f in fields])))
    return rows.where(F.size("sources") > 0).select("field", "canonical_id", "start_ts", "sources", "facts")


def _known(values: Mapping, key: Column, default: float) -> Column:
    """Value of a constant table, which has an entry a source at most."""
    if not values:
        return F.lit(default)
    # one expression text instead of a call for every literal
    return F.coalesce(F.element_at(F.expr("map(" + ", ".join(f"{int(k)}L, {float(v)!r}D" for k, v in values.items()) + ")"), key), F.lit(default))


def _by_field(fields: Iterable[str], field: Column, make: Callable[[str], Column]) -> Column:
    """``make`` of the row's field."""
    out = F.lit(None)
    for f in sorted(fields):
        out = F.when(field == f, make(f)).otherwise(out)
    return out


def _log_odds(q: Quality, field: str, yes: Column, no: Column) -> Column:
    mine = {s: (v, q.specificity[f, s]) for (f, s), v in q.sensitivity.items() if f == field}
    gain = {s: math.log(a / (1 - b)) for s, (a, b) in mine.items()}
    loss = {s: math.log((1 - a) / b) for s, (a, b) in mine.items()}
    total = lambda sources, table: F.aggregate(sources, F.lit(0.0), lambda a, s: a + _known(table, s, 0.0))
    return F.lit(q.base.get(field, 0.0)) + total(yes, gain) + total(no, loss)


def _posterior(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def learn_quality(facts: DataFrame, fields: Sequence[str], rounds: int = 200, change: float = 1e-4) -> Quality:
    """Expectation-maximisation to convergence: until no quality moves by more than ``change``.

    Groups with a single source teach nothing about agreement and are left
    out. Facts with the same sources for and against them are one weighted
    pattern. A round reads the patterns once; what reaches the driver are the
    model's parameters, one row per field and source.
    """
    teach = facts.where(F.size("sources") > 1).select("field", "sources", F.explode("facts").alias("fact"))
    teach = teach.select("field", "sources", F.array_sort(F.transform("fact", lambda e: e["source"])).alias("yes"))
    patterns = teach.groupBy("field", "yes", F.array_sort(F.array_except("sources", "yes")).alias("no")).agg(F.count(F.lit(1)).alias("n"))
    patterns = cut_lineage(patterns)
    # a round over few patterns is one task without a shuffle
    patterns = patterns.coalesce(1 + patterns.count() // PATTERNS)
    said = lambda c, v: F.transform(c, lambda s: F.struct(s.alias("source"), F.lit(v).alias("said")))
    # the entry without a source counts the facts themselves
    votes = F.concat(said("yes", 1), said("no", 0), F.array(F.struct(F.lit(None).cast("bigint").alias("source"), F.lit(1).alias("said"))))
    q = Quality({}, {}, {})
    for q.rounds in range(rounds + 1):
        p = _posterior(_by_field(fields, F.col("field"), lambda f: _log_odds(q, f, F.col("yes"), F.col("no")))) if q.rounds else F.size("yes") / (F.size("yes") + F.size("no"))
        each = patterns.select("field", "n", p.alias("p"), F.inline(votes))
        sums = each.groupBy("field", "source").agg(
            F.sum(F.col("n") * F.col("p") * F.col("said")).alias("tp"), F.sum(F.col("n") * F.col("p")).alias("t"),
            F.sum(F.col("n") * (1 - F.col("p")) * (1 - F.col("said"))).alias("tn"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f"),
        )
        base, sensitivity, specificity = {}, {}, {}
        for r in sums.collect():
            if r["source"] is None:
                base[r["field"]] = math.log((r["t"] + 1) / (r["f"] + 1))
            else:
                sensitivity[r["field"], r["source"]] = (r["tp"] + SENSITIVE[0]) / (r["t"] + sum(SENSITIVE))
                specificity[r["field"], r["source"]] = (r["tn"] + SPECIFIC[0]) / (r["f"] + sum(SPECIFIC))
        moved = max((abs(new[k] - old.get(k, 0)) for old, new in ((q.sensitivity, sensitivity), (q.specificity, specificity)) for k in new), default=0)
        q.base, q.sensitivity, q.specificity = base, sensitivity, specificity
        if moved <= change:
            break
    return q


def judged_values(facts: DataFrame, fields: Sequence[str], q: Quality, least: float = 0.5) -> DataFrame:
    """(field, canonical_id, start_ts, value, posterior, n_sources): every fact judged true, and of each group the best at least.

    The value is that of the asserting source with the greatest sensitivity,
    of equal ones the least source. No shuffle: a group's facts are in its row.
    """

    def judge(field: str) -> Column:
        trust = {s: v for (f, s), v in q.sensitivity.items() if f == field}

        def fact(entries: Column) -> Column:
            best = F.array_max(F.transform(entries, lambda e: F.struct(_known(trust, e["source"], 0.0).alias("t"), (-e["source"]).alias("s"), e["value"].alias("v"))))["v"]
            odds = lambda yes: _log_odds(q, field, yes, F.array_except("sources", yes))
            return F.struct(_posterior(_let(F.transform(entries, lambda e: e["source"]), odds)).alias("posterior"), F.size(entries).alias("n_sources"), best.alias("value"))

        return F.transform("facts", fact)

    judged = _by_field(fields, F.col("field"), judge)
    kept = _let(judged, lambda j: _let(F.array_max(j), lambda top: F.filter(j, lambda x: (x["posterior"] >= least) | (x == top))))
    return facts.select("field", "canonical_id", "start_ts", F.inline(kept)).select("field", "canonical_id", "start_ts", "value", "posterior", "n_sources")


def truth_model(
    bars: DataFrame, fields: Sequence[str] = ("close", "adj_close", "volume"), tolerance: Mapping[str, float] = TOLERANCE, own_units: Sequence[str] = OWN_UNITS, least: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Latent two-sided quality of sources: (judged values, source quality).

    A fact is a cluster of near values of one field of one group. A source that
    reports the field asserts one fact of the group and denies the others.
    Fields with units of their own are brought to the common unit first. The
    model is learnt once for both outputs.

    Judged values: every fact with a posterior of at least ``least``, so a field
    keeps all values judged true, and the best one of every group with a claim.
    Groups without claims are absent, sources that never shared a group have no
    quality row, an empty table gives none; extra columns are ignored.
    """
    claims = cut_lineage(current_claims(bars, fields))
    units = {f: source_units(claims, f) for f in fields if f in own_units}
    facts = claimed_facts(claims, fields, tolerance, units)
    q = learn_quality(facts, fields)
    rows = [(f, s, v, q.specificity[f, s], units.get(f, {}).get(s, 0)) for (f, s), v in sorted(q.sensitivity.items())]
    quality = bars.sparkSession.createDataFrame(rows, "field string, provider_id bigint, sensitivity double, specificity double, unit_power int")
    return judged_values(facts, fields, q, least), quality
