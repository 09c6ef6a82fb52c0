"""Two query builders with checked JSON payloads: market quotes and filing facts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbarn.functions.periods import PERIODS, per_period
from silverbarn.operators import best, facts

QUOTES, FACTS = "skill:market:quotes", "skill:edgar:facts"


@dataclass
class Result:
    records: DataFrame
    metadata: dict = field(default_factory=dict)


def _day(payload: dict, name: str) -> str | None:
    value = payload.get(name)
    if value in (None, ""):
        return None
    text = str(value).strip()
    if date.fromisoformat(text).isoformat() != text:
        raise ValueError(f"{name} must be YYYY-MM-DD")
    return text


def _bounds(payload: dict) -> tuple[str | None, str | None]:
    start, end = _day(payload, "start"), _day(payload, "end")
    if start and end and start > end:
        raise ValueError("start is after end")
    return start, end


class Skills:
    """``tables``: name to DataFrame (bars with ``canonical_id, start_ts, provider``, the fact star, filings, mapping)."""

    def __init__(self, tables: dict[str, DataFrame], as_of: str):
        self.tables, self.as_of = tables, as_of

    def list_skills(self) -> list[str]:
        return [QUOTES, FACTS]

    def describe_skill_usage(self, skill: str) -> str:
        usage = {
            QUOTES: "symbol, columns, start, end, aggregation {method: none|avg|median, period: week|month|year}",
            FACTS: "cik or symbol or entity, concepts, accession, period_type, start, end, limit (100)",
        }
        if skill not in usage:
            raise ValueError(f"unknown skill {skill}")
        return usage[skill]

    def execute_skill(self, skill: str, payload: dict) -> Result:
        self.describe_skill_usage(skill)
        return self.quotes(payload) if skill == QUOTES else self.facts(payload)

    def quotes(self, payload: dict) -> Result:
        symbol = str(payload.get("symbol") or "").strip()
        if not symbol:
            raise ValueError("symbol is required")
        start, end = _bounds(payload)
        how = payload.get("aggregation") or {}
        method, period = how.get("method", "none"), how.get("period")
        if method not in ("none", "avg", "median") or method != "none" and period not in PERIODS:
            raise ValueError("aggregation must name a method and a period")
        columns = payload.get("columns") or ["close"]
        bars = best.between(self.tables["candles"].where(F.col("canonical_id") == symbol), "start_ts", start, end)
        rows = best.best_provider(bars, self.tables["defaults"], self.tables["overrides"], self.as_of, ("canonical_id", "start_ts"))
        shown = best.projected(rows, columns).orderBy(F.col("start_ts").desc())
        meta = {"symbol": symbol, "row_count": rows.count(), "start": start, "end": end, "aggregation": method, "period": period}
        if method == "none":
            return Result(shown, meta)
        names = [c for c in shown.columns if c not in ("start_ts", "provider")]
        out = None
        for name in names:
            part = per_period(shown, "start_ts", name, period, method).withColumnRenamed("value", name)
            out = part if out is None else out.join(part.drop("n"), ["period", "period_start", "period_end"])
        return Result(out.orderBy(F.col("period_end").desc()), meta | {"aggregate_rows": out.count()})

    def facts(self, payload: dict) -> Result:
        start, end = _bounds(payload)
        limit = payload.get("limit", 100)
        if limit is not None and (not isinstance(limit, int) or limit <= 0):
            raise ValueError("limit must be a whole number above zero")
        names = payload.get("concepts") or []
        names = [names] if isinstance(names, str) else list(names)
        filings = self.tables["filings"]
        if payload.get("cik"):
            filings = filings.where(F.col("cik") == str(payload["cik"]).zfill(10))
        elif payload.get("symbol") or payload.get("entity"):
            entity = payload.get("symbol") or payload["entity"]
            held = self.tables["mapping"].where((F.col("entity_id") == entity) & (F.col("active_to").isNull() | (F.col("active_to") > F.lit(self.as_of).cast("date"))))
            if held.isEmpty():
                raise ValueError(f"no company for {entity}")
            filings = filings.join(held.select(F.col("provider_entity_id").alias("cik")).distinct(), "cik", "left_semi")
        else:
            raise ValueError("cik, symbol or entity is required")
        t = self.tables
        rows = facts.fact_history(t["facts"], t["concepts"], t["contexts"], t["units"], filings, names, payload.get("accession"), payload.get("period_type"), start, end, limit)
        return Result(rows, {"row_count": rows.count(), "limit": limit})
