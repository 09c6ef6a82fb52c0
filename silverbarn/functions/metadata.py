"""JSON metadata: build, parse, merge and compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def build(**fields: Column) -> Column:
    """JSON object of the fields that are not blank."""
    pairs = [x for name, c in fields.items() for x in (F.lit(name), F.trim(c.cast("string")))]
    return F.to_json(F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v, F.lit("")) != ""))


def parse(text: Column) -> Column:
    """Map of the members; empty for null, blank and damaged text."""
    return F.coalesce(F.from_json(text, MAP), F.create_map().cast(MAP))


def overlay(old: Column, new: Column) -> Column:
    """Members of both maps; those of ``new`` win."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def merged(texts: Column) -> Column:
    """Folds JSON texts in array order; later members win."""
    return F.aggregate(texts, F.create_map().cast(MAP), lambda acc, t: overlay(acc, parse(t)))


def conflict(old: Column, new: Column) -> Column:
    """Whether a shared member, or the name where both have one, differs."""
    both = F.map_zip_with(old, new, lambda _, a, b: a.isNotNull() & b.isNotNull() & (a != b))
    return F.exists(F.map_values(both), lambda x: x)


def field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")
