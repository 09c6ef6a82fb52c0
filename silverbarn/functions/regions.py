"""Canonical region identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverbarn.functions.text import slug, strip_state

ADMIN1 = ("state", "province", "territory", "admin1")


def _kind(region_type: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(region_type)), "^region:", "")


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def region_id(region_type: Column, name: Column, state: Column, city: Column, country: Column) -> Column:
    """Identifier by region type; null where a needed part is missing or the type unknown (see ``region_error``)."""
    kind, iso, st = _kind(region_type), F.lower(F.coalesce(country, F.lit("us"))), F.lower(F.trim(state))
    place = slug(strip_state(name, state), "_")
    return F.when(region_error(region_type, name, state, city).isNotNull(), F.lit(None)).otherwise(
        F.when(kind == "national", F.concat(F.lit("region:national:"), iso))
        .when(kind.isin("metro", "county"), F.concat_ws(":", F.lit("region"), kind, iso, st, place))
        .when(kind == "neighborhood", F.concat_ws(":", F.lit("region"), kind, iso, st, slug(city, "_"), place))
        .when(kind.isin(*ADMIN1), F.concat_ws(":", F.lit("region:admin1"), iso, slug(F.when(_given(name), F.trim(name)).otherwise(F.trim(state)), "_")))
    )


def region_error(region_type: Column, name: Column, state: Column, city: Column) -> Column:
    """Why no identifier can be built; null if one can."""
    kind = _kind(region_type)
    return (
        F.when(F.coalesce(~kind.isin("national", "metro", "county", "neighborhood", *ADMIN1), F.lit(True)), F.lit("unsupported type"))
        .when(kind.isin("metro", "county", "neighborhood", *ADMIN1) & ~_given(state), F.lit("state missing"))
        .when(kind.isin("metro", "county", "neighborhood") & ~_given(name), F.lit("name missing"))
        .when((kind == "neighborhood") & ~_given(city), F.lit("city missing"))
    )


def parent_id(region_type: Column, state: Column, country: Column) -> Column:
    """Admin1 region of a place with a state, the nation of an admin1 region, else null."""
    kind, iso = _kind(region_type), F.lower(F.coalesce(country, F.lit("us")))
    return F.when(kind.isin("metro", "county", "neighborhood") & _given(state), F.concat_ws(":", F.lit("region:admin1"), iso, slug(F.trim(state), "_"))).when(
        kind.isin(*ADMIN1), F.concat(F.lit("region:national:"), iso)
    )


def alias_id(region_type: Column, name: Column, state: Column, country: Column) -> Column:
    """Second identifier of an admin1 region: by its own type and name, or by state code if the type says no more."""
    kind, iso = _kind(region_type), F.lower(F.coalesce(country, F.lit("us")))
    named = slug(F.when(_given(name), F.trim(name)).otherwise(F.trim(state)), "_")
    return F.when(kind.isin("state", "province", "territory"), F.concat_ws(":", F.lit("region"), kind, iso, named)).when(
        (kind == "admin1") & _given(state), F.concat_ws(":", F.lit("region:state"), iso, slug(F.trim(state), "_"))
    )
