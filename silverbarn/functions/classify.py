"""Classifiers of listed names (product label, fund, company) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverbarn.functions.text import name_key

#: Words that mark a structured product.
PRODUCT_WORDS = (
    "CALL", "PUT", "TB", "LG", "B", "OP", "BONUS", "CASH", "BARRIER", "WRAP", "CW", "BON", "CORR", "USD", "EUR", "TR", "ETC", "ETF", "STW", "ADX",
    "LEG", "BOOST", "CDI", "ORD", "CLASS", "SWAP", "RETURN", "CDS", "COUPON", "FLR", "FIX", "FLOAT", "PERP", "RATE", "YIELD", "ETN",
)
#: Legal forms that mark a company.
COMPANY_SUFFIXES = (
    "INC", "CORP", "COMPANY", "LLC", "LTD", "PLC", "AG", "AB", "SA", "SAB", "SE", "GMBH", "SPAC", "HOLDINGS", "GROUP", "TRUST", "REIT", "PARTNERS",
    "BANCORP", "CO", "SCA", "SL",
)
#: Words of share classes and other securities.
SECURITY_WORDS = (
    "share", "shares", "ordinary", "registered", "depositary", "depository", "preferred", "perpetual", "floating", "fixed", "warrant", "warrants",
    "unit", "units", "bond", "bonds", "bds", "cds", "cdi", "lof", "alloc", "flx", "hd", "class", "preference", "convertible", "call", "put", "bonus",
    "vor", "sta", "nam", "inhaber", "common", "stock", "regist", "registe", "register", "regis", "regi", "reg", "pref", "pclr", "pcl", "rights",
    "fund", "fondo", "fondos", "fundo", "waran", "actions", "action", "nom", "adr", "spons", "sponsor", "svcs", "svc", "hld", "hldg", "navne",
    "agnam",
)
#: Words of which three make a vehicle's description, not a company.
VEHICLE_WORDS = (
    "real", "estate", "investment", "management", "development", "international", "global", "company", "portfolio", "capital", "trust", "fund",
    "realestate", "invest",
)
#: Last words that keep a description a company.
FINAL_FORMS = (
    "company", "corporation", "corp", "inc", "llc", "ltd", "plc", "ag", "nv",
)
#: Last words and markers of funds.
FUND_LAST = (
    "FUND", "ETF", "TRUST", "INDEX", "MUTUAL", "BOND", "FOND",
)
FUND_MARKERS = (
    "FUND", "FUNDO", "FONDOS", "FONDO", "FOND", "RENTE",
)


def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda t: t != "")


def _any_of(tokens: Column, words: tuple[str, ...] | list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def _last(tokens: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def is_product_label(name: Column) -> Column:
    """A keyword of structured products, up to four codes with figures, or several words with a figure or without a letter."""
    up = F.upper(F.trim(name))
    tokens = _words(up, r"[\s/\\\-]+")
    codes = F.forall(tokens, lambda t: F.regexp_like(t, F.lit("^[A-Z0-9]*[0-9][A-Z0-9]*$")))
    figure, letter = F.regexp_like(up, F.lit(r"\p{Nd}")), F.regexp_like(up, F.lit(r"\p{L}"))
    return F.coalesce((F.size(tokens) > 0) & (_any_of(tokens, PRODUCT_WORDS) | ((F.size(tokens) <= 4) & codes) | ((F.size(tokens) > 1) & (figure | ~letter))), F.lit(False))


def is_fund_name(name: Column) -> Column:
    """Fund by its last word, its key, a pooled scheme's marker or a fund word outside product labels; notes never."""
    text, up = F.trim(name), F.upper(F.trim(name))
    tokens = _words(up, r"[^\p{L}\p{N}]+")
    last, key = _last(tokens), name_key(text)
    marker = F.regexp_like(up, F.lit("|".join(FUND_MARKERS)))
    rule = (
        F.when(F.size(tokens) == 0, False)
        .when(last == "ETN", False)
        .when(last.isin(*FUND_LAST), True)
        .when(F.startswith(key, F.lit("fund")) | F.endswith(key, F.lit("qpsc")), True)
        .when(F.array_contains(tokens, "QPSC"), True)
        .when(F.array_contains(tokens, "COLL") & F.regexp_like(text, F.lit(r"\p{Nd}")), True)
        .when(is_product_label(text), False)
        .otherwise(marker)
    )
    return F.coalesce(rule, F.lit(False))


def is_company_name(name: Column) -> Column:
    """Company: not a fund, share class, vehicle or product; mixed case, or capitals with a legal form."""
    text, up = F.trim(name), F.upper(F.trim(name))
    raw = _words(text, r"[^\p{L}\p{N}_]+")
    tokens, low = F.transform(raw, F.upper), F.transform(raw, F.lower)
    last, product = _last(tokens), is_product_label(text)
    suffix = _any_of(tokens, COMPANY_SUFFIXES)
    vehicle = ~F.lower(last).isin(*FINAL_FORMS) & ((F.size(F.filter(low, lambda t: t.isin(*VEHICLE_WORDS))) >= 3) | (F.startswith(F.lower(last), F.lit("reg")) & (F.size(low) > 1)))
    rule = (
        F.when(F.coalesce(text, F.lit("")) == "", False)
        .when(is_fund_name(text), False)
        .when(last.isin("R", "RE") & suffix, False)
        .when(last == "ETN", False)
        .when(F.regexp_like(up, F.lit(r" O\.N\.?$|PRE-ROLL|PREROLL")), False)
        .when(last.isin("NA", "NAM") & _any_of(tokens, ["ASA", "AG"]), False)
        .when(vehicle, False)
        .when(product | _any_of(low, SECURITY_WORDS) | F.regexp_like(up, F.lit("C/W|HD-")), False)
        .when(F.regexp_like(text, F.lit(r"\p{Ll}")), True)
        .otherwise(suffix)
    )
    return F.coalesce(rule, F.lit(False))
