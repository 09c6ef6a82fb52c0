"""Text and identifier functions as column expressions; all are null-safe and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _upper_suffix_free(symbol: Column) -> Column:
    return F.upper(F.substring_index(symbol, ".", 1))


def slug(text: Column, sep: str = "-", empty: str | None = "unknown") -> Column:
    """Small letters; each run of other than letters and digits becomes one ``sep``; trimmed; ``empty`` if nothing is left."""
    out = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", sep)
    out = F.regexp_replace(out, f"^{sep}+|{sep}+$", "")
    return out if empty is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(empty))


def strip_state(name: Column, state: Column) -> Column:
    """Without a trailing ', ST' or ' ST' in any letter case."""
    code, low = F.lower(F.trim(state)), F.lower(name)
    n = F.length(name) - F.length(code)
    cut = lambda extra: F.rtrim(F.substring(name, F.lit(1), n - extra))
    return (
        F.when(F.coalesce(code, F.lit("")) == "", F.trim(name))
        .when(F.endswith(low, F.concat(F.lit(", "), code)), cut(2))
        .when(F.endswith(low, F.concat(F.lit(" "), code)), cut(1))
        .otherwise(F.trim(name))
    )


#: Tokens without meaning for the identity of an issuer.
FILLER = (
    "company", "co", "corp", "corporation", "inc", "ltd", "limited", "llc", "plc", "nv", "sa", "ag", "gmbh", "ab", "spac", "group", "adr", "hold",
    "holding", "holdings", "et", "expl", "p", "g", "cl", "a", "pg",
)


def name_key(name: Column) -> Column:
    """Issuer name as a key: camel case split, acronyms joined, fillers dropped, words joined by '-'."""
    spaced = F.lower(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " "))
    words = F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}_]+", " "))
    joined = F.regexp_replace(words, r"(?<=(^| )[\p{L}\p{N}_]) (?=[\p{L}\p{N}_]( |$))", "")
    return F.array_join(F.filter(F.split(joined, " "), lambda t: (t != "") & ~t.isin(*FILLER)), "-")


def names_match(left: Column, right: Column) -> Column:
    """Equal keys, or keys that differ by one trailing 'l'; false if either name is null."""
    a, b = name_key(left), name_key(right)
    return F.coalesce((a == b) | (F.concat(a, F.lit("l")) == b) | (F.concat(b, F.lit("l")) == a), F.lit(False))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def cik(text: Column) -> Column:
    """Ten digits, zero-padded; null where there is no digit."""
    d = F.nullif(digits(text), F.lit(""))
    return F.lpad(F.right(d, F.lit(10)), 10, "0")


def unpadded(number: Column) -> Column:
    """Without leading zeros; all zeros give '0'."""
    return F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.when(number.isNotNull(), F.lit("0")))


def ticker(symbol: Column) -> Column:
    """Small letters and digits before the first point; null if none."""
    return F.nullif(F.lower(F.regexp_replace(_upper_suffix_free(symbol), "[^A-Z0-9]", "")), F.lit(""))


def symbol(text: Column) -> Column:
    """Base symbol of a listed product: a leading caret, suffixes after '-' and '.' and other signs dropped; null if empty."""
    base = F.substring_index(F.regexp_replace(F.trim(text), r"^\^", ""), "-", 1)
    return F.nullif(F.regexp_replace(_upper_suffix_free(base), "[^A-Z0-9]", ""), F.lit(""))


def isin(text: Column) -> Column:
    """Twelve signs, two letters first, in small letters; else null. The check digit is not tested."""
    kept = F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(F.regexp_like(kept, F.lit("^[A-Z]{2}[A-Z0-9]{10}$")), F.lower(kept))


#: Listing suffixes and the market they stand for.
SUFFIX_MARKET = {
    "KS": "XKRX", "KQ": "XKOS", "HK": "XHKG", "TW": "XTAI", "TWO": "ROCO", "JP": "XTKS", "TO": "XTSE", "V": "XTSX", "NE": "NEOE", "AX": "XASX",
    "NZ": "XNZE", "NX": "ENX", "T": "XTKS", "SA": "BVMF", "L": "XLON", "IL": "XLON", "PA": "XPAR", "F": "XFRA", "BE": "XBER", "DU": "XDUS",
    "MU": "XMUN", "HA": "XHAM", "DE": "XFRA", "SG": "XSES", "MI": "XMIL", "AS": "XAMS", "BR": "XBRU", "VI": "XWBO", "LS": "XLIS", "IR": "XDUB",
    "HE": "XHEL", "CO": "XCSE", "HM": "XHAM", "SS": "XSHG", "SZ": "XSHE", "KL": "XKLS",
}


def suffix_market(text: Column) -> Column:
    """Market inferred from the suffix after the last point; null if unknown or absent."""
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_MARKET.items() for x in pair])
    return F.when(F.contains(text, F.lit(".")), F.element_at(table, F.upper(F.substring_index(text, ".", -1))))


def market(exchange: Column, text: Column, table: dict[str, str] | None = None) -> Column:
    """Exchange code by table, else a code of up to five letters as it stands, else by suffix, else UNKNOWN."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.upper(F.trim(exchange))) if table else F.lit(None).cast("string")
    code = F.upper(F.trim(exchange))
    return F.coalesce(known, F.when(F.regexp_like(code, F.lit("^[A-Z]{1,5}$")), code), suffix_market(text), F.lit("UNKNOWN"))


def lenient_double(text: Column) -> Column:
    """Number, or null for '', 'NA', other text and values that are not finite."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def lenient_long(text: Column) -> Column:
    """Whole part of a lenient number."""
    v = lenient_double(text)
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).try_cast("bigint")


def last_segment(text: Column, sep: str) -> Column:
    return F.substring_index(text, sep, -1)


def revision(text: Column) -> Column:
    """Epoch seconds of 'YYYY-MM-DD HH:MM:SS.fff Z'; 0 if unreadable."""
    stamp = F.try_to_timestamp(F.regexp_replace(text, r" ?Z$", "+00:00"))
    return F.coalesce(F.unix_seconds(stamp), F.lit(0)).cast("bigint")


def compact_day(text: Column) -> Column:
    """Day of 'YYYYMMDD'; null if unreadable."""
    return F.try_to_date(text, "yyyyMMdd")


def summary_name(summary: Column, *fallbacks: Column) -> Column:
    """Text before ' (', ' is', ' has', ',' or the end of the summary, else the first fallback that is not blank."""
    head = F.trim(F.regexp_extract(F.trim(summary), r"(?i)^([^(\n]+?)(?:\s*\(|\s+is\b|\s+has\b|,|$)", 1))
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (head, *fallbacks)])


def crypto_id(code: Column, listed: Column) -> Column:
    """'crypto:<slug>' of the code, else of the symbol before '-'; null if both are blank."""
    base = F.coalesce(F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(F.substring_index(listed, "-", 1)), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("crypto:"), F.nullif(s, F.lit("")))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over the texts of the columns; nulls are told from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def accession_url(base: str, cik_text: Column, accession: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), unpadded(digits(cik_text)), F.lit("/"), digits(accession), F.lit("/"))


def accession_index_urls(base: str, cik_text: Column, accession: Column, dashed: Column) -> Column:
    """Where the file list of a filing may be found, in the order it is tried: index.json, the directory, the index page."""
    folder = accession_url(base, cik_text, accession)
    return F.array(F.concat(folder, F.lit("index.json")), folder, F.concat(folder, dashed, F.lit("-index.htm")))


def submissions_url(base: str, cik_text: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/CIK"), cik(cik_text), F.lit(".json"))


def listed_files(index_json: Column, *pages: Column) -> Column:
    """Names of a filing's files: those of index.json, else the links of the first page that has any; each once, in order, no directories."""
    from silverbarn.functions.markdown import links

    items = F.from_json(index_json, "directory struct<item array<struct<name string>>>")["directory"]["item"]
    names = F.array_distinct(F.filter(F.transform(items, lambda i: i["name"]), lambda n: n.isNotNull() & ~F.endswith(n, F.lit("/"))))
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(some(names), *[some(F.transform(links(p), lambda h: F.substring_index(h, "/", -1))) for p in pages], F.array().cast("array<string>"))


def texts_of(values: Column) -> Column:
    """Every item as text, places kept."""
    return F.transform(values, lambda v: v.cast("string"))


def filled_texts_of(values: Column) -> Column:
    """Items that are not null or empty, as text; places are lost."""
    return F.filter(texts_of(values), lambda v: v.isNotNull() & (v != ""))


def utc_timestamp(stamp: Column) -> Column:
    """Timestamp of a text with or without a zone; without one it means UTC, which must be the session's zone. Null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(stamp), r"\s*Z$", "+00:00"))


#: What a filing's directory holds besides its documents.
IGNORED_FILES = ("metalink.json", "metalinks.json", "filingsummary.xml")
IGNORED_ENDINGS = (
    "_def.xml", "_pre.xml", "_cal.xml", "_lab.xml", ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".map", ".woff", ".ttf", ".eot",
    ".mp4", ".jsonld", ".webmanifest", ".rdf", ".xsd",
)
ATTACHMENTS = (".pdf", ".xlsx", ".xslx", ".xls")


def _ends_in(endings: tuple[str, ...]) -> Column:
    return F.lit("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def ignorable_file(accession: Column, file_name: Column) -> Column:
    """The filing's own text, known side files, linkbases and page furniture."""
    low = F.lower(file_name)
    own = (low == F.concat(F.lower(accession), F.lit(".txt"))) | (low == F.concat(digits(accession), F.lit(".txt")))
    return F.coalesce(own | low.isin(*IGNORED_FILES) | F.regexp_like(low, _ends_in(IGNORED_ENDINGS)), F.lit(False))


def is_attachment(file_name: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(file_name), _ends_in(ATTACHMENTS)), F.lit(False))


def is_xbrl_file(file_name: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(file_name), F.lit(r"\.(xml|txt)$")), F.lit(False))
