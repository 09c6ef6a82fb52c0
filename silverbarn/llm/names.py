"""Linking variant spellings of names typed by people.

Names become a kind (organisation or person), what must agree exactly (line of
business, number of the vehicle; given name and initial) and the distinctive
words typed with errors. Words that stand in many names beside ever other words
are lines of business too; they are learnt from the names themselves. Distinct
forms, not records, go through MinHash banding over padded q-grams of each
distinctive word; the number of bands follows from the collision curve of a
word of that length. Candidate forms are verified by Monge-Elkan similarity,
linked forms clustered by star clustering, and clusters that share an
identifier joined.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverbarn.session import cut_lineage

#: Legal forms and what they are short for.
LEGAL = {
    "limited liability company": "llc", "limited partnership": "lp", "public limited company": "plc", "aktiengesellschaft": "ag",
    "incorporated": "inc", "corporation": "corp", "corpn": "corp", "company": "co", "limited": "ltd", "tr": "trust",
    "llc": "llc", "lp": "lp", "plc": "plc", "ag": "ag", "inc": "inc", "corp": "corp", "co": "co", "ltd": "ltd", "trust": "trust",
    "gmbh": "gmbh", "sa": "sa", "nv": "nv", "bv": "bv", "llp": "llp", "spa": "spa", "oy": "oy", "ab": "ab", "se": "se", "kg": "kg", "pty": "pty",
}
#: Words that say what kind of unit it is, with their abbreviations; people leave them out.
UNITS = {
    "international": "intl int'l internat", "systems": "sys syst systs system", "development": "dev devel devt", "associates": "assoc assocs assn",
    "services": "svc svcs serv service", "financial": "fin fincl finl finance", "holdings": "hldg hldgs holding", "management": "mgmt mgt",
    "laboratories": "lab labs laboratory", "manufacturing": "mfg manuf", "industries": "ind inds indus industry", "technologies": "tech techs technol technology",
    "group": "grp", "partners": "ptnrs", "enterprises": "ent", "brothers": "bros", "solutions": "soln", "capital": "cap", "global": "glob",
}
#: Lines of business with their abbreviations.
BUSINESS = {
    "mining": "", "cement": "", "biosciences": "biosci bioscience", "software": "softw", "packaging": "pkg packg", "optics": "opt", "aerospace": "aero aerosp",
    "robotics": "robot", "railways": "rail rlwys rwys railway", "energy": "engy", "textiles": "textile", "water": "", "timber": "", "leasing": "leas", "diagnostics": "diag",
    "hospitality": "hosp", "foods": "food", "shipping": "shpg", "communications": "comm comms commun communication", "chemicals": "chem chems chemical",
    "logistics": "logis logist lgstcs", "semiconductor": "semi semicon semicond semiconductors", "pharmaceuticals": "pharm pharma pharmas pharmaceutical", "insurance": "ins insur",
    "banking": "bank", "media": "", "steel": "", "oil": "", "gas": "", "airlines": "air airline", "motors": "motor", "retail": "", "estates": "estate", "brewing": "brew",
}
#: Given names with their short forms.
GIVEN = {
    "alexander": "alex alec sandy xander lex sasha", "andrew": "andy drew", "anthony": "tony", "barbara": "barb", "benjamin": "ben", "catherine": "cathy", "charles": "charlie chuck chas chaz charley",
    "christopher": "chris", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "donald": "don", "edward": "ed eddie ned ted", "elizabeth": "liz lizzie beth betty eliza betsy bess libby lisa",
    "francisco": "paco pancho frank cisco kiko", "frances": "fran", "george": "", "giuseppe": "beppe pino peppe peppino", "gregory": "greg", "helen": "", "henry": "hank harry hal",
    "james": "jim jimmy jamie jem", "jennifer": "jen jenny", "john": "johnny jack", "joseph": "joe joey jos jo", "katherine": "kathy kate katie kat kitty kay kath", "kenneth": "ken", "laura": "",
    "lawrence": "larry lars laurie lawrie", "linda": "", "margaret": "maggie meg peggy marge margie greta rita madge", "maria": "", "mark": "", "mary": "", "matthew": "matt", "michael": "mike mick", "nancy": "",
    "nicholas": "nick nico nicky", "patricia": "pat patty trish tricia patti", "paul": "", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick ricky dick rich richie",
    "robert": "bob rob bobby robbie bert", "ronald": "ron", "samuel": "sam", "sarah": "", "stephen": "steve", "susan": "sue suzy susie suzie", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "timothy": "tim", "victoria": "vicky tori vicki vic vickie", "walter": "walt", "william": "bill will billy willy willie liam", "zachary": "zach",
}
#: What stands around names without being part of them.
TITLES = frozenset("mr mrs ms miss dr prof sir dame esq cpa phd md jd mba cfa jr sr rev hon".split())
NOISE = frozenset("the and of & adr subsidiaries subsidiary und et y".split())
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

#: Two letters, so that an error spoils little of a short word.
Q = 2
#: Rows of a band for organisations; persons, of whom one word must collide, take one less.
ROWS = 4
#: Somewhat more than asked for (0.92), as repeated q-grams within a word make the measured recall fall below the curve.
RECALL = 0.95
#: Shorter words get as many bands as words of the one length, longer ones, which bear more errors, as many as of the other.
SHORTEST, LONGEST = 4, 6
#: Forms of one bucket compared by one task; a fuller bucket is cut into blocks of about so many.
BUCKET = 64
#: Least Monge-Elkan similarity of the distinctive words, and of a single word against several.
LEAST = 0.66
LEAST_ALONE = 0.78


def bands(similarity: float, recall: float, rows: int) -> int:
    """Bands needed so that a pair of this Jaccard similarity collides with this probability: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def typo_similarity(length: int) -> float:
    """Jaccard similarity of the padded q-grams of a word and the same with one wrong letter: Q of length + Q - 1 differ."""
    return (length - 1) / (length + 2 * Q - 1)


@lru_cache(maxsize=None)
def bands_of(length: int) -> int:
    """Bands of a word of so many letters; more for short ones, of which an error spoils a greater part."""
    return bands(typo_similarity(min(max(length, SHORTEST), LONGEST)), RECALL, ROWS)


BANDS = bands_of(SHORTEST)
_PRIME = (1 << 31) - 1
_A = np.random.default_rng(7).integers(1, _PRIME, BANDS * ROWS, dtype=np.int64)
_B = np.random.default_rng(11).integers(0, _PRIME, BANDS * ROWS, dtype=np.int64)
#: A word is a line of business if it stands in at least this share of the organisations' forms (and in LEAST_FORMS),
#: so at most words per name / GENERIC_SHARE of them are known, no other word stands beside it in more than BESIDE of these.
GENERIC_SHARE = 0.002
LEAST_FORMS = 20
BESIDE = 0.2
#: What leads the name in more than this share of its forms is a family's name.
LEADS = 0.5


def _table(words: dict[str, str]) -> dict[str, str]:
    return {short.replace("'", ""): long for long, shorts in words.items() for short in (long, *shorts.split())}


_UNIT, _BUSINESS = _table(UNITS), _table(BUSINESS)
_GIVEN: dict[str, tuple[str, ...]] = {}
for _long, _shorts in GIVEN.items():
    for _s in (_long, *_shorts.split()):
        _GIVEN[_s] = (*_GIVEN.get(_s, ()), _long)
_LEGAL_PHRASE = re.compile("|".join(sorted((k for k in LEGAL if " " in k), key=len, reverse=True)))
_CAMEL = re.compile(r"(?<=[a-zà-ÿ]{3})(?=[A-Z][a-z]{2})")
_STATE = re.compile(r"/\s*[A-Za-z]{2,3}\s*/?\s*$|/[A-Za-z]{2}/")
_DEGREE = re.compile(r"\bph\.? ?d\b\.?")
_LETTERS = re.compile(r"\b(?:[^\W\d_]\.){2,}")
_TOKEN = re.compile(r"[^\W_]+")
_FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def tokens(name: str) -> list[str]:
    """Small letters without accents; letters with points joined, figures typed for letters put back."""
    name = _STATE.sub(" ", _CAMEL.sub(" ", name))
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().translate(_FOLD)
    name = _LETTERS.sub(lambda m: m.group().replace(".", "") + " ", name.replace("’", "").replace("'", ""))
    name = _DEGREE.sub("phd ", name)
    name = _LEGAL_PHRASE.sub(lambda m: LEGAL[m.group()], " ".join(name.split()))
    out = []
    for t in _TOKEN.findall(name):
        if any(c.isdigit() for c in t) and sum(c.isalpha() for c in t) >= 2:
            t = t.replace("0", "o").replace("1", "l").replace("5", "s")
        out.append(t)
    return out


def _edits(a: str, b: str) -> int:
    """Edit distance in which swapping neighbours is one edit."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


@lru_cache(maxsize=100_000)
def given_name(token: str) -> str:
    """The given names a token may stand for, as 'a|b'; '' if none. One or two typing errors in a long name are forgiven."""
    if token in _GIVEN:
        return "|".join(_GIVEN[token])
    if len(token) >= 5:
        near = [k for k in GIVEN if abs(len(k) - len(token)) <= 1 and k[0] == token[0] or k[1:3] == token[1:3] and abs(len(k) - len(token)) <= 1]
        found = [k for k in near if _edits(k, token) <= (1 if len(k) < 8 else 2)]
        if len(found) == 1:
            return found[0]
    return ""


@lru_cache(maxsize=10_000)
def form(name: str | None, is_person: bool | None, generic: frozenset = frozenset()) -> tuple[str, str, list[str], str, str] | None:
    """(kind, exact, words, given, middle) of a name; None for a null or empty one.

    ``exact`` joins the line of business and the vehicle's number of an
    organisation; ``generic`` are the lines of business learnt. ``is_person``
    None: decided by the words. For a person the
    words are the surname's, ``given`` the possible given names or an initial.
    """
    found = tokens(name or "")
    if not found:
        return None
    if is_person is None:
        plain = [t for t in found if t not in NOISE]
        marked = any(t in LEGAL or t in _UNIT or t in _BUSINESS for t in plain)
        is_person = not marked and sum(t not in TITLES for t in plain) <= 4 and any(t in TITLES or len(t) == 1 or given_name(t) for t in plain)
    if is_person:
        plain = [t for t in found if t not in TITLES and t not in NOISE]
        letters = [t for t in plain if len(t) == 1]
        # "ah" comes from "A.H."
        words = [t for t in plain if len(t) > 2 or len(t) == 2 and len(plain) <= 2]
        letters += [c for t in plain if t not in words and len(t) == 2 for c in t]
        known = {t: given_name(t) for t in words}
        first = next((t for t in words if known[t] and t in _GIVEN), None) or next((t for t in words if known[t]), None)
        if first is None and len(words) > 1:
            first = words[0] if "," not in name else words[-1]
            known[first] = first
        rest = list(words)
        if first is not None and len(words) > 1:
            rest.remove(first)
            return "person", "", sorted(rest), known[first], letters[0] if letters else ""
        return "person", "", sorted(rest), letters[0] if letters else "", letters[1] if len(letters) > 1 else ""
    business, number, words = [], "", []
    for t in found:
        if t in NOISE or t in LEGAL or t in _UNIT:
            continue
        if t in _BUSINESS:
            business.append(_BUSINESS[t])
        elif t in generic:
            business.append(t)
        elif t in ROMAN or t.isdigit() and len(t) <= 3:
            number = str(ROMAN.get(t, t))
        elif len(t) > 1:
            words.append(t)
    if not words:
        words = business or found
    return "org", "+".join(sorted(set(business))) + "#" + number, words, "", ""


def _grams(word: str) -> list[str]:
    padded = "\x01" * (Q - 1) + word + "\x02" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def all_bands(words: list[str], rows: int = ROWS) -> list[np.ndarray]:
    """Band hashes of the MinHash signatures of the words' padded q-grams, as many as each word's length asks for.

    Words of one number of bands go together; every distinct q-gram is hashed once.
    """
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(bands_of(len(w)), []).append(i)
    number: dict[str, int] = {}
    grams = [[number.setdefault(g, len(number)) for g in _grams(w)] for w in words]
    crc = np.array([zlib.crc32(g.encode()) for g in number], np.int64) % _PRIME
    for n, group in groups.items():
        width = n * ROWS
        table = ((crc[:, None] * _A[:width] + _B[:width]) % _PRIME).astype(np.int64)
        for at in range(0, len(group), 512):
            some = group[at : at + 512]
            flat = np.concatenate([grams[i] for i in some])
            begin = np.cumsum([0, *(len(grams[i]) for i in some[:-1])])
            low = np.minimum.reduceat(table[flat], begin, axis=0).reshape(len(some), n, ROWS)
            mix = low[:, :, 0]
            for k in range(1, rows):
                mix = (mix * 1_000_003 + low[:, :, k]) & ((1 << 61) - 1)
            for i, row in zip(some, mix):
                out[i] = row
    return out


def word_bands(word: str, rows: int = ROWS) -> list[int]:
    """Band hashes of one word."""
    return all_bands([word], rows)[0].tolist()


def _forms(generic: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, link, name, person in zip(*(c.to_pylist() for c in batch.columns)):
                f = form(name, person, generic)
                kind, exact, words, given, middle = f or ("", "", [], "", "")
                for col, v in zip(out, (key, link, kind, exact, words, given, middle)):
                    col.append(v)
            kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "link", "kind", "exact", "words", "given", "middle"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, kinds = batch.column(0), batch.column(2).to_pylist()
        # the words run together find names written in one word or in pieces
        each = [sorted({*words, "".join(words)}) for words in batch.column(1).to_pylist()]
        ids, slots, hashes = [], [], []
        for person in (False, True):
            some = [i for i, k in enumerate(kinds) if (k == "person") is person]
            distinct = sorted({w for i in some for w in each[i]})
            found = dict(zip(distinct, all_bands(distinct, ROWS - person))) if distinct else {}
            for i in some:
                for w in each[i]:
                    ids.append(np.full(len(found[w]), i))
                    slots.append(np.arange(len(found[w])))
                    hashes.append(found[w])
        at = np.concatenate(ids) if ids else np.empty(0, np.int64)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(at, pa.int64())), join(slots, pa.int32()), join(hashes, pa.int64())], ["node", "slot", "hash"])


_FORM = "key string, link string, kind string, exact string, words array<string>, given string, middle string"


def lines_of_business(records: DataFrame) -> frozenset:
    """Words of many organisations' names that stand beside ever other words: what the names say of the business.

    Counted over the distinct forms of all names. The name of one party under
    very many spellings is no line of business, as its words keep one another
    company, nor is the name of a family of companies, which leads. The driver sees at most words per name / GENERIC_SHARE words.
    """
    forms = records.select("key", "link", "name", "person").mapInArrow(_forms(frozenset()), _FORM)
    names = forms.where((F.col("kind") == "org") & (F.size("words") > 1)).select(F.array_distinct("words").alias("words"), "exact").distinct()
    names = cut_lineage(names)
    least = max(LEAST_FORMS, GENERIC_SHARE * names.count())
    word = names.select(F.explode("words").alias("word"), "words")
    leads = F.count_if(F.col("word") == F.get("words", 0))
    often = word.groupBy("word").agg(F.count(F.lit(1)).alias("n"), leads.alias("first")).where((F.col("n") >= least) & (F.col("first") <= LEADS * F.col("n"))).drop("first")
    beside = word.join(often, "word").select("word", "n", F.explode("words").alias("other")).where(F.col("other") != F.col("word"))
    top = beside.groupBy("word", "n", "other").agg(F.count(F.lit(1)).alias("m")).groupBy("word", "n").agg(F.max("m").alias("m"))
    return frozenset(r["word"] for r in top.where(F.col("m") <= BESIDE * F.col("n")).select("word").collect())


def monge_elkan(a: Column, b: Column) -> Column:
    """Mean over the words of ``a`` of the best edit similarity with a word of ``b``."""
    near = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: near(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of form ids that share a bucket, a < b.

    A bucket is what must agree exactly (line of business and number, or the
    given name's initial) with one band of one word. Of a bucket with more
    than BUCKET forms all pairs are compared too, block against block, but
    only those that name the same party leave their task.
    """
    banded = nodes.select("node", "words", "kind").mapInArrow(_banded, f"node {nodes.schema['node'].dataType.simpleString()}, slot int, hash bigint")
    initials = F.array_distinct(F.transform(F.split("given", r"\|"), lambda g: F.substring(g, 1, 1)))
    info = nodes.select("node", "kind", "exact", F.explode(initials).alias("initial"))
    keyed = banded.join(info, "node").withColumn("bucket", F.xxhash64("kind", "exact", "initial", "slot", "hash"))
    keyed = cut_lineage(keyed.select("node", "bucket").distinct())
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    split = keyed.join(full, "bucket", "left")
    small = split.where(F.col("n").isNull()).select("node", "bucket")
    left, right = small.select(F.col("node").alias("a"), "bucket"), small.select(F.col("node").alias("b"), "bucket")
    pairs = left.join(right, "bucket").where(F.col("a") < F.col("b")).select("a", "b")
    return pairs.unionByName(full_bucket_pairs(nodes, split.where(F.col("n").isNotNull()))).distinct()


def full_bucket_pairs(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) of forms that share a full bucket and name the same party; ``full`` is (node, bucket, n).

    The forms of a bucket fall into blocks; each block meets itself and every
    other one in a task of its own. A pair of several full buckets is compared
    in the least of them.
    """
    blocks = F.ceil(F.col("n") / BUCKET)
    placed = full.select("node", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("bucket", "node"), blocks).alias("own"))
    mine = full.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    placed = placed.join(mine, "node").join(nodes.select("node", "kind", "words", "given", "middle"), "node")
    side = lambda s, i, j: placed.select("bucket", i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "buckets", "kind", "words", "given", "middle")])
    left = side("a", F.col("own"), F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = side("b", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")), F.col("own"))
    both = left.join(right, ["bucket", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a_node") < F.col("b_node")))
    both = both.where(F.col("bucket") == F.array_min(F.array_intersect("a_buckets", "b_buckets")))
    return both.where(same_party()).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def similarity() -> Column:
    """Similarity of the words of sides a and b."""
    a, b = F.col("a_words"), F.col("b_words")
    na, nb = F.size(a), F.size(b)
    forth, back = monge_elkan(a, b), monge_elkan(b, a)
    joined = lambda c: F.array_join(c, "")
    whole = 1 - F.levenshtein(joined(a), joined(b)) / F.greatest(F.length(joined(a)), F.length(joined(b)))
    # a name short of a word must have the words it has nearly right
    return F.when(na == nb, F.greatest((forth + back) / 2, whole)).otherwise(
        F.greatest(whole, F.when(F.when(na < nb, forth).otherwise(back) >= LEAST_ALONE, 0.9 * F.when(na < nb, forth).otherwise(back)).otherwise(0.0))
    )


def agreeing() -> Column:
    """Sides a and b do not differ in given name or initial; always true of organisations."""
    ga, gb = F.split("a_given", r"\|"), F.split("b_given", r"\|")
    letter = lambda c: (F.length(c) == 1)
    initials = lambda c: F.transform(c, lambda g: F.substring(g, 1, 1))
    near_given = F.exists(ga, lambda x: F.exists(gb, lambda y: F.levenshtein(x, y) <= 1))
    given = (
        (F.col("a_given") == "")
        | (F.col("b_given") == "")
        | F.when(letter(F.col("a_given")) | letter(F.col("b_given")), F.arrays_overlap(initials(ga), initials(gb))).otherwise(F.arrays_overlap(ga, gb) | near_given)
    )
    middle = (F.col("a_middle") == "") | (F.col("b_middle") == "") | (F.col("a_middle") == F.col("b_middle"))
    return (F.col("a_kind") != "person") | (given & middle)


def same_party() -> Column:
    return agreeing() & (similarity() >= LEAST)


def verified(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs that name the same party, with their similarity."""
    side = lambda s: nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "kind", "words", "given", "middle")])
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    # among persons the fuller agreement of given name and initial counts a little
    bonus = F.when((F.col("a_kind") == "person") & (F.col("a_given") == F.col("b_given")) & (F.col("a_middle") == F.col("b_middle")), 0.05).otherwise(0.0)
    kept = both.withColumn("similarity", similarity()).where(agreeing() & (F.col("similarity") >= LEAST)).withColumn("similarity", F.col("similarity") + bonus)
    return unambiguous(kept.select("a", "b", "similarity", "a_given", "a_middle", "b_given", "b_middle"))


def unambiguous(edges: DataFrame) -> DataFrame:
    """Edges without those by which a name that says less would join names that exclude each other.

    A person's name without an initial, or with an initial for the given name,
    may fit several relatives; it keeps the edges to the most similar of them.
    """
    edges = cut_lineage(edges)
    turn = lambda a, b: edges.select(F.col(a).alias("x"), F.col(b).alias("y"), "similarity", *[F.col(f"{s}_{c}").alias(f"{t}_{c}") for s, t in ((a, "x"), (b, "y")) for c in ("given", "middle")])
    both = turn("a", "b").unionByName(turn("b", "a"))
    fuller = lambda c, blank: blank(F.col(f"x_{c}")) & ~blank(F.col(f"y_{c}"))
    no_middle, no_given = fuller("middle", lambda c: c == ""), fuller("given", lambda c: F.length(c) <= 1)
    pick = lambda when, c: F.max(F.when(when, F.struct("similarity", F.col(f"y_{c}").alias("v"))))["v"]
    best = both.groupBy("x").agg(pick(no_middle, "middle").alias("m"), pick(no_given, "given").alias("g"))
    bad = both.where(no_middle | no_given).join(best, "x").where((no_middle & (F.col("y_middle") != F.col("m"))) | (no_given & (F.col("y_given") != F.col("g"))))
    bad = bad.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return edges.select("a", "b", "similarity").join(bad, ["a", "b"], "left_anti")


def star_clusters(edges: DataFrame) -> DataFrame:
    """(node, center): greedy star cover by degree, found in parallel rounds.

    In each round every node that comes before all its undecided neighbours
    (higher degree, then smaller id) becomes a center and covers them; this
    gives the same centers as taking the nodes one by one. A covered node goes
    to its most similar center. A center left without satellites, all its
    neighbours being others', joins the star of its most similar neighbour.
    Nodes without edges do not occur.
    """
    both = edges.select("a", "b", "similarity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = cut_lineage(both)
    order = both.groupBy("a").agg(F.struct((-F.count(F.lit(1))).alias("d"), F.col("a").alias("id")).alias("rank"))
    open_ = cut_lineage(order)
    centers = None
    while not open_.isEmpty():
        live = both.select("a", "b").join(open_.select("a"), "a").join(open_.select(F.col("a").alias("b"), F.col("rank").alias("other")), "b")
        first = live.groupBy("a").agg(F.min("other").alias("best"))
        new = open_.join(first, "a", "left").where(F.col("best").isNull() | (F.col("rank") < F.col("best"))).select("a")
        new = cut_lineage(new)
        centers = new if centers is None else centers.unionByName(new)
        covered = both.join(new, "a").select(F.col("b").alias("a")).unionByName(new)
        open_ = cut_lineage(open_.join(covered.distinct(), "a", "left_anti"))
    if centers is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("center"))
    near = both.join(centers.select(F.col("a").alias("b")), "b").join(centers, "a", "left_anti")
    satellite = cut_lineage(near.groupBy("a").agg(F.min_by("b", F.struct(-F.col("similarity"), F.col("b"))).alias("center")))
    alone = centers.join(satellite.select(F.col("center").alias("a")).distinct(), "a", "left_anti")
    next_to = both.join(alone, "a").groupBy("a").agg(F.min_by("b", F.struct(-F.col("similarity"), F.col("b"))).alias("b"))
    joined = next_to.join(satellite.select(F.col("a").alias("b"), "center"), "b").select(F.col("a").alias("node"), "center")
    own = centers.join(joined.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("center"))
    return satellite.select(F.col("a").alias("node"), "center").unionByName(joined).unionByName(own)


def joined_by(rows: DataFrame, label: str, link: str) -> DataFrame:
    """(label, party): labels connected through common links, by least label, until nothing changes."""
    ties = cut_lineage(rows.select(label, link).dropna().distinct())
    # a link of one label joins nothing
    ties = ties.join(ties.groupBy(link).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(link), link, "left_semi")
    ties = cut_lineage(ties)
    state = cut_lineage(rows.select(label).distinct().withColumn("party", F.col(label)))
    while True:
        by_link = ties.join(state, label).groupBy(link).agg(F.min("party").alias("p"))
        least = ties.join(by_link, link).groupBy(label).agg(F.min("p").alias("p"))
        near = state.join(least, label, "left").select(label, F.least("party", F.coalesce("p", "party")).alias("near"), F.col("party").alias("was"))
        # jump: the party of the party found so far
        heads = state.select(F.col(label).alias("near"), F.col("party").alias("head"))
        new = cut_lineage(near.join(heads, "near", "left").select(label, F.least("near", F.coalesce("head", "near")).alias("party"), "was").withColumn("moved", F.col("party") < F.col("was")))
        state = new.select(label, "party")
        if new.where(F.col("moved")).isEmpty():
            return state


def name_records(entities: DataFrame, sec_rows: DataFrame, submissions: DataFrame) -> DataFrame:
    """(key, link, name, person) of every record; link is what identifies it apart from its name."""
    e = entities.where(F.col("entity_type").isin("company", "fund_entity", "person") & F.col("entity_id").isNotNull())
    e = e.select(F.concat(F.lit("entities:"), "entity_id").alias("key"), F.concat(F.lit("entity:"), "entity_id").alias("link"), "name", (F.col("entity_type") == "person").alias("person"))
    cik = F.concat(F.lit("cik:"), "cik")
    s = sec_rows.where(F.col("cik").isNotNull()).select(F.concat(F.lit("sec_rows:"), "cik", F.lit(":"), F.coalesce("ticker", F.lit(""))).alias("key"), cik.alias("link"), "name", F.lit(None).cast("boolean").alias("person"))
    d = submissions.where(F.col("cik").isNotNull()).select(F.concat(F.lit("edgar_submissions:"), "cik").alias("key"), cik.alias("link"), F.col("entity_name").alias("name"), F.lit(None).cast("boolean").alias("person"))
    return e.unionByName(s).unionByName(d).distinct()


def parties(records: DataFrame) -> DataFrame:
    """(key, party) of every record.

    Records with null or empty names form parties by their link alone.
    Repeated rows and equal forms are folded before any comparison.
    """
    forms = records.mapInArrow(_forms(lines_of_business(records)), _FORM)
    # 128 bits stand for the form
    own = F.to_json(F.when(F.col("kind") != "", F.struct("kind", "exact", "words", "given", "middle")).otherwise(F.struct(F.lit("").alias("kind"), F.col("link").alias("exact"), F.array().cast("array<string>").alias("words"), F.lit("").alias("given"), F.lit("").alias("middle"))))
    forms = cut_lineage(forms.withColumn("node", F.unhex(F.md5(own))))
    nodes = forms.where((F.col("kind") != "") & (F.size("words") > 0)).select("node", "kind", "exact", "words", "given", "middle").dropDuplicates(["node"])
    nodes = cut_lineage(nodes)
    edges = cut_lineage(verified(nodes, candidate_pairs(nodes)))
    stars = star_clusters(edges)
    placed = forms.select("key", "link", "node").join(stars, "node", "left").withColumn("center", F.coalesce("center", "node"))
    placed = cut_lineage(placed.select("key", "link", "center").distinct())
    party = joined_by(placed, "center", "link")
    return placed.join(party, "center").select("key", "party").distinct()


def party_pairs(records: DataFrame) -> DataFrame:
    """(left_key, right_key): all pairs of records of one party, smaller key first."""
    found = parties(records)
    left, right = found.select(F.col("key").alias("left_key"), "party"), found.select(F.col("key").alias("right_key"), "party")
    return left.join(right, "party").where(F.col("left_key") < F.col("right_key")).select("left_key", "right_key").distinct()
