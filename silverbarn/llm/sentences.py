"""Sentence units in many languages and scripts by document-centred disambiguation.

Terminators are found by script; a period is judged by what the document itself
shows about the word before it (with a period before a small letter elsewhere:
an abbreviation; without a period elsewhere: an ordinary word) and the word
after it (written small elsewhere: no proper name). Where the document is
silent, the same evidence over the whole corpus decides, and only where that is
silent too do short lists of abbreviations break the tie. Frequent words carry
their evidence to every task; a boundary that hangs on a rare word is left open
there and settled by a join with the evidence table, so no word's evidence is
lost however large the corpus is. Quotations and brackets are kept whole; line
ends are told apart as hard wraps, headings and list items. ``lang`` is not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbarn.operators.facts import left_lookup
from silverbarn.session import cut_lineage, written

#: Fixed values for words without evidence: abbreviations that stand before their word, so end no sentence.
TITLES = frozenset(
    """dr mr mrs ms mme mlle m prof st sr sra srta mgr rev hon gen col capt lt sgt gov sen rep pres ing dipl
    no nos nr nrn núm num pág pag págs fig figs sec secs art arts abs ziff kap cap ch vol ref refs eq al pp
    vs v approx aprox ca cca circa env cf vgl est i.e e.g viz z.b d.h u.a p.ex p.ej resp sog bzw sq
    см п пп ст ок напр т.е т.к проф акад ул κ κα βλ σημ δηλ π.χ αρ σελ د ص أ डॉ श्री प्रो रु ee""".split()
)
#: Fixed values for words without evidence: abbreviations that may end a sentence as well.
ENDINGS = frozenset(
    """etc usw u.s u.k u.n e.u uu inc ltd corp co l.p llc plc bros assoc mfg dept a.m p.m jr sr. esq ph.d m.d cpa ft in lb oz
    jan feb mar apr jun jul aug sep sept oct nov dec mio mrd tsd г гг тыс млн млрд руб коп др пр εκατ δισ χιλ κ.λπ κ.ά""".split()
)
#: Units of money that the German text puts between a number and its noun.
NUMBER_WORDS = frozenset("mio mrd tsd тыс млн млрд εκατ δισ χιλ".split())
#: Words after a German ordinal, and words before one.
ORDINAL_NEXT = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner quartal halbjahr jahrhundert jahrestag geschäftsjahr".split())
ORDINAL_BEFORE = frozenset("am im zum vom beim dem des der bis ab seit den".split())
#: First words of the clause that reports a quotation.
REPORTS = frozenset("said says asked added wrote told noted stated replied sagte fragte erklärte schrieb déclaré demande dit dijo preguntó añadió afirmó".split())
#: Words with a number that begin a heading.
HEADS = frozenset("item note part section sec article chapter teil abschnitt artikel punkt kapitel titre capítulo".split())
#: Thai units of measure.
THAI_UNIT = re.compile("(?:พัน|หมื่น|แสน|ล้าน)*(?:บาท|หุ้น|ล็อต|หลัง|หน่วย|ปี|เดือน|วัน|คน|ราย|แห่ง|จุด|ครั้ง|สัญญา|ดอลลาร์|เปอร์เซ็นต์|ตัน|เมตร|ตารางเมตร|ไร่|ล้าน|พัน|แสน|หมื่น)(?:ต่อ[฀-๿]+)?$")

CLOSERS = "\"'”’“»›)\\]」』）】"
#: One leading set, so that the scan skips from mark to mark; what follows a western mark is checked apart.
MARK = re.compile(rf"[.…!?؟;;。！？｡।॥]+[{CLOSERS}]*(?:(?=\s|$|[A-ZÀ-ÞΑ-ΩА-Я])|(?<=[。！？｡।॥”’」』）】]))")
#: Marks that open and close what is kept whole; brackets nest, quotations do not.
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
NESTING = "([（"
_EDGE = re.compile(r"[“”„«»「」『』()（）\[\]\"]|\n[^\S\n]*\n|\n")
LINE = re.compile(r"[^\n\r  \x0b\x0c]+")
ITEM = re.compile(r"(?:[-–—•*·▪◦]|\(?\d{1,3}[.)]|\([a-zA-Z]\)|[a-z]\))\s+(?=\S)")
THAI = re.compile("[฀-๿]")
GREEK = re.compile("[Ͱ-Ͽ]")
CJK = re.compile("[぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\W_][\w’'-]*")
NUMBER = re.compile(r"[\d.,]+$")
#: Letters up to which a word of which nothing at all is known is taken for an abbreviation before a small letter.
SHORT = 4
#: Shortest unterminated line that counts as hard-wrapped; shorter ones are headings.
WRAP = 48


@dataclass(frozen=True)
class Evidence:
    """What the corpus says of frequent words; all are written small.

    ``abbreviations`` and ``words`` stand before a period as such, ``ordinary``
    words and ``names`` after one; ``starters`` begin sentences and ``counted``
    words stand before figures, ``finals`` seldom go on after their period. A word in neither set of a pair is rare.
    """

    abbreviations: frozenset = frozenset()
    words: frozenset = frozenset()
    ordinary: frozenset = frozenset()
    names: frozenset = frozenset()
    starters: frozenset = frozenset()
    counted: frozenset = frozenset()
    finals: frozenset = frozenset()


class Open(NamedTuple):
    """A boundary that hangs on rare words: what is known of both, and what the lists say of the first."""

    word: str
    after: str
    small: bool  # the second word is written small: what counts is whether the first goes on after its periods
    abbreviation: bool | None
    ordinary: bool | None
    listed: int  # 0: not, 1: before its word, 2: may end a sentence

    def ends(self, abbreviation: bool | None, ordinary: bool | None) -> bool:
        """The boundary's fate given what the evidence table says where nothing is known yet."""
        abbreviation = self.abbreviation if self.abbreviation is not None else abbreviation
        ordinary = self.ordinary if self.ordinary is not None else ordinary
        if self.small:
            return len(self.word) > SHORT if abbreviation is None else not abbreviation
        return not (self.listed > 0 if abbreviation is None else abbreviation) or bool(ordinary) or self.listed == 2


_NOTHING = (None,) * len(Open._fields)


def last_word(text: str) -> str:
    """The last word of a text that does not end in white space."""
    return text.rsplit(None, 1)[-1].lstrip("(\"“„«[/").lower()


def small_after(text: str) -> set[str]:
    """Words that the text shows with a period before a word in small letters that is no abbreviation itself."""
    parts = text.split(". ")
    return {last_word(p) for p, q in zip(parts, parts[1:]) if q[:1].islower() and "." not in q[:3] and p and not p[-1].isspace()}


#: What may stand around a word between blanks, apart from the period.
AROUND = "\"'“”„‘’«»()[]（）,;:!?…*•"


class _Own:
    """What a document shows of its own words, found when first asked for."""

    def __init__(self, text: str):
        self.text, self.small, self.tokens = text, None, None

    def before_small(self, word: str) -> bool:
        """Whether the word stands with a period before a small letter."""
        if self.small is None:
            self.small = small_after(self.text)
        return word in self.small

    def plain(self, word: str) -> bool:
        """Whether the word, written small, stands without a period."""
        if self.tokens is None:
            self.tokens = frozenset(self.text.split())
        tokens = self.tokens
        return word in tokens or word + "," in tokens or word + ";" in tokens or word + ":" in tokens or word + ")" in tokens or "(" + word in tokens

    def ordinary(self, word: str) -> bool:
        """Whether the word is written small somewhere."""
        return self.plain(word) or word + "." in self.tokens


def spans_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost quotations and brackets of any length; none crosses a blank line, a straight quotation no line."""
    opened: dict[str, list[int]] = {}
    found = []
    for m in _EDGE.finditer(text):
        mark, at = m.group(), m.start()
        if mark[0] == "\n":
            if len(mark) > 1:
                opened.clear()
            opened.pop('"', None)
            continue
        if mark == '"':
            if '"' in opened:
                found.append((opened.pop('"')[0], at + 1))
            else:
                opened['"'] = [at]
            continue
        opener = max((o for o, closers in PAIRS.items() if mark in closers and opened.get(o)), key=lambda o: opened[o][-1], default=None)
        if opener:
            found.append((opened[opener].pop(), at + 1))
        elif mark in PAIRS:
            if mark in NESTING:
                opened.setdefault(mark, []).append(at)
            else:
                opened[mark] = [at]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _ends(text: str, at: int, end: int, unit: int, nocase: bool, own: _Own, known: Evidence) -> bool | Open:
    """Whether the period run text[at:end] (closers included) ends the unit that began at ``unit``."""
    n = len(text)
    k = end
    while k < n and text[k].isspace():
        k += 1
    if k >= n:
        return True
    nxt = text[k]
    if k == end and nxt.isupper() and not text[k + 1 : k + 2].islower():
        return False
    if text[at] == "…" or text.startswith("..", at):
        return not (text[at - 1 : at].isspace() or nxt.islower() or nxt in ",;:")
    if nxt in "\"'“„«([「¿¡‘" and k + 1 < n:
        nxt = text[k + 1]
    # the word before the period
    near = text[max(unit, at - 64) : at].rsplit(None, 1)
    b = at - len(near[-1]) if near and not text[at - 1].isspace() else at
    while b > unit and not text[b - 1].isspace():
        b -= 1
    while b < at and text[b] in "(\"“„«[/":
        b += 1
    word = text[b:at]
    low = word.lower()
    if "’" in low or "'" in low:
        low = low.replace("'", "’").rpartition("’")[2]  # l’art. is art.
    m = WORD.match(text, k if text[k] == nxt else k + 1)
    after = m.group() if m else ""
    low_after = after.lower()
    inner_capital = nxt.islower() and len(after) > 1 and after[1].isupper()
    small = nxt.islower() and not inner_capital
    if not word:
        return not small
    if word.isdigit():
        if b == unit or (text[unit:b].strip().lower() in HEADS):
            return False  # the number of an item or heading
        if len(word) <= 2 and not nocase:
            if low_after in ORDINAL_NEXT:
                return False
            if nxt.isupper() and text[unit:b].split()[-1:] and text[unit:b].split()[-1].lower() in ORDINAL_BEFORE:
                return False
        return nocase or not small
    if len(word) <= 4 and word[:-1].isdigit() and word[-1].isalpha() and text[unit:b].strip().lower() in HEADS:
        return False
    letter = word[0].isalpha()
    if nocase:
        return _ends_without_capitals(low, low_after, letter, nxt, small, own, known)
    if not letter:
        return not small or word[-1] in ")%]"
    listed = 1 if low in TITLES else 2 if low in ENDINGS else 0
    initial = len(low) == 1 or "." in low and low.replace(".", "").isalpha() and all(len(x) <= 2 for x in low.split("."))
    # what the word is: the document first, then the corpus
    if initial:
        abbreviation = True
    elif own.plain(low):
        abbreviation = False
    elif not small and own.before_small(low):
        abbreviation = True
    else:
        abbreviation = True if low in known.abbreviations else False if low in known.words else None
    if small:
        # a small letter: an abbreviation, or capitals were lost here
        if listed or initial or not (word.isalpha() or word[-1] in "%)’”»"):
            return False
        if abbreviation is None and low in known.finals:
            return True
        return Open(low, low_after, True, None, None, 0) if abbreviation is None else not abbreviation
    if nxt.isdigit() or nxt in "+-−#" or unicodedata.category(nxt) == "Sc":
        # a figure: some words stand before figures with a period whatever else they are
        return not (abbreviation or listed == 1 or low in known.counted or listed and abbreviation is None)
    if abbreviation is False:
        return True
    if not nxt.isalpha():
        return True
    if low in ("г", "гг") and not text[unit:b].rstrip()[-1:].isdigit():
        return False
    # an abbreviation ends a sentence if the next word is no proper name
    point = (m.end() if m else k) + 1
    numbered = text[point - 1 : point] == "." and (low_after in known.counted or low_after in known.abbreviations)  # Ref. No. 5
    if numbered or len(after) == 1 and text[point - 1 : point] == ".":
        ordinary = False
    elif inner_capital or own.ordinary(low_after) or low_after in known.ordinary:
        ordinary = True
    else:
        ordinary = False if low_after in known.names else None
    if ordinary:
        return True
    if low in NUMBER_WORDS:
        return False
    if abbreviation is not None and (ordinary is not None or listed == 2):
        return listed == 2
    return Open(low, low_after, False, abbreviation, ordinary, listed)


def _ends_without_capitals(low: str, low_after: str, letter: bool, nxt: str, small: bool, own: _Own, known: Evidence) -> bool:
    """The same where a line has lost its capitals: an abbreviation ends a unit before a word that begins sentences."""
    if not letter:
        return True
    if low in TITLES and low not in known.words:
        return False
    if low in ENDINGS:
        return low_after in known.starters
    if len(low) == 1:
        return False
    if "." in low and low.replace(".", "").isalpha() and all(len(x) <= 2 for x in low.split(".")):
        return not small and low_after in known.starters
    if low in known.abbreviations:
        return not nxt.isdigit() and low_after in known.starters
    return True


def _thai_breaks(text: str, start: int, end: int) -> list[int]:
    """Ends of Thai units within a line: blanks but those before numbers and between a number and its unit."""
    out, unit = [], start
    pos = start
    while pos < end:
        while pos < end and not text[pos].isspace():
            pos += 1
        stop = pos
        while pos < end and text[pos].isspace():
            pos += 1
        if pos >= end:
            break
        if not THAI.search(text, unit, stop):
            continue
        nxt = text[pos]
        if nxt.isdigit() or (nxt in "-+$฿" and text[pos + 1 : pos + 2].isdigit()):
            continue
        b = stop
        while b > unit and not text[b - 1].isspace():
            b -= 1
        if NUMBER.match(text[b:stop]):
            e = pos
            while e < end and not text[e].isspace():
                e += 1
            if THAI_UNIT.match(text[pos:e].rstrip(".,;!?)")):
                continue
        out.append(stop)
        unit = pos
    return out


def sentence_units(text: str, known: Evidence | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in code points, without surrounding white space; rare words count as without evidence."""
    out: list[tuple[int, int]] = []
    joined = False
    for a, b, hangs in units_with_open_ends(text, known or Evidence()):
        if joined:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        joined = hangs is not None and not hangs.ends(None, None)
    return out


def units_with_open_ends(text: str, known: Evidence) -> list[tuple[int, int, Open | None]]:
    """(start, end, open end) of every unit; an open end may turn out to be none, so that the next unit belongs to it."""
    spans = spans_of(text)
    own = _Own(text)
    greek, thai = bool(GREEK.search(text)), bool(THAI.search(text))
    out: list[tuple[int, int, Open | None]] = []
    unit = -1  # where the open unit began
    last = 0  # end of the last line's content
    is_item = False
    nspan, si = len(spans), 0

    def close(a: int, b: int, hangs: Open | None = None) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b, hangs))

    gap = 0
    for line in LINE.finditer(text):
        ls, le = line.span()
        while ls < le and text[ls].isspace():
            ls += 1
        if ls == le:
            gap = 2
            continue
        between = text.count("\n", last, ls) + gap if unit >= 0 else 0
        gap = 0
        body = text[ls:le]
        nocase = body.islower() or (body.isupper() and len(body) > 60)
        item = ITEM.match(body)
        if unit >= 0:
            soft = False
            if between < 2:
                length = last - unit
                first = body[0]
                ordinal = item and body[0].isdigit() and (m := WORD.match(body, item.end())) and m.group().lower() in ORDINAL_NEXT
                figure = item and body[0].isdigit() and body[item.end() - 2 : item.end()].startswith(".") and length >= WRAP and not is_item and text[last - 1] not in ":.!?"
                if item and not ordinal and not figure:
                    soft = False
                elif CJK.search(text, unit, last) or thai and THAI.search(text, unit, last):
                    soft = False
                elif first.islower() and not nocase:
                    soft = True
                elif is_item:
                    soft = False
                else:
                    soft = length >= WRAP
                if soft:
                    item = None
            if not soft:
                close(unit, last)
                unit = -1
        if unit < 0:
            unit, is_item = ls, bool(item)
        if thai and THAI.search(body):
            from_here = ls + (item.end() if item else 0)
            for cut in _thai_breaks(text, from_here, le):
                # a number or name before the first Thai word belongs to it
                close(unit, cut)
                unit = cut
                while unit < le and text[unit].isspace():
                    unit += 1
        for m in MARK.finditer(body):
            at, end = ls + m.start(), ls + m.end()
            if at < unit:
                continue
            while si < nspan and spans[si][1] <= at:
                si += 1
            kind, hangs = text[at], None
            inside = si < nspan and spans[si][0] < at
            if inside and spans[si][1] > end:
                continue
            if kind in ";;":
                if not greek or not GREEK.search(text, unit, at):
                    continue
                ends = True
            elif kind in "。！？｡।॥":
                ends = True
            elif kind in "!?؟":
                k = end
                while k < le and text[k].isspace():
                    k += 1
                ends = k >= le or nocase or not text[k].islower() or text[k + 1 : k + 2].isupper()
            else:
                ends = _ends(text, at, end, unit, nocase, own, known)
                if isinstance(ends, Open):
                    # joined to the next unit later on, if that lies on the line or the line was wrapped here
                    k = end
                    while k < len(text) and text[k].isspace():
                        k += 1
                    wrapped = text.count("\n", end, k) == 1 and end - unit >= WRAP and not ITEM.match(text, k)
                    hangs, ends = (ends, True) if k < le or wrapped else (None, True)
            if ends and inside:
                a = spans[si][0]
                if text[a] in "([（":
                    ends = a == unit
                else:
                    k = end
                    while k < len(text) and text[k].isspace() and text[k] != "\n":
                        k += 1
                    nxt = text[k : k + 1]
                    w = WORD.match(text, k)
                    led = text[unit:a].rstrip()[-1:] in (":", "：") if a > unit else False
                    if led and not (nxt and nxt in "と"):
                        ends = True
                    elif nxt and (nxt in "とって，、,;:—–-" or nxt.islower() and not nocase or w and w.group().lower() in REPORTS):
                        ends = False
            elif ends and kind in "。！？" and text[end : end + 1] in ("と",):
                ends = False
            if ends:
                close(unit, end, hangs)
                unit = end
                while unit < le and text[unit].isspace():
                    unit += 1
                is_item = False
                if unit >= le:
                    unit = -1
                    break
        last = le
        while last > ls and text[last - 1].isspace():
            last -= 1
        if unit >= last:
            unit = -1
    if unit >= 0:
        close(unit, last)
    return out


#: Words with a capital inside a sentence.
_INSIDE = re.compile(r"(?<=[a-zß-öø-ÿά-ώа-яё,] )[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ][\w’'-]*")
_COUNTS = ("dot", "dot_small", "dot_figure", "head", "plain", "lower", "inside", "begins", "follows")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of every word: before a period at all, before a small letter, before a figure; after a period; without
    a period; written small; with a capital inside a sentence; beginning a sentence after an ordinary word, following an
    abbreviation in small letters."""
    tokens, inside, before_, after_ = Counter(), Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        counts: dict[str, Counter] = {c: Counter() for c in _COUNTS}
        for t, n in tokens.items():
            bare = t.strip(AROUND)
            word = bare.rstrip(".").lower()
            if word and word[0].isalpha():
                if bare[-1] != ".":
                    counts["plain"][word] += n
                if bare[0].islower():
                    counts["lower"][word] += n
        for t, n in inside.items():
            counts["inside"][t.lower()] += n
        for (word, c), n in before_.items():
            word = last_word(word)
            if word and word[0].isalpha():
                counts["dot"][word] += n
                if c.islower():
                    counts["dot_small"][word] += n
                elif c.isdigit() or unicodedata.category(c) == "Sc":
                    counts["dot_figure"][word] += n
        for (t, long), n in after_.items():
            m = WORD.match(t)
            if m:
                word = m.group().lower()
                counts["head"][word] += n
                if t[0].islower():
                    counts["follows"][word] += n
                elif long:
                    counts["begins"][word] += n
        for c in (tokens, inside, before_, after_):
            c.clear()
        words = list(set().union(*counts.values()))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([counts[c][w] for w in words], pa.int64()) for c in _COUNTS]], ["word", *_COUNTS])

    for batch in batches:
        befores, afters = [], []
        for text in batch.column(0).to_pylist():
            if not text or text.islower() or text.isupper():
                continue
            tokens.update(text.split())
            inside.update(_INSIDE.findall(text))
            parts = text.split(". ")
            before = parts[0]
            for part in parts[1:]:
                head = part.split(None, 1)
                if head and before and not before[-1].isspace():
                    word, nxt = before.rsplit(None, 1)[-1], head[0]
                    befores.append((word, nxt[0]))
                    if nxt[0].isalpha():
                        afters.append((nxt, len(word) > 4 and word.isalpha() or word[-1] in "%)"))
                before = part
        before_.update(befores)
        after_.update(afters)
        if len(tokens) + len(inside) + len(before_) + len(after_) > 400_000:
            yield flush()
    yield flush()


#: A word is frequent, and its evidence goes to every task, if it makes up at least this share of the words before or
#: after periods: at most 1 / SHARE words of each kind. The evidence of all other words is joined.
SHARE = 2e-5
#: Least occurrences before a period that tell of an abbreviation.
LEAST = 3


def word_evidence(documents: DataFrame) -> DataFrame:
    """(word, abbreviation, ordinary, starter, counted, final, dot, head): what all documents show of every word that stands before or after a period.

    A word that stands without a period as often as with one is none; else an
    abbreviation goes on with a small letter or a figure after a good part of
    its periods, the greater the longer it is, as long words are seldom cut
    short and capitals are sometimes lost. An ordinary word is written small
    more often than with a capital inside a sentence. Null: nothing shown.
    """
    counts = documents.select("text").mapInArrow(_count, "word string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    total = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS]).where((F.col("dot") > 0) | (F.col("head") > 0))
    dot, seen = F.col("dot"), F.col("lower") + F.col("inside")
    goes_on = F.col("dot_small") + F.col("dot_figure") >= (1 - F.exp(-(F.length("word") - 1) / 4)) * dot
    final = F.when((dot > 0) & (F.col("plain") >= dot), F.lit(True)).when(dot >= LEAST, ~goes_on)
    shown = F.when((dot > 0) & (F.col("plain") >= dot), F.lit(False)).when((dot >= LEAST) & goes_on, F.lit(True))
    ordinary = F.when(seen >= LEAST, F.col("lower") >= 0.5 * seen)
    begins = F.col("begins") + F.col("follows")
    starter = (begins >= LEAST) & (F.col("follows") <= 0.25 * begins)
    counted = (dot >= LEAST) & (F.col("dot_figure") >= 0.3 * dot)
    return total.select("word", shown.alias("abbreviation"), ordinary.alias("ordinary"), starter.alias("starter"), counted.alias("counted"), final.alias("final"), "dot", "head")


def frequent_evidence(table: DataFrame) -> Evidence:
    """The evidence of the frequent words, for every task."""
    dots, heads = table.agg(F.coalesce(F.sum("dot"), F.lit(0)), F.coalesce(F.sum("head"), F.lit(0))).first()
    often = table.where((F.col("dot") >= SHARE * dots) | (F.col("head") >= SHARE * heads))
    rows = often.select("word", "abbreviation", "ordinary", "starter", "counted", "final").collect()
    pick = lambda c, v: frozenset(r["word"] for r in rows if r[c] is v)
    return Evidence(pick("abbreviation", True), pick("abbreviation", False), pick("ordinary", True), pick("ordinary", False), pick("starter", True), pick("counted", True), pick("final", True))


def corpus_evidence(documents: DataFrame) -> Evidence:
    """What all documents show of the frequent words."""
    return frequent_evidence(cut_lineage(word_evidence(documents)))


#: Units as they leave the split; those that hang on rare words carry the number of their chain and what is known of the words.
_UNITS = "doc_id bigint, start_char bigint, end_char bigint, chain bigint, word string, after string, small boolean, abbreviation boolean, ordinary boolean, listed int"
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_()] * 3 + [pa.int32()]
_NAMES = [c.split()[0] for c in _UNITS.split(", ")]


def split_sentences(documents: DataFrame, known: Evidence | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit of every document.

    Two passes over the documents: evidence (unless given), then the split,
    which is narrow but for the boundaries that hang on rare words: those meet
    the evidence of their words by a join, without any text. Null, empty and
    blank texts have no units; repeated documents give the same units under
    each doc_id; extra columns are ignored.
    """
    table = None
    if known is None:
        table = cut_lineage(word_evidence(documents))
        known = frequent_evidence(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        for batch in batches:
            docs, starts, ends, chains, told = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_ = False
                for a, b, hangs in units_with_open_ends(text, known) if text else ():
                    docs.append(doc)
                    starts.append(a)
                    ends.append(b)
                    chains.append(number if open_ or hangs else None)
                    told.append(hangs or _NOTHING)
                    if open_ and not hangs:
                        number += 1
                    open_ = hangs is not None
                number += open_
            words = list(zip(*told)) or [()] * len(_NOTHING)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((docs, starts, ends, chains, *words), _KINDS)], _NAMES)

    parts = documents.select("doc_id", "text").mapInArrow(run, _UNITS)
    parts = written(parts)
    closed = parts.where(F.col("chain").isNull()).select("doc_id", "start_char", "end_char")
    return closed.unionByName(settled(parts.where(F.col("chain").isNotNull()), table))


def settled(chains: DataFrame, table: DataFrame | None) -> DataFrame:
    """Units of the chains: units joined where their open end is none by the evidence of its words."""
    ends = chains
    if table is not None:
        # only what is not known yet is looked up; the rest spreads
        words = table.where("final IS NOT NULL").select(F.col("word").alias("_w"), F.col("abbreviation").alias("_a"), (~F.col("final")).alias("_g"))
        nexts = table.where("ordinary IS NOT NULL").select(F.col("word").alias("_n"), F.col("ordinary").alias("_o"))
        ends = ends.withColumns({"_w": F.when(F.col("abbreviation").isNull(), F.col("word")), "_n": F.when(F.col("ordinary").isNull(), F.col("after"))})
        ends = left_lookup(left_lookup(ends, words, "_w"), nexts, "_n")
        ends = ends.withColumns({"abbreviation": F.coalesce("abbreviation", F.when(F.col("small"), F.col("_g")).otherwise(F.col("_a"))), "ordinary": F.coalesce("ordinary", "_o")})
    abbreviation = F.coalesce("abbreviation", F.col("listed") > 0)
    # what no word is told of, the last of a chain, closes a unit
    before_capital = ~abbreviation | F.coalesce("ordinary", F.lit(False)) | (F.col("listed") == 2)
    is_end = F.when(F.col("word").isNull(), True).when(F.col("small"), F.coalesce(~F.col("abbreviation"), F.length("word") > SHORT)).otherwise(before_capital)
    item = F.struct("start_char", "end_char", is_end.alias("is_end"))
    whole = ends.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(item)).alias("e"))
    places = F.sequence(F.lit(0), F.size("e") - 1)
    whole = whole.select("doc_id", "e", F.filter(places, lambda i: F.get("e", i)["is_end"] | (i == F.size("e") - 1)).alias("cuts"))
    unit = lambda cut, k: F.struct(F.get("e", F.coalesce(F.get("cuts", k - 1) + 1, F.lit(0)))["start_char"].alias("start_char"), F.get("e", cut)["end_char"].alias("end_char"))
    return whole.select("doc_id", F.inline(F.transform("cuts", unit)))
