"""Evaluation passages inside training text: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set held block by block; the corpus is only
scanned. Pass one counts in how many documents each n-gram of the items stands.
Pass two takes as seeds those that are rare, those of one family of near-equal
items or of a passage a few families share however often they are copied, and
the rarest one of every stretch of an item that has no other; it aligns each
seeded item with the part of the document around its seeds, word by word. Only
an n-gram that many documents and many families of items have is a stock phrase
and no seed. No pair of documents is formed and no document leaves its task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a seed.
SEED = 3
#: A seed is rare if at most this share of the documents (or RARE_DOCS of them) has it.
RARE_SHARE = 2e-4
RARE_DOCS = 8
#: A frequent n-gram of more families of items than this is a stock phrase.
FAMILIES = 8
#: Items are of one family if the words they have in common make up this part of the shorter one.
NEAR_EQUAL = 0.5
#: Alignment: gain of a matching word, loss of a replaced, added or missing one.
MATCH, REPLACED, GAP = 1.0, -1.2, -1.0
#: A leak holds a passage of about so many words, of which small edits change this part.
PASSAGE, EDITED = 20, 0.08
#: Least score of a leak: that of such a passage.
LEAST_SCORE = PASSAGE * (MATCH - EDITED * (MATCH - REPLACED))
#: Least distinct words of the item around its seeds; a passage of twenty repeats up to a third of its words.
LEAST_WORDS = PASSAGE * 2 // 3
#: Pairs aligned together.
PAIRS = 128
#: Words of items held by one scan; more items are scanned in blocks.
BLOCK_WORDS = 500_000

_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")
_BREAK = re.compile(r"(?<=\w)[-\u2010\u2011]\r?\n\s*(?=\w)")
#: Scripts written without blanks: every character counts as a word.
_SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_SOLID}]|[^\W{_SOLID}]+")


def words(text: str) -> list[str]:
    """Words without regard to typography, letter case, accents, soft hyphens and white space."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "-\n" in text or "\u2010\n" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.casefold())


def align(items: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Scores of the best local alignments of pairs of word-id arrays.

    All pairs advance together, one item word per step; a gap along the
    document is resolved by a running maximum. Pairs of like size go together.
    """
    out = np.zeros(len(items), np.float32)
    order = sorted(range(len(items)), key=lambda i: (len(docs[i]) // 64, len(items[i])))
    for at in range(0, len(order), PAIRS):
        some = order[at : at + PAIRS]
        n, m = max(len(items[i]) for i in some), max(len(docs[i]) for i in some)
        a, b = np.full((n, len(some), 1), -2, np.int32), np.full((len(some), m), -1, np.int32)
        for k, i in enumerate(some):
            a[: len(items[i]), k, 0] = items[i]
            b[k, : len(docs[i])] = docs[i]
        ramp = (-GAP * np.arange(m + 1)).astype(np.float32)
        score = np.zeros((len(some), m + 1), np.float32)
        best = np.zeros(len(some), np.float32)
        gain = np.array([REPLACED, MATCH], np.float32)
        for w in a:
            new = score + np.float32(GAP)
            np.maximum(new[:, 1:], score[:, :-1] + gain[(b == w).view(np.int8)], out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new += ramp
            np.maximum.accumulate(new, axis=1, out=new)
            new -= ramp
            np.maximum(best, new.max(1), out=best)
            score = new
        out[some] = best
    return out


class Items:
    """The test items as word ids, with the items of every seed. Items of equal words are one, known by its place."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        self.sets: dict[int, frozenset] = {}
        self.seeds: dict[tuple, list[int]] = defaultdict(list)
        self.same: dict[int, list[int]] = {}
        self.words: dict[int, list[str]] = {}
        place: dict[tuple, int] = {}
        for item_id, text in rows:
            w = words(text or "")
            item = place.setdefault(tuple(w), len(place))
            self.same.setdefault(item, []).append(item_id)
            if item in self.items:
                continue
            self.words[item] = w
            self.items[item] = np.array([self.ids.setdefault(x, len(self.ids)) for x in w], np.int64)
            self.sets[item] = frozenset(self.items[item].tolist())
            for g in set(zip(*(w[k:] for k in range(SEED)))):
                self.seeds[g].append(item)

    def families(self, often: list[tuple]) -> tuple[set[tuple], set[tuple]]:
        """(passages, stock phrases) among n-grams of many documents that several items have.

        An n-gram's items fall into families of near-equal ones, each compared
        with one item of every family so far. One family, or a few that have a
        passage in common: a passage. More than FAMILIES: a stock phrase,
        whatever they have in common. The rest is neither.
        """
        scores: dict[tuple[int, int], float] = {}
        passages, stock = set(), set()
        for g in often:
            heads: list[int] = []
            common = True
            for item in self.seeds[g]:
                new = [(h, item) for h in heads if (h, item) not in scores]
                if new:
                    found = align([self.items[a] for a, _ in new], [self.items[b] for _, b in new])
                    scores.update(zip(new, found.tolist()))
                if any(scores[h, item] >= NEAR_EQUAL * min(len(self.items[h]), len(self.items[item])) for h in heads):
                    continue
                common = common and all(scores[h, item] >= LEAST_SCORE for h in heads[:1])
                heads.append(item)
                if len(heads) > FAMILIES:
                    break
            if len(heads) > FAMILIES:
                stock.add(g)
            elif common:
                passages.add(g)
        return passages, stock

    def filled(self, keep: set[tuple], stock: set[tuple], df: dict[tuple, int]) -> set[tuple]:
        """``keep`` with the rarest n-gram of every stretch as long as a passage that has none; stock phrases apart."""
        more = set()
        for words_ in self.words.values():
            since: list[tuple] = []
            for g in zip(*(words_[k:] for k in range(SEED))):
                if g in keep:
                    since = []
                    continue
                since.append(g)
                if len(since) > PASSAGE - SEED:
                    open_ = [x for x in since if x not in stock and df.get(x)]
                    more.update(sorted(open_, key=lambda x: (df[x], x))[:1])
                    since = []
        return keep | more

    def narrowed(self, keep: set[tuple]) -> None:
        self.seeds = {g: i for g, i in self.seeds.items() if g in keep}


def grams(w: list[str]) -> zip:
    return zip(*(w[k:] for k in range(SEED)))


def candidates(text: str, held: Items, keys: frozenset) -> list[tuple[int, np.ndarray]]:
    """Seeded items with the word ids of the stretch of the text around their seeds."""
    w = words(text)
    found = keys.intersection(grams(w))
    if not found:
        return []
    at: dict[int, list[int]] = defaultdict(list)
    for k, g in enumerate(grams(w)):
        if g in found:
            for item in held.seeds[g]:
                at[item].append(k)
    ids = held.ids
    out = []
    for item, places in at.items():
        n = len(held.items[item])
        reach = n + n // 4
        lo, hi = places[0] - reach, places[0] + reach
        stretches = []
        for p in places[1:]:
            if p - reach <= hi:
                hi = p + reach
            else:
                stretches.append((lo, hi))
                lo, hi = p - reach, p + reach
        stretches.append((lo, hi))
        for lo, hi in stretches:
            part = [ids.get(x, -1) for x in w[max(0, lo) : hi]]
            if len(held.sets[item].intersection(part)) >= LEAST_WORDS:
                out.append((item, np.array(part, np.int32)))
    return out


def leaks(texts: list[tuple[int, str]], held: Items, keys: frozenset) -> list[tuple[int, int]]:
    """(item, document) of every text that contains a passage of an item."""
    pairs = [(item, doc, part) for doc, text in texts if text for item, part in candidates(text, held, keys)]
    if not pairs:
        return []
    scores = align([held.items[p[0]] for p in pairs], [p[2] for p in pairs])
    return sorted({(item_id, doc) for (item, doc, _), s in zip(pairs, scores) if s >= LEAST_SCORE for item_id in held.same[item]})


def _blocks(rows: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in rows:
        n = len((row[1] or "").split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    if block:
        yield block


def leaked(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(item_id, doc_id): the document contains a passage of the item.

    The items are read partition by partition and scanned in blocks of
    BLOCK_WORDS words, so the driver and a task hold one block at a time. Null
    and empty texts and rows without an id leak nothing; repeated documents are
    reported under each doc_id; repeated items under each item_id; extra
    columns are ignored.
    """
    rows = ((r["item_id"], r["text"]) for r in eval_items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator())
    documents = documents.where("doc_id is not null")
    out = None
    for block in _blocks(rows):
        part = _scan(documents, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.select(F.col("doc_id").alias("item_id"), "doc_id").where(F.lit(False))
    return out.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


def _scan(documents: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    held = Items(block)
    order = sorted(held.seeds)
    number = {g: i for i, g in enumerate(order)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        docs = 0
        every = frozenset(number)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs += 1
                if text:
                    tally.update(every.intersection(grams(words(text))))
        ids = [number[g] for g in tally]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *ids], pa.int64()), pa.array([docs, *tally.values()], pa.int64())], ["seed", "n"])

    counts = documents.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    df = {r["seed"]: r["n"] for r in counts.collect()}  # one row per n-gram of the block
    limit = max(RARE_DOCS, RARE_SHARE * df.get(-1, 0))
    keep = {g for i, g in enumerate(order) if 0 < df.get(i, 0) <= limit}
    often = [g for i, g in enumerate(order) if df.get(i, 0) > limit]
    passages, stock = held.families(often)
    keep = held.filled(keep | passages, stock, {g: df.get(i, 0) for i, g in enumerate(order)})
    held.narrowed(keep)
    keys = frozenset(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = leaks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), held, keys)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["item_id", "doc_id"])

    return documents.select("doc_id", "text").mapInArrow(scan, "item_id bigint, doc_id bigint")
