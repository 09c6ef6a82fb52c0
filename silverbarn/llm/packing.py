"""Filling fixed-capacity containers: minimum bin slack over the histogram of lengths.

Texts of one length are interchangeable, so the packing is decided on the
histogram of lengths, which has at most ``capacity`` rows whatever the number
of texts. Per container a bitset subset-sum dynamic programme over the lengths
still available finds the fullest feasible combination that holds the longest
remaining text; the combination is removed as often as the histogram allows.
The texts then take their places by a distributed rank within their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silverbarn.session import cut_lineage

#: Vocabulary on the driver, which sends it to the executors.
TOKENIZER = os.environ.get("SILVERBARN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Split pattern of the public byte-level vocabularies; a fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Rows of one length that get their rank in one task.
RANK_ROWS = 200_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, capacity: int, encode, decode) -> list[tuple[int, int, int]]:
    """(start_char, end_char, tokens) of consecutive pieces within the capacity.

    A text that fits is one piece, the empty text one of no tokens. Of a longer
    text each piece is the longest prefix of whole characters that measures no
    more than the capacity by itself.
    """
    out, start = [], 0
    while True:
        # no more of the rest is encoded than a piece can hold, so the work is in proportion to the text
        wide = 4 * capacity
        while True:
            rest = text[start : start + wide]
            tokens = encode(rest)
            if len(tokens) > capacity + 16 or start + wide >= len(text):
                break
            wide *= 2
        if len(tokens) <= capacity and start + wide >= len(text):
            return [*out, (start, len(text), len(tokens))]
        take = capacity
        while True:
            size = max(1, len(decode(tokens[:take]).decode("utf-8", "ignore")))
            n = len(encode(rest[:size]))
            if n <= capacity or take <= 1:
                break
            take -= max(1, n - capacity)
        out.append((start, start + size, n))
        start += size


def _measure(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(SparkFiles.get(os.path.basename(path)))
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                for part, (a, b, n) in enumerate(pieces(text, capacity, enc.encode_ordinary, enc.decode_bytes)):
                    for col, value in zip(cols, (doc, part, a, b, n)):
                        col.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "part", "start_char", "end_char", "n_tokens"])

    return run


def measured(documents: DataFrame, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """The items to pack: every text, or every piece of a text longer than a container."""
    documents.sparkSession.sparkContext.addFile(path)
    return documents.select("doc_id", "text").mapInArrow(_measure(path, capacity), "doc_id bigint, part int, start_char int, end_char int, n_tokens int")


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The fullest combination of lengths that fits: bitset subset-sum with bounded copies.

    ``available`` holds (length, copies), longest first. Bit s of the bitset
    says that some combination has length s. Copies are added in powers of
    two; the bitset before each addition allows the way back. It stops as soon
    as the room can be filled without slack.
    """
    mask = (1 << (room + 1)) - 1
    bits, trail = 1, []
    for length, copies in available:
        if length > room:
            continue
        left, chunk = min(copies, room // length), 1
        while left > 0:
            use = min(chunk, left)
            trail.append((length, use, bits))
            bits |= (bits << (length * use)) & mask
            left -= use
            chunk *= 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {}
    for length, use, before in reversed(trail):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + use
            at -= length * use
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies in one container) and how many containers use each.

    Each container takes the longest remaining text and the fullest
    combination of the rest. A pattern repeats while every length lasts.
    Lengths are 1..capacity; the number of patterns depends on the number of
    distinct lengths, not on the number of texts.
    """
    left = {k: v for k, v in histogram.items() if v > 0 and k > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        head = order[0]
        left[head] -= 1
        pattern = fullest([(k, left[k]) for k in order if left[k]], capacity - head)
        left[head] += 1
        pattern[head] = pattern.get(head, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Which ranks of which length go where: rank r in [first, ...) of ``length`` sits in container base + (r - first) // copies."""
    rows, base, taken = [], 0, {}
    for pattern, times in patterns:
        for length, copies in pattern.items():
            rows.append((length, taken.get(length, 0), base, copies))
            taken[length] = taken.get(length, 0) + copies * times
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "copies"]).astype("int64").sort_values(["length", "first"])


def pack(documents: DataFrame, capacity: int = 2048, path: str = TOKENIZER) -> DataFrame:
    """(container_id, doc_id, part, start_char, end_char, n_tokens): every text in one container.

    Container ids count from 0. Empty and null texts measure nothing and go to
    the first containers, one each in turn. Repeated texts are items of their
    own. A text longer than a container is cut into pieces at characters; no
    other text is cut. The driver sees only the histogram of lengths (at most
    ``capacity`` rows) and the patterns made from it.
    """
    items = cut_lineage(measured(documents, capacity, path))
    counts = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["n_tokens"]: r["n"] for r in counts.collect()}
    patterns = minimum_bin_slack(histogram, capacity)
    slots = places(patterns)
    containers = max(1, sum(times for _, times in patterns))

    # ranks within a length: salted, so that a length holding a third of all texts spreads
    salts = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    cell = W.partitionBy("n_tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")).select("n_tokens", "salt", F.coalesce(F.sum("n").over(cell), F.lit(0)).alias("offset"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("n_tokens", "salt").orderBy("doc_id", "part")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))

    length, first, base, copies = (slots[c].to_numpy() for c in slots.columns)
    span = int(first.max()) + 1 if len(first) else 1
    if (capacity + 1) * span >= 2**62:
        span_key = None
    else:
        span_key = length * span + first

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("n_tokens").to_numpy().astype("int64"), batch.column("rank").to_numpy().astype("int64")
            out = rank % containers
            full = np.flatnonzero(n > 0)
            if len(full):
                if span_key is not None:
                    at = np.searchsorted(span_key, n[full] * span + np.minimum(rank[full], span - 1), "right") - 1
                else:
                    at = np.array([np.flatnonzero((length == a) & (first <= r))[-1] for a, r in zip(n[full], rank[full])])
                out[full] = base[at] + (rank[full] - first[at]) // copies[at]
            keep = [batch.column(c) for c in ("doc_id", "part", "start_char", "end_char", "n_tokens")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *keep], ["container_id", "doc_id", "part", "start_char", "end_char", "n_tokens"])

    wanted = ranked.select("doc_id", "part", "start_char", "end_char", "n_tokens", "rank")
    return wanted.mapInArrow(seat, "container_id bigint, doc_id bigint, part int, start_char int, end_char int, n_tokens int")
