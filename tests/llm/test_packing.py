import itertools
import random

from silverbarn.llm import packing

DOCS = "doc_id bigint, text string"


def test_fullest_combination_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        have = sorted({rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(4)}.items(), reverse=True)
        room = rnd.randrange(5, 70)
        got = packing.fullest(have, room)
        assert all(n <= dict(have)[k] for k, n in got.items())
        sums = [sum(k * n for (k, _), n in zip(have, c)) for c in itertools.product(*(range(n + 1) for _, n in have))]
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_patterns_use_every_text_once():
    rnd = random.Random(2)
    histogram = {rnd.randrange(1, 90): rnd.randrange(1, 5000) for _ in range(60)}
    patterns = packing.minimum_bin_slack(histogram, 200)
    used = {}
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 200
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(t for _, t in patterns) <= total / 200 * 1.02 + 1
    assert packing.minimum_bin_slack({}, 10) == []


def test_pieces_are_whole_and_fit():
    enc = packing.tokenizer(packing.TOKENIZER)
    for text in ("", "short", "Zwölf Boxkämpfer " * 200, "市场回顾。" * 300, "x" * 5000, "a😀b" * 400):
        parts = packing.pieces(text, 64, enc.encode_ordinary, enc.decode_bytes)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert all(n == len(enc.encode_ordinary(text[a:b])) <= 64 for a, b, n in parts)
    assert len(packing.pieces("short", 64, enc.encode_ordinary, enc.decode_bytes)) == 1


def test_the_work_on_a_long_text_is_in_proportion_to_it():
    enc = packing.tokenizer(packing.TOKENIZER)
    seen = []
    count = lambda t: (seen.append(len(t)), enc.encode_ordinary(t))[1]
    text = "A sentence of some words, number 12. " * 20_000
    parts = packing.pieces(text, 512, count, enc.decode_bytes)
    assert "".join(text[a:b] for a, b, _ in parts) == text and sum(seen) < 6 * len(text)
    assert sum(n for *_, n in parts[:-1]) >= 0.98 * 512 * (len(parts) - 1)


def _packed(spark, rows, capacity=64):
    return packing.pack(spark.createDataFrame(rows, DOCS), capacity).collect()


def test_pack_holds_every_text_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 40)  # several salts
    rnd = random.Random(3)
    rows = [(i, " ".join(["word"] * rnd.randrange(0, 50))) for i in range(150)]
    rows += [(1000 + i, "same text again") for i in range(120)] + [(2000, None), (2001, ""), (2002, "long " * 500)]
    got = _packed(spark, rows)
    load, seen = {}, {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append(r)
    assert max(load.values()) <= 64 and set(seen) == {r[0] for r in rows}
    for doc, text in rows:
        assert "".join((text or "")[p.start_char : p.end_char] for p in sorted(seen[doc], key=lambda p: p.part)) == (text or "")
    assert all(len(p) == 1 for d, p in seen.items() if d != 2002)
    total = sum(load.values())
    assert len(load) <= -(-total // 64) + 1 and set(load) == set(range(len(load)))


def test_pack_nothing(spark):
    assert _packed(spark, []) == []
    assert [(r.container_id, r.n_tokens) for r in _packed(spark, [(1, None)])] == [(0, 0)]
