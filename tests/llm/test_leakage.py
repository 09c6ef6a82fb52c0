import random

import numpy as np

from silverbarn.llm import leakage as L

ITEM = (
    "The Pordran covenant test quietly defers the Ranwoje swap curve using the older Fententrin convention and explain the Morpindar effect. "
    "A hypothetical insurer stress-tests two callable tranches at the lower bound which reverses after 7209 months beside 8134 lots. Past performance is no guide to future results."
)
OTHER = "Suppose a custodian carries minority puts over 3779 equal instalments thereby doubling the Stigagin charge following Dolnirlum bonds. Past performance is no guide to future results."
DOC = "doc_id bigint, text string"


def brute(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (L.MATCH if x == y else L.REPLACED), h[i - 1][j] + L.GAP, h[i][j - 1] + L.GAP)
    return max(map(max, h))


def test_alignment_against_brute_force():
    rnd = random.Random(1)
    pairs = [([rnd.randrange(6) for _ in range(rnd.randrange(1, 25))], [rnd.randrange(6) for _ in range(rnd.randrange(1, 60))]) for _ in range(60)]
    got = L.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert np.allclose(got, [brute(a, b) for a, b in pairs], atol=1e-3)


def _found(spark, docs, items=((1, "en", ITEM), (2, "en", OTHER))):
    d = spark.createDataFrame(docs, DOC).selectExpr("*", "0 AS item_id", "0 AS seed")
    return {tuple(r) for r in L.leaked(d, spark.createDataFrame(list(items), "item_id bigint, lang string, text string")).collect()}


def test_copies_edits_and_parts(spark):
    w = ITEM.split()
    edited = list(w[3:30])
    edited[5], edited[12] = "branch", "roughly"
    del edited[17]
    docs = [
        (1, "Before. " + ITEM + " After."),
        (2, "Before. " + " ".join(edited).upper().replace("E", "é") + " after."),
        (3, "x­ " + "\n".join(w[2:28]).replace("insurer", "in­surer")),
        (4, "This one says: past performance is no guide to future results. Nothing more."),
        (5, "It mentions the Morpindar effect and the Ranwoje swap curve only."),
        (6, "A hypothetical insurer stress-tests minority puts at the lower bound which reverses after 11 months beside 12 bonds."),
        (7, None), (8, ""), (None, ITEM), (9, "word " * 60_000 + OTHER), (10, ITEM), (11, ITEM),
    ]
    assert _found(spark, docs) == {(1, 1), (1, 2), (1, 3), (2, 9), (1, 10), (1, 11)}


def test_an_item_copied_into_a_third_of_all_documents_is_found_everywhere(spark):
    docs = [(i, (ITEM if i % 3 == 0 else "Nothing of note happened today.") + f" Number {i}.") for i in range(300)]
    assert _found(spark, docs) == {(1, i) for i in range(0, 300, 3)}


def test_a_repeated_item_copied_into_a_third_of_all_documents_is_found_under_each_id(spark):
    docs = [(i, (ITEM if i % 3 == 0 else "Nothing of note happened today.") + f" Number {i}.") for i in range(300)]
    items = ((1, "en", ITEM), (2, "en", OTHER), (3, "en", ITEM.upper()))
    assert _found(spark, docs, items) == {(k, i) for i in range(0, 300, 3) for k in (1, 3)}


def test_a_paragraph_of_two_items_is_found_and_a_stock_phrase_of_two_is_not(spark):
    shared = " ".join(ITEM.split()[:24])
    items = ((1, "en", shared + " Settlement follows on the ninth day. " + OTHER[-52:]), (2, "en", "Quite another opening about municipal sewers. " + shared), (3, "en", OTHER))
    docs = [(i, (shared if i % 3 == 0 else "Nothing of note. " + OTHER[-52:]) + f" Number {i}.") for i in range(300)]
    assert _found(spark, docs, items) == {(k, i) for i in range(0, 300, 3) for k in (1, 2)}


def test_many_near_equal_items_are_one_family(spark):
    items = tuple((k, "en", ITEM.replace("8134", str(9000 + k)).replace("Morpindar", f"Morpindar{k}")) for k in range(12))
    docs = [(i, (ITEM if i % 3 == 0 else "Nothing of note happened today.") + f" Number {i}.") for i in range(120)]
    assert _found(spark, docs, items) == {(k, i) for i in range(0, 120, 3) for k in range(12)}


def test_a_stock_phrase_of_many_items_is_none_however_long(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    phrase = " ".join(word() for _ in range(26))
    items = tuple((k, "en", " ".join(word() for _ in range(40)) + " " + phrase) for k in range(12))
    docs = [(i, f"Number {i}. " + phrase) for i in range(60)] + [(100, items[3][2][:200])]
    assert _found(spark, docs, items) == {(3, 100)}


def test_recall_and_precision_on_held_out_edits(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(3, 9))) for _ in range(4000)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = tuple((k, "en", " ".join(some(60))) for k in range(40))
    docs, true = [], set()
    for i in range(400):
        k = rnd.randrange(40)
        w = items[k][2].split()
        n = rnd.randrange(22, 40) if i % 2 else rnd.randrange(4, 11)
        at = rnd.randrange(60 - n)
        part = [rnd.choice(vocabulary) if rnd.random() < 0.05 else x for x in w[at : at + n]]
        docs.append((i, " ".join(some(30) + part + some(30))))
        if i % 2:
            true.add((k, i))
    got = _found(spark, docs, items)
    assert len(got & true) >= 0.97 * len(true) and got <= true


def test_scripts_without_blanks(spark):
    zh = "该基金第三季度回购百分之十三的股份并维持全年盈利目标不变同时任命新的首席财务官"
    assert L.words("ab 基金ก1") == ["ab", "基", "金", "ก", "1"]
    assert _found(spark, [(1, "前言。" + zh[:30] + "完。"), (2, "该基金今天停牌。")], ((1, "zh", zh),)) == {(1, 1)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = [(1, ITEM), (2, OTHER), (3, ITEM + OTHER)]
    monkeypatch.setattr(L, "BLOCK_WORDS", 10)
    assert _found(spark, docs) == {(1, 1), (2, 2), (1, 3), (2, 3)}


def test_empty_tables(spark):
    assert _found(spark, []) == set()
    assert _found(spark, [(1, ITEM)], [(1, "en", None), (None, "en", ITEM)]) == set()
