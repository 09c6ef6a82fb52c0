import pytest

from silverbarn.llm import sentences as S

STARTERS = frozenset({"the", "our", "management", "die", "der", "dr"})
KNOWN = S.Evidence(abbreviations=frozenset({"ref", "ff"}), ordinary=STARTERS - {"dr"}, starters=STARTERS)
CASES = [
    ["Dr. Mora named T. A. Vell as chief.", "The fund sold 3.5 shares at 4 p.m. on Oct. 5, 2021.", "Trading resumed."],
    ["It bought Hob Corp. for cash.", "The buyer was Hob Insurance Corp.", "Our desk cut the outlook by 3.1%.", "720 homes were sold."],
    ["“We see no change,” said L. D. Trot.", "Will it buy?", "“Will it buy?” asked analysts.", "Vell told analysts: “Margins held. We will keep buying.”", "The rest follows."],
    ["The offer (it expired on Oct. 5, 2021.) was not renewed.", "(See also the note.)", "The exchange closed."],
    ["Volume rose to 71.8 lots ... and then stopped.", "iGis funds were not affected.", "Aal v. Bor was heard on Sept. 20."],
    ["Im 1. Quartal sank die Marge, d. h. ca. 4 % weniger als 2018.", "Die Börse buchte Mieten, Zinsen usw. neu.", "Am 16. August stieg sie.", "Vgl. Nr. 2.", "Der Kurs fiel."],
    ["Selon l’art. 6 des statuts, le conseil statue seul.", "Pourquoi le volume a-t-il chuté ?", "« Nous maintenons le dividende », a déclaré M. Nub."],
    ["¡La emisión quedó cubierta!", "Según la pág. 3, sube a 98,1 euros.", "El Dr. Gag lo niega."],
    ["См. п. 7 ст. 2 устава.", "Отчёт опубликован 5 мая 2026 г. и исправлен.", "Завод в г. Pel закрыт за 2019 г.", "Рынок вырос."],
    ["Θα φτάσει η τιμή τα 28.02 ευρώ;", "Ο κ. Del αποχωρεί, π.χ. αύριο.", "Βλ. σημ. 4 για την Klo."],
    ["هل يصل السعر إلى 209.05؟", "قال د. Lum إن التوزيعات باقية.", "رفض المجلس العرض!"],
    ["डॉ. Nez ने कहा कि मांग कमज़ोर है।", "क्या भाव घटेगा?", "बिक्री 809 तक गिरी।"],
]


@pytest.mark.parametrize("units", CASES)
def test_spaced_scripts(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in S.sentence_units(text, KNOWN)] == units


def test_scripts_without_blanks():
    units = ["董事长表示：“我们维持分红。明年不会裁员。”", "收盘价上涨24.63%！", "为什么？"]
    text = "".join(units)
    assert [text[a:b] for a, b in S.sentence_units(text)] == units
    units = ["社長は「配当は維持する。減らさない。」と述べた。", "終値は27.87%上昇した。"]
    text = "".join(units)
    assert [text[a:b] for a, b in S.sentence_units(text)] == units
    text = "ปริมาณอยู่ที่ 29.2 ล็อต หุ้นกู้ครบกำหนดวันที่ 2016-04-14 ราคาลดลง 17.62% ตลาดปิด"
    assert [text[a:b] for a, b in S.sentence_units(text)] == ["ปริมาณอยู่ที่ 29.2 ล็อต", "หุ้นกู้ครบกำหนดวันที่ 2016-04-14", "ราคาลดลง 17.62%", "ตลาดปิด"]


def test_lines_headings_and_items():
    text = "Item 1. Legal Proceedings\nThe provider merged two share classes at the request of the\nU.S. regulator. It left.\n• Management named K. J. Men\n(2) closing price rose\n\n9. Outlook for Men\nDone.Management left."
    got = [text[a:b] for a, b in S.sentence_units(text, KNOWN)]
    assert got == ["Item 1. Legal Proceedings", "The provider merged two share classes at the request of the\nU.S. regulator.", "It left.", "• Management named K. J. Men", "(2) closing price rose", "9. Outlook for Men", "Done.", "Management left."]


def test_lost_capitals():
    text = "the fund sold at 10:31 p.m. after talks failed. the board left at 4 p.m. the exchange closed, e.g. today."
    assert [text[a:b] for a, b in S.sentence_units(text, KNOWN)] == ["the fund sold at 10:31 p.m. after talks failed.", "the board left at 4 p.m.", "the exchange closed, e.g. today."]


def test_document_shows_its_own_abbreviations():
    text = "The abt. unit and the abt. desk agreed with abt. Mirra. Nothing else."
    assert [text[a:b] for a, b in S.sentence_units(text)][-1] == "Nothing else." and len(S.sentence_units(text)) == 2


@pytest.mark.parametrize(
    "units",
    [
        ["The answer was no.", "The board met again."],
        ["This is state of the art.", "We use it, as we said."],
        ["They chose plan B.", "The fund sold its shares."],
        ["She saw the fig.", "The tree grew over the fig tree."],
        ["He met Prof.", "The meeting with Prof. Vell and Dr. Mora was short."],
        ["“" + "We hold on. " * 80 + "We do not sell.” said the chair.", "The rest follows."],
        ["The notes (" + "these ran on. " * 60 + "they end) were read.", "Nothing else."],
    ],
)
def test_evidence_comes_before_lists(units):
    text = " ".join(units)
    known = S.Evidence(ordinary=frozenset({"the", "we"}))
    assert [text[a:b] for a, b in S.sentence_units(text, known)] == units


def test_lists_may_be_empty_where_there_is_evidence(spark, monkeypatch):
    rows = [(i, f"Ask Dr. Vell{'abcdefghij'[i % 10]} on Oct. {i % 28 + 1} about the rule. The doctor of the day met the board, approx. four of them. Later the Dr. wrote to Prof. Mora et al. in May.") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(tuple(r) for r in S.split_sentences(df).collect())
    monkeypatch.setattr(S, "ENDINGS", frozenset())
    monkeypatch.setattr(S, "TITLES", frozenset({"dr", "prof"}))
    assert sorted(tuple(r) for r in S.split_sentences(df).collect()) == whole and len(whole) == 180


def test_rare_words_are_settled_by_the_join(spark, monkeypatch):
    rows = [(i, f"The xyzw. unit of Vell met the xyzw. unit. We left it to them. Number {i}.") for i in range(3)]
    rows += [(10 + i, "It came from the xyzw. Grenda left. It was Prof. Grenda that left. What of it.") for i in range(3)]
    rows += [(20, "The word was quvu. It ended."), (21, "See quvu and quvu."), (22, ""), (23, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(tuple(r) for r in S.split_sentences(df).collect())
    monkeypatch.setattr(S, "SHARE", 2.0)  # no word is frequent
    rare = sorted(tuple(r) for r in S.split_sentences(df).collect())
    assert rare == whole
    text = rows[3][1]
    assert [text[a:b] for d, a, b in rare if d == 10] == ["It came from the xyzw. Grenda left.", "It was Prof. Grenda that left.", "What of it."]


def test_units_cover_all_text_and_are_trimmed():
    text = " \n\xa0 Odd  “unbalanced (text. And more\t\n\n\n...\n!? " * 30
    units = S.sentence_units(text)
    covered = set()
    for a, b in units:
        assert a < b and text[a:b] == text[a:b].strip() and not covered & set(range(a, b))
        covered |= set(range(a, b))
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)


def test_spark_rows(spark):
    rows = [(1, "One ends here. Two follows."), (2, "One ends here. Two follows."), (3, ""), (4, None), (5, " \n "), (6, "x " * 100_000 + "end. New one.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS start_char", "'x' AS word")
    got = sorted(tuple(r) for r in S.split_sentences(df).collect())
    assert got == [(1, 0, 14), (1, 15, 27), (2, 0, 14), (2, 15, 27), (6, 0, 200004), (6, 200005, 200013)]
    assert S.split_sentences(df.limit(0)).count() == 0


def test_evidence_over_all_documents(spark):
    rows = [(i, f"Ask the abcd. desk today. Management left the room. Later the xyzw. team came. Management agreed. Number {i}.") for i in range(40)]
    known = S.corpus_evidence(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {"abcd", "xyzw"} <= known.abbreviations and "management" in known.starters
