import random

import pytest
from pyspark.sql import functions as F

from silverbarn.llm import names as N


def test_bands_follow_the_collision_curve():
    b = N.bands(0.54, 0.92, 4)
    assert 1 - (1 - 0.54**4) ** b >= 0.92 > 1 - (1 - 0.54**4) ** (b - 1)
    grams = lambda w: set(zip("^" + w, w + "$"))
    for n in range(4, 13):
        a, z = grams("abcdefghijklm"[:n]), grams("ab" + "z" + "defghijklm"[: n - 3])
        assert abs(N.typo_similarity(n) - len(a & z) / len(a | z)) < 1e-9


@pytest.mark.parametrize("length", range(4, 13))
def test_recall_of_one_typing_error_by_length(length):
    rnd = random.Random(length)
    words = ["".join(rnd.choice(("bdfgklmnprstvz", "aeiou")[k % 2]) for k in range(length)) for _ in range(600)]
    wrong = []
    for w in words:
        k = rnd.randrange(length)
        wrong.append(w[:k] + rnd.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != w[k]]) + w[k + 1 :])
    hit = sum(bool((a[:n] == b[:n]).any()) for a, b in zip(N.all_bands(words), N.all_bands(wrong)) for n in [min(len(a), len(b))])
    assert hit / len(words) >= 0.92
    assert [N.word_bands(w) for w in words[:5]] == [x.tolist() for x in N.all_bands(words[:5])]


def test_lines_of_business_are_learnt(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(("bdfgklmnprstvz", "aeiou")[k % 2]) for k in range(8))
    rows = [(f"k{i}", f"l{i}", f"{word()} {word()} {('Fishing', 'Forestry')[i % 2]} Ltd", False) for i in range(100)]
    rows += [(f"h{i}", f"m{i}", f"Calmelter Bronman {word()[:3]} Ltd", False) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, link string, name string, person boolean")
    assert N.lines_of_business(df) == {"fishing", "forestry"}
    assert N.form("Brontel Fishing Co", None, frozenset({"fishing"}))[1] == "fishing#"
    more = [("a", "a", "Brontel Fishing Ltd", False), ("b", "b", "Brontel Forestry Ltd", False), ("c", "c", "Bronte1 Fishing", False)]
    assert {p for p in _pairs(spark, rows + more) if set(p) <= {"a", "b", "c"}} == {("a", "c")}


def test_forms_of_organisations():
    same = ["Bejardal Trirron Chemicals Development Ltd", "BEJARDAL TRIRRON CHEM. DEV, LIMITED", "Chems Development of Bejardal Trirron Ltd", "bejarda1 trirrón chemicals (The)", "BejardalTrirron Chem. Ltd /DE/", "Bejardal Trirron Chemicals Ltd & Subsidiaries - ADR"]
    forms = [N.form(s, None) for s in same]
    assert {(f[0], f[1], tuple(sorted(f[2]))) for f in forms} == {("org", "chemicals#", ("bejardal", "trirron"))}
    assert N.form("Bigelbin Robotics II CO", None)[1] == N.form("BIGELBIN ROBOTICS 2", None)[1] != N.form("Bigelbin Robotics I Co", None)[1]
    assert N.form(None, None) is None and N.form("  ", True) is None and N.form("!!", None) is None


def test_forms_of_persons():
    for s in ("Robert E. Golfesor", "GO1FESOR BOB E.", "Golfesor, Rob E", "Mr. Robert E Golfesor Ph.D."):
        assert N.form(s, None) == ("person", "", ["golfesor"], "robert", "e"), s
    assert N.form("Kolstupro, S.", True)[2:4] == (["kolstupro"], "s")
    assert N.form("A. H. Bralsirgir", None) == ("person", "", ["bralsirgir"], "a", "h")
    assert N.form("Elizabteh Colpirtum", None)[3] == "elizabeth"


def _stars(spark, edges):
    return {r.node: r.center for r in N.star_clusters(spark.createDataFrame(edges, "a bigint, b bigint, similarity double")).collect()}


def test_star_clusters_are_the_greedy_cover(spark):
    edges = [(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9), (4, 5, 0.8), (6, 7, 0.7)]
    assert _stars(spark, edges) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    assert _stars(spark, []) == {}


def _pairs(spark, rows):
    df = spark.createDataFrame(rows, "key string, link string, name string, person boolean").withColumn("party", F.lit(1))
    return {tuple(r) for r in N.party_pairs(df.select("key", "link", "name", "person")).collect()}


def test_variants_decoys_and_links(spark):
    rows = [
        ("a1", "a1", "Calmelter Bronman Shipping Ltd", False), ("a2", "a2", "CALMELTER BRONMAN SHIPPING LIMITED", False), ("a3", "a3", "Calmelter Shipping LTD", False), ("a4", "a4", "Shipping, Calmeltr Bronmna", False),
        ("b1", "b1", "Calmelter Bronman Mining Ltd", False), ("c1", "c1", "Calmelter Bronman Shipping II Ltd", False),
        ("p1", "p1", "Robert E. Golfesor", True), ("p2", "p2", "Golfesor, Bob", True), ("p3", "p3", "William L. Golfesor", True), ("p4", "p4", "Robert K. Golfesor", True),
        ("s1", "cik:1", "Zumvar Holpek Water Co", None), ("s2", "cik:1", "Quite Other Name Inc", None), ("s3", "cik:2", None, None), ("e1", "cik:2", None, None), ("n1", "n1", None, False),
        ("a1", "a1", "Calmelter Bronman Shipping Ltd", False),
    ]
    got = _pairs(spark, rows)
    assert {("a1", "a2"), ("a1", "a3"), ("a1", "a4"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4"), ("s1", "s2"), ("e1", "s3")} <= got
    assert not any("b1" in p or "c1" in p or "p3" in p or "n1" in p for p in got)
    assert len({("p1", "p2"), ("p2", "p4")} & got) == 1 and ("p1", "p4") not in got
    assert all(a < b for a, b in got)


def test_full_buckets_are_divided_without_loss(spark, monkeypatch):
    rows = [(f"k{i:03}", f"k{i}", f"Bretonia {w} Foods", False) for i, w in enumerate(f"{a}{b}{c}" for a in ("mir", "tol", "ven", "zul") for b in ("dra", "ken", "pos") for c in ("wix", "gar", "lum"))]
    rows += [(f"x{k[1:]}", f"x{k}", name.replace("Bretonia", "Bretomia"), False) for k, _, name, _ in rows]
    expected = {(k, "x" + k[1:]) for k, *_ in rows if k[0] == "k"}
    monkeypatch.setattr(N, "BUCKET", 8)
    monkeypatch.setattr(N, "LEAST", 0.85)
    assert expected <= _pairs(spark, rows)


def test_a_pair_that_shares_one_full_bucket_only_is_compared(spark, monkeypatch):
    word = "bretonia"
    own = set(enumerate(N.word_bands(word)))
    near = [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "aeiklmorstz" if c != word[i]]
    near += [w[:i] + c + w[i + 1 :] for w in near[::3] for i in range(len(w)) for c in "aeiou" if c != w[i]]  # and two errors
    near = sorted(set(near) - {word})
    once = [w for w in near if len(own & set(enumerate(N.word_bands(w)))) == 1][:40]
    assert len(once) > 5
    names = [[word], *([w] for w in once), *([word, f"{a}{b}{c}"] for a in ("mir", "tol", "ven") for b in ("dra", "ken", "pos") for c in ("wix", "gar", "lum"))]
    nodes = spark.createDataFrame([(i, "org", "#", w, "", "") for i, w in enumerate(names)], "node bigint, kind string, exact string, words array<string>, given string, middle string")
    bands = [{x for w in {*ws, "".join(ws)} for x in enumerate(N.word_bands(w))} for ws in names]
    shared = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if bands[i] & bands[j]]
    monkeypatch.setattr(N, "BUCKET", 8)
    linked = lambda pairs: {(r.a, r.b) for r in N.verified(nodes, pairs).collect()}
    got = linked(N.candidate_pairs(nodes))
    assert {(0, i) for i in range(1, len(once) + 1)} <= got
    assert got == linked(spark.createDataFrame(shared, "a bigint, b bigint"))


def test_a_third_of_all_records_under_one_name(spark):
    rows = [(f"h{i:03}", f"h{i}", "Calmelter Bronman Shipping Ltd", False) for i in range(60)] + [(f"o{i}", f"o{i}", f"Zz{chr(97 + i % 26) * 7}{i} Mining", False) for i in range(60)]
    assert sum(a[0] == b[0] == "h" for a, b in _pairs(spark, rows)) == 60 * 59 // 2
    assert _pairs(spark, []) == set()
