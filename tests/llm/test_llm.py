"""Small cases of the operators of the subpackage llm, against brute force where there is one."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomry.llm import canonical, components, encoding, langid, matching, mixing, scans, survivors
from fathomry.shared import Scratch

PAIRS = "left_index long, right_index long, similarity double, group_id string, u long"


def brute_groups(pairs, threshold):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, s in pairs:
        if a is not None and b is not None and a != b and s is not None and s == s and s >= threshold:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(find(x), x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "mixed chain", "odd", "empty"])
def test_merge_groups(spark, kind):
    rng = random.Random(kind)
    ids = list(range(300))
    rng.shuffle(ids)
    pairs = {
        "random": [(rng.randint(0, 300), rng.randint(0, 300), rng.choice([0.5, 0.9, 0.95, 1.0])) for _ in range(300)],
        "chain": [(i, i + 1, 0.9) for i in range(300)],
        "mixed chain": [(ids[i], ids[i + 1], 0.9) for i in range(299)],
        "star": [(0, i, 1.0) for i in range(300)] + [(i, 0, 1.0) for i in range(0, 300, 7)],
        "odd": [(None, 1, 0.9), (1, None, 0.9), (2, 2, 1.0), (3, 4, None), (3, 4, float("nan")), (5, 6, 1.0000001), (6, 5, 0.9), (7, 8, 0.8999)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pairs], PAIRS)
    got = [tuple(r) for r in components.merge_groups(df, 0.9).select("group_id", "row_index").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_groups(pairs, 0.9)


REFERENCE = [("a", "Doom forecasting", "e1"), ("a", "gloom casting", "e1"), ("a", "Steward's burden", "e2"), ("b", "loyal heart", "e3"), ("a", "loyal heart", "e4"), ("a", "Creeping request", "e5")]
TYPED = [
    ("a", "doom forecasting", "e1"), ("a", " DOOM_FORECASTING technique ", "e1"), ("a", "Forecasting, Doom", "e1"), ("a", "12) use of doom  forecastign", "e1"), ("a", "Dооm fоrecasting", "e1"), ("a", "dóom forecasting (general)", "e1"),
    ("a", "stewards burden", "e2"), ("a", "stwrds brdn", "e2"), ("b", "Loyal Heart / other", "e3"), ("a", "LoyalHeart", "e4"), ("a", "crpng request", "e5"), ("a", "the creeping reqeust device", "e5"),
    ("a", "weather forecasting", "UNMATCHED"), ("b", "doom forecasting", "UNMATCHED"), (None, "doom forecasting", "UNMATCHED"), ("a", "!!!", "UNMATCHED"), ("a", "x" * 20_000, "UNMATCHED"),
]


@pytest.mark.parametrize("held_names", [1000, 0])
def test_map_records(spark, held_names):
    rows = [(i, g, n, "clash") for i, (g, n, _) in enumerate(TYPED)] + [(100, "a", None, ""), (101, "a", "  ", ""), (0, *TYPED[0][:2], "clash")]
    df = spark.createDataFrame(rows, "row_index long, category string, display_name string, entry string")
    reference = spark.createDataFrame(REFERENCE, "group string, name string, entry string")
    got = {r.row_index: r.entry for r in canonical.map_records(df, reference, "row_index", "display_name", F.col("category"), held_names).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(TYPED)}
    assert canonical.map_records(df.limit(0), reference, "row_index", "display_name", F.col("category")).count() == 0


def test_distance():
    assert canonical.distance("abc", "abc") == 0
    assert canonical.distance("abdc", "abcd") == 0.7
    assert canonical.distance("leter", "letter") == 0.5
    assert canonical.distance("xyz", "aaaaaaaaaa") == float("inf")


def test_title_and_author_keys():
    full, main, sequel, has_sub, words = matching.title_parts("<i>Moral pleas &amp; the Speech</i> - a panel study: II.")
    assert (full, main, sequel, has_sub) == ("moral pleas and the speech a panel study", "moral pleas and the speech", "part 2", True)
    assert matching.title_parts("X of Y, part two")[2] == "part 2" and matching.title_parts("X (second study)")[2] == "study second"
    assert matching.title_parts(None)[0] is None and matching.title_parts("!?")[0] is None
    for author in ("S. Wamar", "Wamar, S.", "Wamar S", "Wamar SS & Other T", "WAMAR and others", "Sefa Wamar", "Wamar", "S. Wamar et al.", "Wamár, Sefa T."):
        assert matching.first_surname(author) == "wamar", author
    assert matching.first_surname(None) is None and matching.first_surname(" ") is None


CANDIDATES = "pos long, dup_group long, title string, authors array<string>, year int, doi string, id string, rule string"
REFS = "ref_id long, cited_title string, cited_authors string, cited_year string, cited_doi string, entity string"


def test_match_references(spark):
    t = "Moral pleas and the early speech: a panel study of urban letters"
    candidates = [
        (1, 1, t, ["Sefa Wamar"], 2001, "10.5555/a", "", ""), (2, 1, "Moral pleas and the early speech", ["Wamar, S."], None, None, "", ""), (3, None, t + ": II", ["S. Wamar"], 2002, "10.5555/b", "", ""),
        (4, None, "Preface", ["A. Borgund"], 1990, None, "", ""), (5, None, "Preface", ["C. Dornik"], 1990, None, "", ""), (6, None, None, None, None, None, "", ""), (7, None, "", [], 1999, "n/a", "", ""), (8, 9, "Group praise in dense surveys: limits of late memos", [], 2010, "", "", ""),
    ]
    refs = [
        (10, t.upper(), "WAMAR", "(2001)", None, ""), (11, "Moral pleas & the earyl speech: a panel stdy of urban letters", "Wamar S & Other T", "2002", None, ""), (12, t + " (second study)", "S. Wamar", "2002", None, ""), (13, t + ", part two", "S. Wamar", "2002", None, ""),
        (14, "Preface", "C. Dornik", "'90", None, ""), (15, "Preface", "E. Other", "1990", None, ""), (16, None, None, None, None, ""), (17, "Quite another thing", "S. Wamar", "2001", "https://doi.org/10.5555/A", ""), (18, "Group praise in dense surveys: limits of late memos", "Q. Unknown", "2010", None, ""),
        (19, "moral pleas and the early speech", "Wamra, S.", "2001", None, ""), (10, t.upper(), "WAMAR", "(2001)", None, ""),
    ]
    got = matching.match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(candidates, CANDIDATES))
    assert {(r.pos, r.ref_id) for r in got.collect()} == {(1, 10), (2, 10), (1, 11), (2, 11), (3, 13), (5, 14), (8, 18), (1, 19), (2, 19)}
    assert all(0 < r.confidence < 1 for r in got.collect())
    assert matching.match_references(spark.createDataFrame([], REFS), spark.createDataFrame(candidates, CANDIDATES)).count() == 0
    assert matching.match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame([], CANDIDATES)).count() == 0


def test_pairs_of_misspelt_titles(spark):
    right = "Quiet letters from distant harbours and narrow valleys before winter"
    typed = "Quiet letters from distant habours and narow valleys befre winter"
    once = ["distant habours", "habours narow", "narow valleys", "valleys befre", "befre winter"]
    candidates = [(1, None, right, ["S. Wamarson"], 2001, None, "", "")] + [(10 + i, None, f"Other {x} study of {i} things", ["S. Wamarlong"], 2001, None, "", "") for i, x in enumerate(once)]
    candidates += [(20 + i, None, f"{x} number {i} of them all", ["T. Other"], 1990, None, "", "") for i, x in enumerate(["Quiet letters", "Letters distant"] * 3)]
    refs = [(1, typed, "S. Wamarsen", "2001", None, "")]
    got = matching.match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(candidates, CANDIDATES))
    assert [(r.pos, r.ref_id) for r in got.collect()] == [(1, 1)]


def test_narrow_rules(spark):
    titles = ["Quiet letters from distant harbours and narrow valleys", "Seven bridges over muddy rivers after heavy rain", "Several gardens behind broken walls near old towns", "Painted ships within frozen lakes under grey skies"]
    authors = ["Dornikar", "Krevambak", "Bendique", "Prilmaamor"]
    candidates = [(i, None, t, [f"S. {a}"], 2001, None, "", "") for i, (t, a) in enumerate(zip(titles, authors))] + [(10, None, "Editorial", ["A. Sole"], 1990, "10.5555/e", "", ""), (11, None, "Preface", ["A. Sole"], 1990, "10.5555/v", "", "")]
    candidates += [(100 + i, None, f"Chapter of {i} things", ["A. Sole"], 1990, "10.5555/v", "", "") for i in range(60)]
    typed = ["Quiet leters from distant harbours and narrow valleys", "Seven brdges over muddy rivers after heavy rain", "Several gardns behind broken walls near old towns"]
    refs = [(0, typed[0], "S. Bornikar", "2001", None, ""), (1, typed[1], None, "2001", None, ""), (2, typed[2], "S. Vendiquo", "2001", None, ""), (3, "Editoral", "B. Else", "1991", "10.5555/e", ""), (4, "Preface", "B. Else", "1991", "10.5555/v", "")]
    got = matching.match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(candidates, CANDIDATES))
    assert {(r.pos, r.ref_id) for r in got.collect()} == {(0, 0), (1, 1), (2, 2), (10, 3), (11, 4)}
    assert matching.first_surname("S. Wamar und andere") == "wamar" and matching.first_surname("ludwig van wamar") == "wamar"


def test_hot_keys_change_nothing(spark, monkeypatch):
    """Keys that many rows share are joined with more attributes; the result is the same as if no key or every key were so."""
    rng = random.Random(4)
    words = "quiet letters distant harbours narrow valleys winter bridges muddy rivers heavy rain gardens broken walls towns".split()
    names = ["Dornikar", "Krevambak", "Bendique", "Prilmaamor", "Ti", None]

    def typo(text):
        i = rng.randrange(len(text))
        return text[:i] + rng.choice("abcde") + text[i + 1 :] if rng.random() < 0.5 else text

    candidates, refs = [], []
    for i in range(120):
        title = "Of " + " ".join(rng.sample(words, 6)) + (": a panel study" if rng.random() < 0.3 else "")
        name, year, doi = rng.choice(names), rng.randint(2000, 2002), rng.choice([None, "10.5555/v", f"10.5555/{i}"])
        candidates.append((i, rng.choice([None, None, i // 10]), title, [f"S. {name}"] if name else None, year, doi, "", ""))
        if rng.random() < 0.6:
            refs.append((i, typo(title.split(":")[0] if rng.random() < 0.3 else title), f"S. {typo(name)}" if name and rng.random() < 0.9 else None, str(year), doi if rng.random() < 0.5 else None, ""))
    found = []
    for few in (0, 50, 10**9):
        monkeypatch.setattr(matching, "FEW", few)
        got = matching.match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(candidates, CANDIDATES))
        found.append({(r.pos, r.ref_id, r.rule, round(r.confidence, 9)) for r in got.collect()})
    assert len(found[0]) > 40 and found[0] == found[1] == found[2]


def test_hot_keys_without_shared_words(spark, monkeypatch):
    """Near titles that share no word match by the author and year or by the DOI, whether few rows have these or many."""
    right, typed = "The colour of labour and of armour", "The color of labor and of armor"
    candidates = [(1, None, right, ["S. Wamarson"], 2001, None, "", ""), (2, None, "Behaviour favours", None, None, "10.5555/v", "", ""), (3, None, "Flavours: harbours within", None, None, "10.5555/v", "", "")]
    other = ["Winter", "Rivers", "Gardens", "Bridges", "Towns"]
    candidates += [(100 + i, None, f"Chapter {other[i % 5]} {i} things", [f"S. {'Wamarson' if i % 2 else 'Wamarler'}"], 2001, None, "", "") for i in range(140)]
    candidates += [(300 + i, None, f"Chapter {other[i % 5]} {i} things", None, None, "10.5555/v", "", "") for i in range(60)]
    refs = [(1, typed, "S. Wamarsen", "2001", None, ""), (2, "Behavior favors", None, None, "10.5555/v", ""), (3, "Flavors", None, None, "10.5555/v", "")]
    for few in (50, 0, 10**9):
        monkeypatch.setattr(matching, "FEW", few)
        got = matching.match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(candidates, CANDIDATES))
        assert {(r.pos, r.ref_id, r.rule) for r in got.collect()} == {(1, 1, "year, near first author, near title"), (2, 2, "doi, near title"), (3, 3, "doi, near title")}, few


def test_further_keys_lose_nothing(spark):
    """Near surnames share a delete, titles of near length a span."""
    rng = random.Random(5)
    rows = []
    for i in range(800):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(5, 12)))
        other = name
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(other))
            other = other[:k] + rng.choice(["", "d", "da", other[k : k + 1] + "d"]) + other[k + 1 :]
        n = rng.randint(1, 80)
        rows.append((i, name, other, n, rng.randint(1, n), rng.randint(1, 80), rng.random() < 0.5, rng.random() < 0.5))
    rows = spark.createDataFrame(rows, "i int, a string, b string, n int, h int, m int, s boolean, z boolean")
    names = [rows.selectExpr("i", f"{c} AS surname").selectExpr("i", "surname", f"{matching.surname_deletes()} AS k") for c in "ab"]
    near = names[0].alias("l").join(names[1].alias("r"), "i").where("length(l.surname) >= 5 AND length(r.surname) >= 5 AND levenshtein(l.surname, r.surname) <= 2")
    assert near.count() > 400 and near.where("NOT arrays_overlap(l.k, r.k)").count() == 0
    for share in (0.15, 0.25):
        left = rows.selectExpr("i", "repeat('a', n) AS full", "repeat('a', h) AS main", "s AS has_sub").selectExpr("*", f"{matching.length_marks(False, share)} AS k")
        right = rows.selectExpr("i", "repeat('a', m) AS full", "repeat('a', least(h, m)) AS main", "z AS has_sub").selectExpr("*", f"{matching.length_marks(True, share)} AS k")
        pairs = left.alias("l").join(right.alias("r"), F.expr("abs(l.i - r.i) < 20")).where(matching._gap(f"{share}D") + " IS NOT NULL")
        assert pairs.count() > 1000 and pairs.where("NOT arrays_overlap(l.k, r.k)").count() == 0


def test_titles_are_read_once(spark):
    """Each table's titles go through Python once, and no array is made twice to see whether it is empty."""
    plans = {}

    class Kept(Scratch):
        def keep(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().keep(df, name)

    t = "Moral pleas and the early speech of urban letters"
    candidates = spark.createDataFrame([(1, None, t, ["S. Wamar"], 2001, "10.5555/a", "", ""), (2, None, None, None, None, None, "", "")], CANDIDATES)
    refs = spark.createDataFrame([(10, t, "WAMAR", "(2001)", None, ""), (11, None, None, None, None, "")], REFS)
    got = matching.match_references(refs, candidates, Kept(spark)).select("pos", "ref_id").collect()
    assert [tuple(r) for r in got] == [(1, 10)]
    assert plans["left"].count("ArrowEvalPython") == plans["right"].count("ArrowEvalPython") == 1
    assert not [n for n, plan in plans.items() if "(size(array_distinct(zip_with" in plan or "(size(transform(" in plan]


def test_gap_without_common_ends(spark):
    """What titles begin and end with doesn't count: the same distances as of the whole titles."""
    rng = random.Random(8)
    rows, letters = [], "aab é字"
    for i in range(1500):
        full = "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))
        other = full
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(other))
            other = other[:k] + rng.choice(["", "c", "ab", other[:k][-5:]]) + other[k + rng.randint(0, 2) :]
        cut = rng.randint(1, len(full))
        rows.append((i, full, full[:cut], rng.random() < 0.5, other, other[: rng.choice([cut, cut + 1, len(other)])], rng.random() < 0.5, rng.random() < 0.9))
    side = lambda *names: "struct(" + ", ".join(f"{n} AS {as_}" for n, as_ in zip(names, ("full", "main", "has_sub"), strict=True)) + ")"
    met = spark.createDataFrame(rows, "i int, a string, am string, asub boolean, b string, bm string, bsub boolean, ok boolean").selectExpr("i", "ok", f"{side('a', 'am', 'asub')} AS l", f"{side('b', 'bm', 'bsub')} AS r")
    for limit in ("0.25D", "0.15D", "CASE WHEN l.has_sub THEN 0.3D ELSE 0.2D END"):
        whole = {(r.i, r.gap) for r in met.selectExpr("i", f"CASE WHEN ok THEN {matching._gap(limit)} END AS gap").where("gap IS NOT NULL").collect()}
        got = {(r.i, r.gap) for r in matching._with_gap(met, limit, "ok", "i").where("gap IS NOT NULL").collect()}
        assert len(whole) > 400 and got == whole, limit


def test_survivors(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, 1, "A whole one.", "Full Venue", ["crossfile"], ["https://a.b/c", None, "#"], at, "clash"), (2, 1, "A whole one, cut...", "Full...", ["web_search"], ["/x.pdf"], at, ""), (3, 1, "N/A", None, None, None, None, ""),
        (4, 2, "One (more)", "unknown", [], [], at, ""), (5, 2, "[Abstract unavailable]", "-", ["x"], None, at, ""), (6, 3, "Equal.", "full  venue", ["a"], ["http://x.y"], at, ""), (7, 3, "Equal.", "Full Venue", ["a"], ["http://x.y"], at, ""), (8, None, "No group.", None, None, None, at, ""),
        (9, 4, "x" * 50_000 + ".", None, None, None, at, ""),
    ]
    df = spark.createDataFrame(rows, "pos long, dup_group long, abstract string, venue string, source_apis array<string>, candidate_pdf_urls array<string>, loaded_at timestamp, full_venue_ string")
    venues = spark.createDataFrame([(1, "Full Venue"), (2, None)], "venue_id long, venue_name string")
    got = {r.dup_group: r for r in survivors.candidate_survivors(df, venues).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].abstract, got[1].abstract_pos, got[1].venue, got[1].candidate_pdf_urls, got[1].source_apis) == ("A whole one.", 1, "Full Venue", ["https://a.b/c"], ["crossfile", "web_search"])
    assert (got[2].abstract, got[2].abstract_whole, got[2].venue, got[2].candidate_pdf_urls) == ("One (more)", 0, None, [])
    assert (got[3].abstract_pos, got[3].abstract_whole) == (6, 2)
    fields = survivors.candidate_fields()
    best = survivors.survivors(survivors.with_venues(df, venues), fields, "dup_group", survivors.source_rank(F.col("source_apis")), "loaded_at", "pos")
    assert {tuple(r) for r in survivors.sole_values(best, [f.name for f in fields]).collect()} == {(1, "abstract", 1), (1, "venue", 1), (1, "candidate_pdf_urls", 1), (4, "abstract", 9)}
    assert survivors.candidate_survivors(df.limit(0), venues).count() == 0


CHUNKS = "chunk_id string, paper_id string, title string, pages array<int>, text string, word string, pos long"


def test_repairs(spark):
    common = "the council and the post-test members rated the hand-checked letters in both the pre- and post-test phases\n\n" * 30
    scanned = "Tlie coun-\ncil rated hand-\n- 4 -\nMORAL PLEAS IN 1ETTERS\nchecked letters in the pre-\nand post-test phases.\n\n0.46\n\nTABLE 3\n\n2. Method\n\nthe membcrs (Tlie, 2001) rated"
    rows = [("a", "p", "Moral pleas in letters: a study", [4, 5], scanned, "clash", 1), ("a", "p", "Moral pleas in letters: a study", [4, 5], scanned, "clash", 2), ("b", "q", "Other", None, common, "", 3), ("c", "q", None, None, None, "", 4), ("d", None, "", [], "", "", 5), ("e", "q", "x", None, "word " * 30_000, "", 6)]
    got = {(r.chunk_id, r.line_no, r.kind, r.word) for r in scans.repairs(spark.createDataFrame(rows, CHUNKS)).collect()}
    mine = {g[1:] for g in got if g[0] == "a"}
    assert {(3, "drop", ""), (4, "drop", ""), (1, "join", "council"), (2, "join", "hand-checked"), (1, "char", "The"), (14, "char", "members")} <= mine
    assert {k for _, k, _ in mine if k == "join"} and not any(n in (5, 8, 10, 12) for n, _, _ in mine)
    assert not [g for g in got if g[0] in "bcde"]
    assert scans.repairs(spark.createDataFrame([], CHUNKS)).count() == 0


def test_running_lines(spark):
    header = "Vrykeasten and Solell"
    chunks = [
        ("a", "p", "Moral pleas in letters: a study", [4, 5], "a body line\n4\nIntroduction\n\nmix\n(12)\n[3]\npage 900\n- v -\nVrykeastten and Solell\nof the text", "", 1),
        ("b", "p", "Moral pleas in letters: a study", None, "the text\nxc\nand on\nxci\nto here", "", 2),
        ("c", "q", "Other things at length", [7, 8], "of it\n7\nTHE GREAT LINE\nof them\n8\nTHE GREAT 1INE\nof all", "", 3),
        ("d", "q", "Other things at length", [9], "Introduction\nOther tbings at length\n" + "word " * 200 + "\n" + "LONG HEADER OF MANY WORDS " * 8 + "\n9", "", 4),
        ("e", "q", "Other things at length", [10], "LONG HEADER OF MANY WORDS " * 8 + "\n10\nand so on", "", 5),
        ("f", "r", None, None, "(1) of\n77\nof it\nANNALS OF M0RAL LANGUAGE, Vol. 5 (2001)\nclx", "", 6),
    ]
    papers = [("p", ["Wanda Vrykeasten", "B. Solell"], 1), ("p", ["Wanda Vrykeasten", "B. Solell"], 1), ("q", None, 7), (None, ["x"], None), ("r", None, 1)]
    venues = spark.createDataFrame([(1, "Annals of Moral Language"), (2, None)], "venue_id long, venue_name string")
    df = spark.createDataFrame(chunks, CHUNKS)
    drops = scans.running_lines(df, Scratch(spark), spark.createDataFrame(papers, "paper_id string, authors array<string>, venue_id long"), venues)
    assert {r.chunk_id: sorted(r.drop) for r in drops.collect()} == {"a": [2, 9, 10], "b": [2, 4], "c": [2, 3, 5, 6], "d": [2, 4, 5], "e": [1, 2], "f": [4, 5]}, header


def test_paragraphs(spark):
    common = "the council and the post-test members rated the hand-checked letters in both the pre- and post-test phases of an international study\n\n" * 60
    scanned = (
        "   Tlie coun-\ncil, rated (hand-\n- 4 -\n\nMORAL PLEAS IN 1ETTERS\nchecked) letters in the pre-\nand post-test phases of an inter-\nna-\ntional study.\n   Tlie membcrs\n\n- 5 -\nrated the tlie-like letters.\n\n2. Method\n\nthe membcrs (Tlie, 2001) rated"
    )
    pages = "the council rated the letters of the members.\n- 4 -\n\nthe members rated the letters.\n\n- 5 -\nthe study"
    rows = [("a", "p", "Moral pleas in letters: a study", [4, 5], scanned, "clash", 1), ("a", "p", "Moral pleas in letters: a study", [4, 5], scanned, "clash", 2), ("b", "q", "Other", None, common, "", 3), ("c", "q", None, None, None, "", 4), ("d", None, "", [], "\n \n", "", 5), ("e", "r", "Pages", [4, 5], pages, "", 6), ("f", "r", "Pages", [7], "- 7 -", "", 7)]
    found = {}
    for r in scans.paragraphs(spark.createDataFrame(rows, CHUNKS)).orderBy("chunk_id", "paragraph").collect():
        found.setdefault(r.chunk_id, []).append(r.text)
        assert r.paragraph == len(found[r.chunk_id])
    assert set(found) == {"a", "b", "e"} and found["b"] == common.strip().split("\n\n")
    assert found["a"] == [
        "The council, rated (hand-checked) letters in the pre- and post-test phases of an international study.", "The members rated the tlie-like letters.", "2. Method", "the members (The, 2001) rated",
    ]
    assert found["e"] == ["the council rated the letters of the members. the members rated the letters.", "the study"]
    assert scans.paragraphs(spark.createDataFrame([], CHUNKS)).count() == 0


def test_encoding(spark):
    encode = encoding.encoder().encode_ordinary
    rng = random.Random(3)
    parts = ["  ", "\n", " ", "a", "bc", "'s", "'", "12", "é", "日本", "!?", "​", "\x1c", "\t", "😀", "<|endoftext|>", "word ", " the"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        assert encoding.encode_text(text, encode, leaf=rng.choice([1, 3, 8, 40])) == encode(text)
    for _ in range(200):
        stretches = [encoding.stretch("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), encode, 8) for _ in range(3)]
        a, b, c = stretches
        assert encoding.join(encoding.join(a, b, encode), c, encode) == encoding.join(a, encoding.join(b, c, encode), encode)
        assert encoding.join(a, encoding.Encoded(""), encode) == a == encoding.join(encoding.Encoded(""), a, encode)
    rows = [(1, "plain text"), (2, ""), (3, None), (4, "héllo wörld 日本 " * 700), (5, "x" * 9_000), (6, "plain text"), (6, "plain text"), (7, "one long text " * 300), (7, "one long text " * 300), (7, "another long text " * 300), (None, "no key " * 700)]
    df = spark.createDataFrame([(k, t, [0]) for k, t in rows], "doc_id long, text string, ids array<int>")
    got = encoding.encode_documents(df, leaf=100, part=1_000)
    expected = sorted(((k, encode(t) if t else []) for k, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == expected
    assert sorted((repr(r.doc_id), r.text) for r in encoding.decode_documents(got).collect()) == sorted((repr(k), t or "") for k, t in rows)
    assert sorted((repr(r.doc_id), r.tokens) for r in encoding.token_counts(df).collect()) == sorted((repr(k), len(v)) for k, v in expected)
    assert encoding.encode_documents(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), "word " * rng.randint(1, 60), "clash") for i in range(800)] + [(1000, "a", None, ""), (1001, "b", "", ""), (1002, "z", "no target", "")]
    targets = [("m", "a", 0.5, 1, 0.5), ("m", "b", 0.3, 3, 0.5), ("m", "c", 0.1, None, 0.5), ("m", "gone", 0.1, 4, 0.5), ("n", "b", 1.0, 2, 5.0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, slot string")
    t = spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int, size_factor double")
    mixed, shares = mixing.mix(d, t, block_tokens=64)
    rows, report = mixed.collect(), {(r.mix_id, r.source): r for r in shares.collect()}
    assert len({(r.mix_id, r.doc_id, r.copy) for r in rows}) == len(rows) and all(r.slot < 2**39 for r in rows)
    for key, r in report.items():
        mine = [x for x in rows if (x.mix_id, x.source) == key]
        assert sum(x.tokens for x in mine) == r.reached_tokens
        assert not mine or max(x.copy for x in mine) == r.most_copies
        most = {tuple(x[:2]): x[3] for x in targets}[key]
        assert most is None or r.most_copies <= most
        if key not in (("m", "gone"), ("n", "b")) and key != ("m", "b"):
            assert abs(r.reached_tokens - r.wanted_tokens) <= 60
    assert report["m", "gone"].reached_tokens == 0 and report["n", "b"].most_copies == 2
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0
    small = mixing.choose(d.select("doc_id", "source", F.lit(5).cast("long").alias("tokens")), mixing.quotas(d.select("doc_id", "source", F.lit(5).cast("long").alias("tokens")), t), bucket_rows=20)
    assert small.groupBy("mix_id", "source").agg(F.sum("tokens")).count() == 4


SAMPLES = {
    "en": "The bridge will be open before the winter and we asked whether anyone had seen the letters. She found only an old shoe under the floor.",
    "de": "Die Brücke wird vor dem Winter geöffnet und wir fragten, ob jemand die Briefe gesehen hatte. Unter dem Boden fanden sie nur einen alten Schuh.",
    "nl": "De brug zal voor de winter open zijn en wij vroegen of iemand de brieven had gezien. Onder de vloer vonden ze alleen een oude schoen.",
    "fr": "Le pont sera ouvert avant l'hiver et nous avons demandé si quelqu'un avait vu les lettres. Sous le plancher ils ne trouvèrent qu'une vieille chaussure.",
    "es": "El puente estará abierto antes del invierno y preguntamos si alguien había visto las cartas. Debajo del suelo encontraron solamente un zapato viejo.",
    "pt": "A ponte estará aberta antes do inverno e perguntámos se alguém tinha visto as cartas. Debaixo do chão encontraram apenas um sapato velho.",
    "it": "Il ponte sarà aperto prima dell'inverno e abbiamo chiesto se qualcuno avesse visto le lettere. Sotto il pavimento trovarono soltanto una vecchia scarpa.",
    "ru": "Мост откроют до зимы, и мы спросили, видел ли кто-нибудь письма. Под полом нашли только старый башмак.",
    "sv": "Bron kommer att vara öppen före vintern och vi frågade om någon hade sett breven. Under golvet hittade de bara en gammal sko.",
    "da": "Broen vil være åben før vinteren, og vi spurgte, om nogen havde set brevene. Under gulvet fandt de kun en gammel sko.",
}


def test_languages(spark):
    samples = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(SAMPLES.items())], "sample_id long, lang string, text string")
    docs = [(i, "xx", t, 0) for i, t in enumerate(SAMPLES.values())] + [
        (20, "English", SAMPLES["en"] + " " + SAMPLES["fr"], 0), (21, "en", "He said «le pont sera ouvert» and left. We asked about it again.", 0), (22, None, None, 0), (23, "de", "", 0), (24, "de", " 12 - ! ", 0), (25, "de-AT", SAMPLES["de"].upper(), 0), (26, "nl", " ".join([SAMPLES["ru"]] * 300), 0),
    ]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string, passage int")
    model = langid.train(samples, d)
    got = {(r.doc_id, r.lang) for r in langid.unstated_languages(d, model).collect()}
    assert got == {(i, k) for i, k in enumerate(SAMPLES)} | {(20, "fr"), (26, "ru")}
    found = langid.passages(d, model).where("doc_id = 20").orderBy("passage").collect()
    assert [(r.lang, r.sentences) for r in found] == [("en", 2), ("fr", 2)] and all(0 <= r.confidence <= 1 for r in found)
    assert langid.passages(d.limit(0), model).count() == 0
    labels = ["EN", "en_US", "Deutsch", "por", "fr-CA", "und", "-", None, ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").select("i", langid.stated_language(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == ["en", "en", "de", "pt", "fr", None, None, None, None]


def test_codewords_and_fit():
    code = langid.codewords(10)
    assert min(int((code[i] != code[j]).sum()) for i in range(10) for j in range(i)) >= 4
    assert langid.sentences("One (Fliter, 2007). Two «x. Y z» end! three\n\nFour") == ["One (Fliter, 2007).", "Two «x. Y z» end! three", "Four"]


def test_scratch(spark):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(3), "x")
    assert kept.count() == 3
    scratch.drop("x")
