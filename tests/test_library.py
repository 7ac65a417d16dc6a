"""Small cases of the core: text, values, sources, sinks, packed fields, groups, percentiles, vectors, streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from fathomry.functions import cells, links, text, values
from fathomry.operators import curation, features, ledger, packed, quantiles, resolve, similarity
from fathomry.operators.running import running_total
from fathomry.sources import readers, services, sinks


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.normalize_name(F.lit("Care/Harm & Don’t-Know"))) == "care harm and dont know"
    assert one(spark, text.normalize_title(F.lit("<i>A &amp; B</i>: C"))) == "a b c"
    assert one(spark, text.match_name(F.lit("Fallacies and Biases"))) == "fallacy bias"
    assert one(spark, text.normalize_doi(F.lit("https://doi.org/10.1145/1234.5678"))) == "10.1145/1234.5678"
    assert one(spark, text.normalize_doi(F.lit("doi:10.1000/ABC."))) == "10.1000/abc"
    assert one(spark, text.normalize_doi(F.lit(" "))) is None
    assert one(spark, text.tokens(F.lit("State-of-the-art, don't 3 x"))) == ["state-of-the-art", "don't", "x"]
    assert one(spark, text.arxiv_id(F.lit("https://arxiv.org/abs/2101.00001v2"))) == "2101.00001"
    assert one(spark, text.clean_text(F.lit("a  \r\nb\n\n\n\nc"))) == "a\nb\n\nc"


def test_pages_and_windows(spark):
    pages = one(spark, text.pages_of(F.lit("---\nx: 1\n---\n# T\n\n## Page 1\n\none\n\n## Page 2\ntwo")))
    assert [(p.page, p.text) for p in pages] == [(1, "one"), (2, "two")]
    assert [(p.page, p.text) for p in one(spark, text.pages_of(F.lit("no pages")))] == [(None, "no pages")]
    for n in (0, 1, 4, 5, 6, 11, 30):
        words = [str(i) for i in range(n)]
        expected, i = [], 0
        while words:
            expected.append(" ".join(words[i : i + 5]))
            if i + 5 >= n:
                break
            i += 3
        assert one(spark, text.word_windows(F.lit(" ".join(words)), 5, 2)) == expected


def test_values(spark):
    assert [one(spark, values.whole_number(F.lit(x))) for x in ("3.7", "x", " 5 ")] == [3, 0, 5]
    assert one(spark, values.number(F.lit("nan"))) == 0.0
    assert one(spark, values.folded_set(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b")))) == ["A", "b"]
    papers = [0, 1, 2, 3, 5, 6, 9, 10, 14, 15, 16]
    assert [one(spark, values.literature_support(F.lit(n))) for n in papers] == [0, 0, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert one(spark, values.total_score(F.lit(5), F.lit(5), F.lit(4))) == 4.7


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "c", "pages": [1, 2]}\nbroken\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.CHUNK, "bad").orderBy("pos").collect()
    assert rows[0].pages == [1, 2] and rows[1].bad == "broken"
    (tmp_path / "b.json").write_text(json.dumps({"features": [{"chunk_id": "x"}, {"chunk_id": "y"}]}))
    assert [r.chunk_id for r in readers.json_documents(spark, str(tmp_path / "b.json"), readers.CHUNK).orderBy("pos").collect()] == ["x", "y"]
    (tmp_path / "c.md").write_text("# Title\n\n## Page 3\n\ntext")
    assert readers.markdown_papers(spark, str(tmp_path / "c.md")).select("title", "page", "text").first() == ("Title", 3, "text")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 x")
    assert readers.binary_files(spark, str(tmp_path / "d.pdf")).first().kind == "pdf"
    df = spark.createDataFrame([("a|b\nc", [1, 2], None)], "t string, n array<int>, e string")
    sinks.write_csv(df, str(tmp_path / "out"), ["t", "n", "e", "none"])
    back = readers.csv_table(spark, str(tmp_path / "out"), ["t", "n", "missing"]).first()
    assert (back.t, back.n, back.missing) == ("a|b\nc", "[1,2]", None)
    assert sinks.markdown_lines(df, ["t", "e"]).first().line == "| a\\|b c |  |"
    assert one(spark, readers.inverted_abstract(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"


PACKED = [
    (None, []), ("", []), ("  ", []), ("|", []), (";; ;", []),
    ("a; b;c", ["a", "b", "c"]), ('"x, y", z', ["x, y", "z"]), ("['it''s', 'b']", None), ('["a", "b, c"]', ["a", "b, c"]), ("['p', \"q's\"]", ["p", "q's"]),
    ("a\\, b; c", ["a, b", "c"]), ("«old|new» • b", ["old|new", "b"]), ("the readers' share|b", ["the readers' share", "b"]), ("either/or; 50/50", ["either/or", "50/50"]),
    ("a / b", ["a", "b"]), ("a\tb\nc", ["a", "b", "c"]), ("a；b、c", ["a", "b", "c"]), ('"open, b', ['"open', "b"]), ("a,a", ["a", "a"]),
]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_packed(spark, broadcast_rows):
    rows = [(i, t, None, "clash") for i, (t, _) in enumerate(PACKED)] + [(100, "crowd, herd or mob; x", "praise, then blame|x", ""), (101, '"praise, then blame"', None, "")]
    df = spark.createDataFrame(rows, "id long, one string, two string, value string")
    names = spark.createDataFrame([("Crowd, herd or mob",)], "value string")
    found = {}
    for r in sorted(packed.split_packed(df, ["id"], ["one", "two"], names, broadcast_rows).collect()):
        found.setdefault((r.id, r.field), []).append((r.position, r.value))
    for i, (_, expected) in enumerate(PACKED):
        if expected is not None:
            assert [v for _, v in found.get((i, "one"), [])] == expected
            assert [p for p, _ in found.get((i, "one"), [])] == list(range(1, len(expected) + 1))
    assert [v for _, v in found[(100, "one")]] == ["crowd, herd or mob", "x"]
    assert [v for _, v in found[(100, "two")]] == ["praise, then blame", "x"]
    assert packed.split_packed(df.limit(0), ["id"], ["one"]).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_packed_long_values(spark, broadcast_rows):
    value = "praise for " + "very " * 40 + "old habits, then blame for them"
    df = spark.createDataFrame([(1, f'"{value}"; x'), (2, f"{value}; y"), (3, "praise, then; blame")], "id long, one string")
    found = {}
    for r in sorted(packed.split_packed(df, ["id"], ["one"], None, broadcast_rows).collect()):
        found.setdefault(r.id, []).append(r.value)
    assert found == {1: [value, "x"], 2: [value, "y"], 3: ["praise", "then", "blame"]}


def test_packed_long(spark):
    df = spark.createDataFrame([(1, ", ".join(f"v{i}" for i in range(20_000)))], "id long, one string")
    assert packed.split_packed(df, ["id"], ["one"]).count() == 20_000


def test_running_total(spark):
    random.seed(1)
    rows = [(random.choice("ab"), random.randint(0, 5), i, random.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, b int, o int, v int")
    got = {r.o: r.t for r in running_total(df, ["g"], "b", ["o"], "v", "t").collect()}
    for g in "ab":
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]):
            assert got[r[2]] == total
            total += r[3] or 0


def test_percentiles_and_areas(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10)] + [(None,), (float("nan"),)], "v double")
    assert {r.share: round(r.value, 6) for r in quantiles.exact_percentiles(df, [], "v", [0.05, 0.5, 0.9, 1.0]).collect()} == {0.05: 1.15, 0.5: 3.0, 0.9: 8.2, 1.0: 10.0}
    pairs = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.1, False), (None, True)], "v double, p boolean")
    assert quantiles.rank_areas(pairs, "v", "p").first().auc == 0.875


def test_groups_and_sweep(spark):
    random.seed(2)
    edges = [(random.randint(0, 60), random.randint(0, 60), random.choice([0.8, 0.9, 0.95])) for _ in range(50)] + [(i, i + 1, 0.9) for i in range(100, 160)]
    df = spark.createDataFrame(edges, "l long, r long, similarity double")

    def brute(least):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for l, r, s in edges:
            if s >= least and l != r:
                a, b = find(l), find(r)
                root[max(a, b)] = min(a, b)
        return {x: find(x) for x in list(root)}

    got = {r.item: r.group for r in similarity.linked_groups(df.select(F.col("l").alias("a"), F.col("r").alias("b"))).collect()}
    assert got == brute(0)
    for r in similarity.threshold_sweep(df, [0.8, 0.9, 0.95]).collect():
        b = brute(r.threshold)
        assert (r.groups, r.grouped) == (len(set(b.values())), len(b))
    assert similarity.linked_groups(df.select(F.col("l").alias("a"), F.col("r").alias("b")).limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.9])
def test_cosine_pairs(spark, threshold):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 8))
    vectors = np.concatenate([centres[i % 5] + rng.normal(size=8) * 0.2 for i in range(150)]).reshape(150, 8)
    vectors[3] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)] + [(500, None, 1)], "id long, v array<double>, s int")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    dots = unit @ unit.T
    expected = {(i, j) for i in range(150) for j in range(i + 1, 150) if dots[i, j] >= threshold}
    got = similarity.cosine_pairs(df, "id", "v", threshold, pivots=6, block=16).collect()
    assert len(got) == len(expected) and {(r.l, r.r) for r in got} == expected
    scoped = {(r.l, r.r) for r in similarity.cosine_pairs(df, "id", "v", threshold, scope="s", pivots=6, block=16).collect()}
    assert scoped == {(i, j) for i, j in expected if i % 3 == j % 3}


def test_resolution(spark):
    rows = [(1, "10.1/a", "T one", "x", ["a"]), (2, "10.1/a", None, "longer", ["b"]), (3, None, "T one", "", None), (4, None, None, None, ["c"])]
    df = spark.createDataFrame(rows, "pos long, doi string, title string, abstract string, apis array<string>")
    groups = resolve.resolved_groups(df, "pos", [("doi", F.col("doi")), ("title", F.col("title"))])
    merged = {r.group: r for r in resolve.merged_records(df, groups, "pos", ["doi", "title"], ["abstract"], [], ["apis"]).collect()}
    assert {g: r.records for g, r in merged.items()} == {1: 3, 4: 1}
    assert (merged[1].title, merged[1].abstract, merged[1].apis) == ("T one", "longer", ["a", "b"])


def test_paper_keys(spark):
    rows = [
        (1, "10.1/a", None, "One title", 2001, "S. Wamar"), (2, None, None, "<i>One</i> title", None, None), (3, "10.48550/arXiv.2101.00001v2", None, "Other", 2002, None), (4, None, "https://arxiv.org/abs/2101.00001", "Another", 2002, None),
        (5, None, None, "Заглавие", 2001, "S. Wamar"), (6, None, None, "Другое", 2001, "S. Wamar"), (7, None, None, None, None, None), (8, None, "https://a.b/pdf/1234.56789", "Last", None, None),
        (9, None, "https://a.b/pdf/1234.56789", "Least", None, None), (10, "10.48550/arxiv.cs/0112017", None, "Older", None, None), (11, None, "https://arxiv.org/pdf/cs/0112017v2.pdf", "Old", None, None),
    ] + [(100 + i, "10.9/volume", None, f"Part {i}", 2003, "A. Sole") for i in range(30)]
    df = spark.createDataFrame(rows, "pos long, doi string, url string, title string, year int, author string")
    held = resolve.paper_keys(df, "pos", F.col("doi"), [F.col("url")], F.col("title"), F.col("year"), F.col("author"))
    groups = {r.item: r.group for r in resolve.groups_of_keys(df, "pos", held).collect()}
    assert groups == {i: i for i, *_ in rows} | {2: 1, 4: 3, 11: 10}
    assert {r.key for r in held.where("item in (2, 5, 7)").collect()} == {"title:one title"}
    few = resolve.paper_keys(df, "pos", F.col("doi"), [F.col("url")], F.col("title"), F.col("year"), F.col("author"), most_titles=30)
    assert {r.group for r in resolve.groups_of_keys(df, "pos", few).where("item >= 100").collect()} == {100}


def test_decisions_and_ledgers(spark):
    events = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("", 3, "c"), (None, 4, "d")], "key string, seq int, action string")
    latest = features.last_rows(events, ["key"], ["seq"])
    assert [(r.key, r.action) for r in latest.collect()] == [("k", "b")]
    rows = spark.createDataFrame([("k",), ("z",), (None,)], "key string")
    decided = features.with_decisions(rows, latest, "key", {"action": F.lit("keep")})
    assert sorted((r.key or "", r.action, r.decided) for r in decided.collect()) == [("", "keep", False), ("k", "b", True), ("z", "keep", False)]
    first = features.first_rows(events, ["key"], "seq")
    assert sorted(r.seq for r in first.collect()) == [1, 3]
    assert {r.service: r.total for r in ledger.service_summary(spark.createDataFrame([(["b", "a", "a"],), (None,)], "s array<string>"), F.col("s"), {}).collect()} == {"a": 1, "b": 1, "unknown": 1}


def test_links_and_cells(spark):
    page = '<html><meta name="citation_pdf_url" content="/a.pdf"><meta name="other" content="/no.pdf"><link href="b.pdf"><a href="HTTPS://X.ORG/A.PDF">x</a><iframe src="https://y.org/c"><a href="javascript:void(0)"><a href="">'
    assert links.links_of(page, "https://x.org/dir/page") == ["https://x.org/a.pdf", "https://x.org/dir/b.pdf", "https://y.org/c"]
    assert links.links_of(None, None) == [] and links.links_of("<a href='http://[bad'>", "https://x.org") == []
    assert one(spark, links.clean_url(F.lit(' "https:\\/\\/x.org/a?b&amp;c". '))) == "https://x.org/a?b&c"
    assert one(spark, links.urls_in_text(F.lit("see https://x.org/a, (https://x.org/a) and http://y.org."))) == ["https://x.org/a", "http://y.org"]
    assert one(spark, links.inferred_pdf(F.lit("10.48550/arxiv.2101.00001"), F.lit(None).cast("string"))) == "https://arxiv.org/pdf/2101.00001.pdf"
    assert one(spark, cells.listed(F.lit('["a", null, "b"]'))) == ["a", "b"] and one(spark, cells.listed(F.lit("['a']"))) == ["['a']"]
    assert one(spark, cells.listed(F.lit(" "))) == [] and one(spark, cells.listed(F.lit(None).cast("string"))) == []
    assert one(spark, cells.compact(F.array(F.lit("abc"), F.lit("d"), F.lit("e")), 2, 2)) == ["ab", "d"]
    assert one(spark, cells.page_numbers(F.array(F.lit("3"), F.lit("x"), F.lit("3"), F.lit("1")))) == [3, 1]
    row = spark.createDataFrame([(("", "in"), "flat")], "a struct<b: string, c: string>, a_b string")
    assert row.select(cells.at_path("", "a.b", {"a", "a_b"}).alias("x"), cells.at_path("", "a.c", {"a"}).alias("y"), cells.at_path("", "q.r", {"a"}).alias("z")).first() == ("flat", "in", None)


def test_services(spark):
    answers = spark.createDataFrame([
        (1, json.dumps({"display_name": "T", "publication_year": 2001, "doi": "https://doi.org/10.1/A", "authorships": [{"author": {"display_name": "A B"}}, {"author": {}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "primary_location": {"pdf_url": "https://x/1.pdf", "source": {"display_name": "V"}}, "locations": [{"pdf_url": "https://x/1.pdf"}, {"pdf_url": None}]})),
        (2, "not json"), (3, None), (4, "{}"),
    ], "id int, answer string")
    found = {r.id: r for r in services.from_works(answers, "answer", ["id"]).collect()}
    assert (found[1].title, found[1].authors, found[1].year, found[1].doi, found[1].abstract, found[1].venue, found[1].candidate_pdf_urls) == ("T", ["A B"], 2001, "10.1/a", "a b a", "V", ["https://x/1.pdf"])
    assert found[2].title is None and found[3].title is None and found[4].year is None
    made = spark.createDataFrame([(1, json.dumps({"title": ["T"], "issued": {"date-parts": [[1999, 5]]}, "author": [{"given": "A", "family": "B"}, {}], "link": [{"URL": "https://x/a", "content-type": "application/pdf"}, {"URL": "https://x/b", "content-type": "text/html"}], "abstract": "<p>x</p>"}))], "id int, answer string")
    r = services.from_registered(made, "answer", ["id"]).first()
    assert (r.title, r.year, r.authors, r.candidate_pdf_urls, r.abstract) == ("T", 1999, ["A B"], ["https://x/a"], "x")
    made = spark.createDataFrame([(1, json.dumps({"title": "T.", "pubYear": "2003", "authorString": "B A, D C.", "fullTextUrlList": {"fullTextUrl": [{"url": "https://x/a", "documentStyle": "pdf"}, {"url": "https://x/h", "documentStyle": "html"}]}}))], "id int, answer string")
    r = services.from_results(made, "answer", ["id"]).first()
    assert (r.title, r.year, r.authors, r.candidate_pdf_urls, r.landing_page_url) == ("T", 2003, ["B A", "D C"], ["https://x/a"], "https://x/h")
    made = spark.createDataFrame([(1, json.dumps({"title": "T", "externalIds": {"DOI": "10.1/X", "ArXiv": "2101.00001"}, "openAccessPdf": {"url": "https://arxiv.org/pdf/2101.00001.PDF"}, "authors": [{"name": "A"}]}))], "id int, answer string")
    r = services.from_papers(made, "answer", ["id"]).first()
    assert (r.doi, r.candidate_pdf_urls, r.authors) == ("10.1/x", ["https://arxiv.org/pdf/2101.00001.PDF"], ["A"])


def test_curation(spark):
    known = spark.createDataFrame([("k1", "p", "doom", ["doom", "gloom"]), ("k2", "", "heart", ["heart"]), ("k3", "p", "none", ["none", ""])], "known string, category string, label string, aliases array<string>")
    rows = spark.createDataFrame([(1, "p", "gloom", ["gloom"]), (2, "q", "doom", ["doom"]), (3, "q", "x", ["x", "heart"]), (4, "p", "", ["", "none"])], "row int, category string, name string, names array<string>")
    assert {tuple(r) for r in curation.known_matches(known, rows).collect()} == {("k1", "alias", 1), ("k2", "alias", 3), ("k3", "alias", 4)}
    rows = rows.unionByName(spark.createDataFrame([(5, "p", "doom", None)], rows.schema))
    assert {tuple(r) for r in curation.known_matches(known, rows).where("known = 'k1'").collect()} == {("k1", "name", 5)}
    assert curation.known_matches(known, rows.limit(0)).where("tier = 'none'").count() == 3
    base = spark.createDataFrame([(1, "a"), (2, "a"), (250_000, "a"), (4, "b")], "pos long, base string")
    assert {r.pos: r.unique_key for r in curation.retain_unseen(base, "base", "pos").collect()} == {1: "a", 2: "a_2", 250_000: "a_3", 4: "b"}
    controls = curation.control_rows(spark.createDataFrame([(1, "n", ["a", "a", "n", None, "b", "c"]), (2, "m", ["a"]), (3, "", ["a", "b"]), (4, "o", None)], "row int, name string, syn array<string>"), "row", "name", "syn")
    assert [(r.variant, r.text) for r in controls.orderBy("variant").collect()] == [(0, "n"), (1, "a"), (2, "b")]
    assert curation.control_pairs(controls, "row").groupBy("kind").count().orderBy("kind").collect() == [("canonical_synonym", 2), ("synonym_synonym", 1)]


def test_linked_groups_end(spark):
    for n in (2, 50):
        chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
        assert {tuple(r) for r in similarity.linked_groups(chain).collect()} == {(i, 0) for i in range(n + 1)}
    assert similarity.linked_groups(chain.limit(0)).count() == 0


def test_write_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(i, "hot" if i % 10 else "cold", None) for i in range(2_000)], "i int, kind string, e string")
    sinks.write_parquet(df, str(tmp_path / "out"), ["kind"], spread=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("kind").count().orderBy("kind").collect() == [("cold", 200), ("hot", 1800)]
    assert len(list((tmp_path / "out" / "kind=hot").glob("*.parquet"))) <= 4
