import sqlite3

import pytest

from leafquarry.functions.text import normalize
from leafquarry.operators import search
from leafquarry.operators.search import Options, find
from leafquarry.operators.snippet import snippet
from leafquarry.plans import query as Q
from pyspark.sql import functions as F


def library(spark, rows):
    """rows: (path, page_count, page_index, markdown); deleted paths end in .gone."""
    paths = list(dict.fromkeys(r[0] for r in rows))
    at = {p: i + 1 for i, p in enumerate(paths)}
    pages = spark.createDataFrame([(i + 1, at[p], k, t) for i, (p, _, k, t) in enumerate(rows)], "id long, content_id long, page_index int, markdown string")
    pages = pages.withColumn("search_text", normalize(F.col("markdown")))
    docs = spark.createDataFrame([(at[p], p, at[p], p.endswith(".gone")) for p in paths], "id long, path string, content_id long, deleted boolean")
    contents = spark.createDataFrame([(at[p], n) for p, n, *_ in {r[0]: r for r in rows}.values()], "id long, page_count int")
    return pages, docs, contents


def got(spark, rows, **options):
    return find(*library(spark, rows), Options(**options)).collect()


HERON = ("/desk/heron.pdf", 1, 0, "a grey heron waits beside the slow river")


def test_normalize(spark):
    rows = [("# Heading\n- **Bold** [Link](https://example.com)", "heading bold link https example com"), ("alpha\n\n\tbeta   gamma", "alpha beta gamma"), ("x² İΣ", "x iσ"), ("", "")]
    df = spark.createDataFrame([(a, b) for a, b in rows], "t string, want string").withColumn("got", normalize(F.col("t")))
    assert [r.got for r in df.collect()] == [b for _, b in rows]


def test_words_and_modes(spark):
    assert [(r.path, r.page_index, r.search_source) for r in got(spark, [HERON], query="grey slow")] == [("/desk/heron.pdf", 0, "fts")]
    row = [("/desk/way.pdf", 1, 0, "alpha term")]
    assert not got(spark, row, query="alpha missing")
    assert len(got(spark, row, query="alpha missing", mode="OR")) == 1
    with pytest.raises(ValueError, match="invalid search mode"):
        got(spark, row, query="x", mode="xor")


def test_trigram_and_path(spark):
    rows = [("/desk/grams.pdf", 1, 0, "watercolour sketches")]
    assert not got(spark, rows, query="tercol", path_fallback=False)
    assert [r.search_source for r in got(spark, rows, query="tercol", path_fallback=False, trigram=True)] == ["trigram"]
    rows = [("/desk/words.pdf", 1, 0, "alpha beta"), ("/desk/plan-ledger.pdf", 1, 0, "unrelated body"), ("/desk/ledger.gone", 1, 0, "ledger")]
    assert [r.search_source for r in got(spark, rows, query="alpha")] == ["fts"]
    (row,) = got(spark, rows, query="ledger")
    assert (row.search_source, row.snippet, row["rank"], row.page_index) == ("path", "", 0.0, 0)
    assert len(got(spark, [("/home/someone/shelf/atlas.pdf", 1, 0, "page body")], query="atlas.pdf")) == 1
    assert len(got(spark, [("/a/x%y.pdf", 1, 0, "z")], query="X_Y")) == 1  # _ is live, letters match in either case


def test_pagination_and_counts(spark):
    rows = [("/desk/many.pdf", 5, i, "alpha") for i in range(5)]
    assert [r.page_index for r in got(spark, rows, query="alpha", limit=2, offset=1)] == [1, 2]
    assert not got(spark, rows, query="alpha", offset=9)
    assert len(got(spark, rows, query="alpha", limit=0)) == 5
    assert got(spark, [("/desk/seven.pdf", 7, 3, "findable words")], query="findable")[0].page_count == 7
    assert not got(spark, rows, query="  ")


def test_raw_errors():
    for bad in ("a-b", '"x', "NOT a", "", "(a", "foo: x", "a AND"):
        with pytest.raises(ValueError):
            Q.parse(bad)
    assert Q.match_expression(['a"b', "c"], "or") == '"a""b" OR "c"'
    assert Q.match_expression([], "and") == '""'


def test_quotes_in_arguments(spark):
    """A quote inside a word parts it, as any mark does: a phrase of both halves."""
    rows = [("/1.pdf", 1, 0, "foo bar"), ("/2.pdf", 1, 0, "foobar"), ("/3.pdf", 1, 0, "bar foo")]
    assert [r.path for r in got(spark, rows, query='foo"bar', path_fallback=False)] == ["/1.pdf"]
    assert not got(spark, rows, query='"', path_fallback=False)


TEXTS = ["tax receipt café report pdf", "alpha beta tax tax gamma", "report of the pdf", "retercolment año tax", "gamma beta alpha invoice", "x " * 60 + "tax alpha " + "y " * 60 + "tax", ""]


@pytest.mark.parametrize("raw", ['"tax" AND "alpha"', "tax OR gamma", '"report pdf"', '"cafe"', "tax NOT alpha", "repo*", "alpha + beta", "^tax", "NEAR(alpha gamma, 1)", "search_text: tax", '"&" OR tax', "alpha OR (beta AND nothing)", "tax tax", '"tercol"'])
def test_against_fts5(spark, raw):
    pages, _, _ = library(spark, [(f"/{i}.pdf", 1, 0, t) for i, t in enumerate(TEXTS)])
    db = sqlite3.connect(":memory:")
    for index, options in (("word", ""), ("trigram", ", tokenize='trigram'")):
        db.execute(f"create virtual table {index} using fts5(search_text{options})")
        for r in pages.collect():
            db.execute(f"insert into {index}(rowid, search_text) values (?, ?)", (r.id, r.search_text))
        want = {i: (s, t) for i, s, t in db.execute(f"select rowid, bm25({index}), snippet({index}, 0, '>>>', '<<<', '...', 48) from {index} where {index} match ?", (raw,))}
        node = Q.parse(raw)
        found = {r.id: r for r in search.rank_pages(pages, node, index).collect()}
        assert found.keys() == want.keys()
        phrases = [(search.phrase_text(p, index), p.prefix, p.first) for p in Q.phrases(node)]
        for i, (score, text) in want.items():
            assert found[i]["rank"] == pytest.approx(score, rel=1e-9, abs=1e-12)
            if index == "word" and "NEAR" not in raw and "(" not in raw:
                assert snippet(found[i].search_text, phrases, index, 48) == text


def test_multi_find(spark):
    parts = library(spark, [HERON, ("/desk/otter.pdf", 1, 0, "otter")])
    rows = search.multi_find(*parts, [Options(query="otter"), Options(query="heron"), Options(query="desk")]).collect()
    assert sorted(r.path for r in rows) == ["/desk/heron.pdf", "/desk/otter.pdf"] and {r.search_source for r in rows} == {"fts"}


RAW = ['"tax" AND "alpha"', '"report pdf"', "tax NOT alpha", "repo*", "alpha + beta", "^tax", '"&" OR tax', "alpha OR (beta AND nothing)", "tax tax", '"tercol"', '"ph"', "NEAR(alpha gamma, 1) OR beta", "NEAR(tax alp*, 3) OR gamma", "NEAR(alpha beta tax, 2)", "NEAR(alpha beta) NOT invoice", '"alpha x" OR "beta alp"']


def test_postings_against_fts5(spark):
    """Ranks from position lists: substrings, phrases and NEAR, alone and inside other nodes, in both indexes."""
    from leafquarry.operators import postings

    texts = [*TEXTS, "alpha x gamma y alpha z beta gamma", "tax tercol \U0001f600 tercol ercolm alphaalphaalpha"]
    pages, _, _ = library(spark, [(f"/{i}.pdf", 1, 0, t) for i, t in enumerate(texts)])
    pages = pages.cache()
    for index, options in (("word", ""), ("trigram", ", tokenize='trigram'")):
        db = sqlite3.connect(":memory:")
        db.execute(f"create virtual table {index} using fts5(search_text{options})")
        db.executemany(f"insert into {index}(rowid, search_text) values (?, ?)", [(r.id, r.search_text) for r in pages.collect()])
        held = postings.build(pages, index)
        for raw in RAW:
            want = dict(db.execute(f"select rowid, bm25({index}) from {index} where {index} match ?", (raw,)))
            got = {r.content_id: r["rank"] for r in postings.rank(held, Q.parse(raw)).collect()}
            assert got == pytest.approx(want, rel=1e-9, abs=1e-12), (index, raw)


def test_no_postings(spark):
    from leafquarry.operators import postings

    pages, _, _ = library(spark, [("/a.pdf", 1, 0, ""), ("/b.pdf", 1, 0, "ab")])
    for index in postings.INDEXES:
        for some in (pages, pages.limit(0)):
            assert postings.rank(postings.build(some, index), Q.parse("abc OR abcd")).count() == 0
    assert not postings.File("f", "b", "d").holds(["a", "e"], ["e"]) and postings.File("f", "b", "d").holds([], ["cx"]) and postings.File("f", "b", "dx").holds(["dw"], ["d"])
