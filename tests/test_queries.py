"""Registered queries of the catalogue: words as their SQL has them, and what they write on the way."""

import os

import duckdb
import pytest
from leafquarry import queries
from leafquarry.functions.text import normalize
from leafquarry.operators import search
from leafquarry.plans import query as Q
from leafquarry.shared import shared_dir
from leafquarry.state import Store
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 documents: 28 with "on", of which two are copies, 6 with "óñ"; 5 conversations of 4 turns."""
    top = tmp_path_factory.mktemp("tables")
    said = lambda i: "copied on" if i in (3, 33) else f"{'on ' * (1 + i % 5)}word{i}" if i < 28 or i == 59 else f"óñ word{i}" if i < 34 else f"The thing of {i}"
    docs = [(i, said(i), ("en", "fr")[i % 2], f"src{i % 4}", 9) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    turns = [(i, k, "user", f"Turn *{k}* of {i}") for i in range(5) for k in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top)


def wanted(tables, name):
    db = duckdb.connect()
    for n in ("documents", "conversations"):
        db.execute(f"create view {n} as select * from read_parquet('{tables}/{n}.parquet/*.parquet')")
    return sorted(map(repr, db.execute(queries.ORACLES[name]).fetchall()))


def found(spark, tables, name):
    return sorted(repr(tuple(r)) for r in queries.QUERIES[name](spark, tables).collect())


def left(spark):
    """Folders of the shared folder, each with the folders in it."""
    at = shared_dir(spark).removeprefix("file://")
    return {n: set(os.listdir(f"{at}/{n}")) for n in os.listdir(at) if n.startswith("leafquarry-") and os.path.isdir(f"{at}/{n}")}


def test_words_with_diacritics(spark, tables):
    """the SQL counts words as they are written; with "óñ" taken for "on" more than half of the texts had the word."""
    assert found(spark, tables, "path_appended") == wanted(tables, "path_appended")
    pages = spark.createDataFrame([(1, "on"), (2, "óñ"), (3, "the")], "id long, search_text string")
    of = lambda index, raw: sorted(r.id for r in search.rank_pages(pages, Q.parse(raw), index).collect())
    assert of("exact", "on") == [1] and of("exact", "óñ") == [2] and of("word", "on") == [1, 2] and of("exact", "NEAR(óñ) OR ^the") == [2, 3]


def new_folders(spark, tables, *names):
    """What queries leave in the shared folder, read anew."""
    before = left(spark)
    queries._READ.clear()
    for name in names:
        assert found(spark, tables, name) == wanted(tables, name), name
    return {k: v for k, v in left(spark).items() if k not in before}


def test_the_catalogue_alone_is_stored(spark, tables):
    """contents and documents need no pages and no posting tables."""
    made = new_folders(spark, tables, "sweep_apply", "representative_path", "all_stats")
    assert len(made) >= 2 and not any({"pages", "word", "trigram"} & v for v in made.values())


def test_a_search_of_the_texts_writes_no_postings(spark, tables):
    """also where texts repeat."""
    made = new_folders(spark, tables, "fts_or", "fts_trigram", "find_hybrid", "snippets")
    assert made and not any({"pages", "word", "trigram"} & v for v in made.values())
    assert queries.library(spark, tables).pages.count() == len(wanted(tables, "live_contents")) + len(wanted(tables, "orphan_contents"))


def test_commits_keep_the_index_that_is_searched(spark, tables):
    """the words' postings alone; another index is refused, not taken for empty."""
    made = new_folders(spark, tables, "find_after_commits")
    assert any("word" in v for v in made.values()) and not any("trigram" in v for v in made.values())
    with pytest.raises(LookupError):
        queries.searched(spark, tables).indexes().of("trigram")


def test_reads_of_a_table_write_nothing(spark, tables):
    """F7, F8, F10: one conversation is read where the table has it."""
    assert new_folders(spark, tables, "read_range", "read_context", "page_one") == {}


def test_migration_sorts_in_parts(spark, tables, tmp_path, monkeypatch):
    """no posting tables, and tasks of bounded size however few partitions the session has."""
    from leafquarry import state

    made = new_folders(spark, tables, "migrated_pages")
    assert made and not any({"word", "trigram"} & v for v in made.values())
    monkeypatch.setattr(state, "PART", 256)
    store = Store(spark, str(tmp_path / "db"), block=1)
    assert store._parts(256 * 4) == () and store._parts(256 * 9 + 1) == (10,)
    store.save(queries.talks(spark, tables))
    assert store.load().pages.where(F.col("search_text") == normalize("markdown")).count() == 20
    assert len({p.split("-")[1] for _, _, names in os.walk(tmp_path / "db" / "pages") for p in names if p.startswith("part-")}) > 4
