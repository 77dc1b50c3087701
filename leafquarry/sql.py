"""The catalogue and its search in SQL: views of a store's tables and table functions over its posting tables.

    register(store, "lib_")
    spark.sql("SELECT d.path, f.rank FROM lib_find('slow river', 'or') f JOIN lib_documents d USING (path) ORDER BY f.rank LIMIT 20")

The functions are SQL functions, so Catalyst plans the whole statement at once: a query's words are joined to the postings
as rows, whose files are then read by column only, not by term (find() of operators/search.py does that). Ranks are those of
find() for words; phrases, NEAR and substrings are not part of SQL search.
"""

from __future__ import annotations

from .functions.text import folding
from .operators.search import K1, LEAST_IDF, B
from .state import Store

VIEWS = ("contents", "documents", "pages")


def register(store: Store, prefix: str = "") -> list[str]:
    """Registers, as the store stands now: views contents, documents (live ones, with their contents' columns) and pages; table
    functions search_pages(words, mode) -> (content_id, page_index, rank) and find(words, mode) -> (path, page_index,
    page_count, rank). mode is 'and' or 'or'. Returns their names."""
    spark, catalog, words = store.spark, store.load(), store.indexes().word
    frames = {"contents": catalog.contents, "documents": catalog.live(), "pages": catalog.pages, "postings": words.every().select("term", "content_id", "page_index", "dl", "tf")}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(prefix + name)
    old, new = (x.replace("'", "''") for x in folding())
    average = words.length / words.total if words.total else 1.0
    asked = rf"""asked AS (SELECT DISTINCT word, m FROM (SELECT explode(split(trim(translate(lower(regexp_replace(words, '[^\\p{{L}}\\p{{N}}]+', ' ')), '{old}', '{new}')), ' ')) AS word, lower(mode) AS m) WHERE word <> '')"""
    idf = f"ln(({words.total} - df + 0.5) / (df + 0.5))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}search_pages(words STRING, mode STRING) RETURNS TABLE(content_id BIGINT, page_index INT, rank DOUBLE) RETURN
        WITH {asked},
        dfs AS (SELECT term, count(*) AS df FROM {prefix}postings JOIN asked ON term = word GROUP BY term),
        hit AS (SELECT content_id, page_index, dl, tf, term, df FROM {prefix}postings JOIN dfs USING (term)),
        need AS (SELECT count(*) AS n, max(m) AS m FROM asked)
        SELECT content_id, page_index, -sum(CASE WHEN {idf} <= 0 THEN {LEAST_IDF} ELSE {idf} END * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / {average!r}D))) AS rank
        FROM hit CROSS JOIN need GROUP BY content_id, page_index HAVING max(need.m) = 'or' OR count(*) = max(need.n)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}find(words STRING, mode STRING) RETURNS TABLE(path STRING, page_index INT, page_count INT, rank DOUBLE) RETURN
        SELECT d.path, s.page_index, d.page_count, s.rank FROM {prefix}search_pages(find.words, find.mode) s JOIN {prefix}documents d ON d.content_id = s.content_id""".replace("find.words, find.mode", "words, mode"))
    return [prefix + n for n in (*VIEWS, "search_pages", "find")]
