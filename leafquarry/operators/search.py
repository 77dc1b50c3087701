"""Hybrid ranked search: a word index (BM25), a trigram substring index and a path fallback, as DataFrame plans.

Both legs read posting tables where there are any (see postings.py), and the texts otherwise. Statistics count every row of
`pages`; liveness and fan-out to paths come after. Each leg keeps its best offset + limit rows (TakeOrderedAndProject), legs
are merged by (path, page), and only for the rows that are returned are texts read, for their snippets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arguments import search_mode
from ..functions.paths import path_has
from ..functions.text import fold, java_literal, normalize, word_tokens
from ..plans import query as Q
from ..schema import FOUND
from ..shipping import ship_package
from .catalog import block_of
from .snippet import snippet_udf

DEFAULT_LIMIT, SNIPPET_TOKENS, K1, B, LEAST_IDF = 50, 48, 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Options:
    query: str = ""
    raw: str = ""
    mode: str = "and"
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    path_fallback: bool = True
    trigram: bool = False
    exact: bool = False  # words with their diacritics: "ón" is not "on"


def phrase_text(p: Q.Phrase, index: str) -> str:
    """The phrase as it stands in the text of the index: word, trigram, or exact (words with their diacritics)."""
    if index == "trigram":
        return "".join(p.parts).lower()
    return " ".join(t for part in p.parts for t in word_tokens(part, index == "word"))


def occurrences(text: Column, p: Q.Phrase, index: str) -> Column:
    """How often the phrase stands in the text, overlaps included; null where the phrase has no token."""
    wanted = phrase_text(p, index)
    if index == "trigram":
        if not wanted:
            return F.lit(None).cast("int")
        if len(wanted) < 3:
            return F.lit(0)
        pattern = "(?=" + java_literal(wanted) + ")"
        if p.first:
            pattern = "^" + pattern
    else:
        if not wanted:
            return F.lit(None).cast("int")
        pattern = ("^" if p.first else "(?<![^ ])") + "(?=" + java_literal(wanted) + ("" if p.prefix else "(?![^ ])") + ")"
    # contains() settles most rows without the regular expression
    return F.when(F.contains(text, F.lit(wanted)), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def near_counts(text: str, wants: list[list[str]], prefixes: list[bool], index: str, distance: int) -> list[int]:
    """For each phrase of a NEAR group, how many of its places take part: places of all phrases of which the last begins
    no more than `distance` tokens after each other one ends."""
    tokens = text.split(" ") if index != "trigram" else [text[i : i + 3] for i in range(max(len(text) - 2, 0))]
    places = []
    for want, prefix in zip(wants, prefixes, strict=True):
        n = len(want)
        hits = [i for i in range(len(tokens) - n + 1) if tokens[i : i + n - 1] == want[:-1] and (tokens[i + n - 1].startswith(want[-1]) if prefix else tokens[i + n - 1] == want[-1])] if want else []
        places.append(hits)
    taking: list[set[int]] = [set() for _ in places]
    for last in sorted({i for ps in places for i in ps}):
        sets = [{i for i in ps if last - len(w) - distance <= i <= last} for ps, w in zip(places, wants, strict=True)]
        if all(sets):
            for t, s in zip(taking, sets, strict=True):
                t |= s
    return [len(t) for t in taking]


def _near(text: Column, node: Q.Near, index: str) -> Column:
    """array<int> of near_counts; empty text for rows that lack a phrase, so only likely rows are searched."""
    wants = [word_tokens(" ".join(p.parts), index == "word") if index != "trigram" else [phrase_text(p, index)[i : i + 3] for i in range(max(len(phrase_text(p, index)) - 2, 0))] for p in node.phrases]
    prefixes = [p.prefix for p in node.phrases]
    likely = reduce(lambda a, b: a & b, [F.coalesce(occurrences(text, p, index) > 0, F.lit(False)) for p in node.phrases])

    @F.pandas_udf("array<int>")
    def counts(column):
        return column.map(lambda t: near_counts(t, wants, prefixes, index, node.distance) if t else [0] * len(wants))

    return counts(F.when(likely, text).otherwise(""))


def matched(node, counts: dict[int, Column], order: list) -> tuple[Column, dict[int, Column]]:
    """(whether a row matches, occurrences that count): a phrase counts where all nodes above it match."""
    if isinstance(node, Q.Nothing):
        return F.lit(False), {}
    if isinstance(node, Q.Phrase):
        k = order.pop(0)
        hit = F.coalesce(counts[k] > 0, F.lit(False))
        return hit, {k: F.when(hit, counts[k]).otherwise(0)}
    if isinstance(node, Q.Near):
        ks = [order.pop(0) for _ in node.phrases]
        hit = reduce(lambda a, b: a & b, [F.coalesce(counts[k] > 0, F.lit(False)) for k in ks])
        return hit, {k: F.when(hit, counts[k]).otherwise(0) for k in ks}
    if isinstance(node, Q.Not):
        keep, tf = matched(node.keep, counts, order)
        drop, _ = matched(node.drop, counts, order)
        hit = keep & ~drop
        return hit, {k: F.when(hit, c).otherwise(0) for k, c in tf.items()}
    parts = [matched(x, counts, order) for x in node.items]
    hits = [h for h, _ in parts]
    hit = reduce((lambda a, b: a & b) if isinstance(node, Q.And) else (lambda a, b: a | b), hits)
    return hit, {k: F.when(hit, c).otherwise(0) for _, tf in parts for k, c in tf.items()}


def rank_pages(pages: DataFrame, node, index: str) -> DataFrame:
    """pages that match, with `rank` (BM25, lower is better). pages needs search_text."""
    text = fold(F.col("search_text")) if index == "word" else F.col("search_text")
    all_phrases = Q.phrases(node)
    held = pages.withColumn("__t", F.coalesce(text, F.lit("")))
    words = F.when(F.col("__t") == "", 0).otherwise(F.size(F.split("__t", " ")))
    held = held.withColumn("__dl", words if index != "trigram" else F.greatest(F.length("__t") - 2, F.lit(0)))
    held = held.withColumns({f"__n{k}": occurrences(F.col("__t"), p, index) for k, p in enumerate(all_phrases)})
    df_of = {k: F.col(f"__n{k}") for k in range(len(all_phrases))}
    tf_of = dict(df_of)
    k = 0
    for near in nears(node):  # NEAR limits which places count, not in how many rows a phrase is
        k = near[1]
        held = held.withColumn(f"__near{k}", _near(F.col("__t"), near[0], index))
        tf_of |= {k + j: F.get(F.col(f"__near{k}"), F.lit(j)) for j in range(len(near[0].phrases))}
    stats = held.agg(F.count(F.lit(1)).alias("__all"), F.avg("__dl").alias("__avg"), *[F.sum((F.coalesce(c, F.lit(0)) > 0).cast("long")).alias(f"__df{k}") for k, c in df_of.items()])
    hit, tf = matched(node, tf_of, list(range(len(all_phrases))))
    rows = held.where(hit).crossJoin(F.broadcast(stats))  # stats is one row
    return rows.withColumn("rank", bm25(tf)).select(*pages.columns, "rank")


def bm25(tf: dict[int, Column]) -> Column:
    """Negative BM25 from phrase counts and the columns __df<k>, __all, __dl, __avg."""
    rank = F.lit(0.0)
    for k, c in tf.items():
        n = F.col(f"__df{k}")
        idf = F.ln((F.col("__all") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        c = F.coalesce(c, F.lit(0))
        rank = rank - idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("__dl") / F.col("__avg")))
    return rank


def nears(node) -> list[tuple[Q.Near, int]]:
    """NEAR groups with the number of their first phrase."""
    out, seen = [], []

    def walk(x) -> None:
        if isinstance(x, Q.Phrase):
            seen.append(x)
        elif isinstance(x, Q.Near):
            out.append((x, len(seen)))
            seen.extend(x.phrases)
        elif isinstance(x, (Q.And, Q.Or)):
            for y in x.items:
                walk(y)
        elif isinstance(x, Q.Not):
            walk(x.keep)
            walk(x.drop)

    walk(node)
    return out


def with_search_text(pages: DataFrame) -> DataFrame:
    return pages if "search_text" in pages.columns else pages.withColumn("search_text", normalize("markdown"))


def live(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, content_id, page_count) of documents that aren't deleted."""
    named = contents.select(F.col("id").alias("content_id"), "page_count")
    return documents.where(~F.col("deleted")).select("path", "content_id").join(named, "content_id")


#: Rows up to which a page of results is broadcast to the texts; a longer one is joined by whatever join suits.
BROADCAST_ROWS = 4096


def leg(pages: DataFrame, documents: DataFrame, contents: DataFrame, node, index: str, fetch: int, indexes=None) -> DataFrame:
    """The best rows of one index: (path, content_id, page_index, page_count, rank, search_source). Posting tables are of
    folded words, so exact ones are sought in the texts."""
    from .postings import rank

    ranked = rank(indexes.of(index), node) if indexes and index != "exact" else rank_pages(with_search_text(pages).select("content_id", "page_index", "search_text"), node, index)
    out = ranked.select("content_id", "page_index", "rank").join(live(documents, contents), "content_id")
    source = F.lit("trigram" if index == "trigram" else "fts").alias("search_source")
    return out.select("path", "content_id", "page_index", "page_count", "rank", source).orderBy("rank", "path", "page_index").limit(fetch)


def merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Both legs by (path, page_index): the lower rank wins, the primary on a tie."""
    both = primary.withColumn("__leg", F.lit(0)).unionByName(secondary.withColumn("__leg", F.lit(1)))
    order = F.struct("rank", "__leg")
    best = F.min_by(F.struct("content_id", "page_count", "rank", "search_source"), order).alias("b")
    return both.groupBy("path", "page_index").agg(best).select("path", "b.content_id", "page_index", "b.page_count", "b.rank", "b.search_source")


def path_matches(documents: DataFrame, contents: DataFrame, tokens: list[str], mode: str, fetch: int) -> DataFrame:
    """Live documents whose path has the tokens, as page 0 with rank 0."""
    found = live(documents, contents).where(path_has(F.col("path"), tokens, mode))
    page, rank, source = F.lit(0).alias("page_index"), F.lit(0.0).alias("rank"), F.lit("path").alias("search_source")
    return found.select("path", "content_id", page, "page_count", rank, source).orderBy("path").limit(fetch)


def texts_of(page: DataFrame, pages: DataFrame, limit: int, block: int = 0) -> DataFrame:
    """page with search_text. Where pages lie in folders by `block`, so many content ids, only the folders of the page's rows
    are read: the rows are broadcast, and their blocks prune the scan while it runs."""
    keys, wanted = ["content_id", "page_index"], page.where(F.col("search_source") != "path").select("content_id", "page_index")
    few = F.broadcast if limit <= BROADCAST_ROWS else lambda x: x
    held = with_search_text(pages)
    if block:
        wanted, held = wanted.withColumn("block", block_of(F.col("content_id"), block)), held.select("block", *keys, "search_text")
    texts = held.join(few(wanted), wanted.columns, "left_semi").select(*keys, "search_text")
    return page.join(few(texts), keys, "left")


def append_missing(found: DataFrame, more: DataFrame) -> DataFrame:
    """found, then the rows of more whose path is not among them; `__late` tells which."""
    late = more.join(found.select("path"), "path", "left_anti").dropDuplicates(["path"])
    return found.withColumn("__late", F.lit(0)).unionByName(late.withColumn("__late", F.lit(1)))


def find(pages: DataFrame, documents: DataFrame, contents: DataFrame, options: Options, snippets: bool = True, indexes=None) -> DataFrame:
    """Ranked results in order: (path, page_index, page_count, snippet, rank, search_source). indexes: the posting
    tables (see postings.py); without, the legs read the texts."""
    mode = search_mode(options.mode)
    limit = options.limit if options.limit > 0 else DEFAULT_LIMIT
    offset = max(options.offset, 0)
    fetch = min(limit + offset, 2**31 - 1)
    tokens = options.query.split()
    node = Q.parse(options.raw) if options.raw.strip() else Q.from_arguments(options.query, mode)
    spark = pages.sparkSession
    if node is None:
        return spark.createDataFrame([], FOUND)
    words = "exact" if options.exact else "word"
    found = leg(pages, documents, contents, node, words, fetch, indexes)
    if options.trigram:
        found = merge(found, leg(pages, documents, contents, node, "trigram", fetch, indexes))
    found = found.withColumn("__late", F.lit(0))
    if options.path_fallback and tokens:
        ahead = found.drop("__late")
        found = append_missing(ahead, path_matches(documents, contents, tokens, mode, fetch))
    page = found.orderBy("__late", "rank", "path", "page_index").offset(offset).limit(limit)
    if snippets:
        ship_package(spark)
        wanted = {i: [(phrase_text(p, i), p.prefix, p.first) for p in Q.phrases(node)] for i in (words, "trigram")}
        page = texts_of(page, pages, limit, indexes.block if indexes else 0)
        page = page.withColumn("snippet", F.when(F.col("search_source") == "path", F.lit("")).otherwise(snippet_udf(wanted[words], wanted["trigram"], SNIPPET_TOKENS, options.exact)("search_text", "search_source")))
        page = page.orderBy("__late", "rank", "path", "page_index")
    else:
        page = page.withColumn("snippet", F.lit(""))
    return page.select("path", "page_index", "page_count", "snippet", "rank", "search_source")


def multi_find(pages: DataFrame, documents: DataFrame, contents: DataFrame, probes: list[Options], snippets: bool = True, indexes=None) -> DataFrame:
    """Several probes at once: each (path, page) once, from fts before trigram before path, then by rank."""
    legs = [find(pages, documents, contents, p, snippets, indexes).withColumn("__probe", F.lit(k)) for k, p in enumerate(probes)]
    every = reduce(lambda a, b: a.unionByName(b), legs)
    place = F.element_at(F.create_map(F.lit("fts"), F.lit(0), F.lit("trigram"), F.lit(1), F.lit("path"), F.lit(2)), F.col("search_source"))
    w = Window.partitionBy("path", "page_index").orderBy(place, "rank", "__probe")
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__probe")
