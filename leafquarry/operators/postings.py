"""Posting tables of both indexes, so that a query reads its own terms instead of all texts.

A posting is (term, content_id, page_index, dl, tf, positions): terms are words, or every three characters of a text, and
positions count from 0. Files are sorted by term, and each file's first and last term are known where a query is planned: it
opens the files its terms (or prefixes) fall into, and within them the row groups. Frequent terms are spread over files by
page. Single words need no positions, which are then not read; phrases, NEAR groups and substrings are intersections of
position lists shifted by their offsets, after the rarest term of each has picked the pages. Ranks are those of
search.rank_pages; texts are not read at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, word_tokens
from ..plans import query as Q
from ..shipping import ship_package
from .search import bm25, matched, nears, phrase_text

INDEXES = ("word", "trigram")
POSTING = "term string, content_id long, page_index int, dl int, tf int, positions array<int>"
#: Characters of text that are listed at a time; a longer text is listed alone.
PIECE = 1 << 20
#: Terms of a segment whose frequency is kept where queries are planned: those in over a hundredth of the pages, so many at
#: most. It decides the order of reading alone.
COMMON = 4096


@dataclass(frozen=True)
class File:
    """A file of postings, and the terms it begins and ends with."""

    path: str
    low: str
    high: str

    def holds(self, terms: list[str], starts: list[str]) -> bool:
        return any(self.low <= t <= self.high for t in terms) or any(self.high >= s and self.low[: len(s)] <= s for s in starts)


@dataclass(frozen=True)
class Postings:
    """One index over `total` pages that hold `length` tokens. Either files below `base`, less the dead (seg, content_id), or
    a frame of all postings."""

    index: str
    spark: SparkSession
    total: int
    length: int
    files: tuple[File, ...] = ()
    base: str = ""
    dead: DataFrame | None = None
    common: dict[str, int] = field(default_factory=dict)
    frame: DataFrame | None = None

    def lists(self, terms: list[str], starts: list[str]) -> DataFrame:
        """The postings of some terms and of all terms with some prefixes."""
        wanted = [F.col("term").isin(terms)] * bool(terms) + [F.col("term").startswith(s) for s in starts]
        wanted = reduce(lambda a, b: a | b, wanted, F.lit(False))
        return self.frame.where(wanted) if self.frame is not None else self._read([f.path for f in self.files if f.holds(terms, starts)], wanted)

    def every(self) -> DataFrame:
        """All postings."""
        return self.frame if self.frame is not None else self._read([f.path for f in self.files], F.lit(True))

    def _read(self, paths: list[str], wanted: Column) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], POSTING)
        rows = self.spark.read.schema(POSTING + ", seg string").option("basePath", self.base).parquet(*paths).where(wanted)
        if self.dead is not None:
            rows = rows.join(self.dead.select("seg", "content_id"), ["seg", "content_id"], "left_anti")
        return rows.select("term", "content_id", "page_index", "dl", "tf", "positions")


@dataclass(frozen=True)
class Indexes:
    """Both posting tables, and how many content ids share a folder of pages (0: pages have no such folders)."""

    word: Postings | None
    trigram: Postings | None
    block: int = 0

    def of(self, index: str) -> Postings:
        found = self.word if index == "word" else self.trigram
        if found is None:
            raise LookupError(f"the store keeps no {index} index")
        return found


# ---- building


def _grouped(page: np.ndarray, code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(page, code, positions) of each pair of a page and a code."""
    order = np.lexsort((code, page))
    page, code, place = page[order], code[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (code[1:] != code[:-1])])) if len(page) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return page[first], code[first], lists


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.ListArray, np.ndarray]:
    """(terms, their pages, positions, words of each page)."""
    cut = pc.split_pattern(texts, " ")
    sizes = np.diff(cut.offsets.to_numpy())
    named = cut.flatten().dictionary_encode()
    code = named.indices.to_numpy()
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    page = np.repeat(np.arange(len(texts)), sizes)
    real = pc.not_equal(named.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    page, code, lists = _grouped(page[real], code[real], place[real])
    return named.dictionary.take(pa.array(code)), page, lists, np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, sizes)


def _trigrams(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.ListArray, np.ndarray]:
    """As _words(), of every three characters."""
    held = texts.to_pylist()
    letters = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in held], np.int64)
    page = np.repeat(np.arange(len(held)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = place < np.repeat(sizes - 2, sizes)
    at = np.flatnonzero(real)
    code = (letters[at] << 42) | (letters[at + 1] << 21) | letters[at + 2] if len(at) else np.zeros(0, np.int64)
    page, code, lists = _grouped(page[at], code, place[at])
    distinct, which = np.unique(code, return_inverse=True)
    spelled = np.stack([distinct >> 42, (distinct >> 21) & 0x1FFFFF, distinct & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    terms = pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)], pa.string())
    return terms.take(pa.array(which)), page, lists, np.maximum(sizes - 2, 0)


def tokens_in(text: Column, index: str) -> Column:
    """How many tokens a page's text has."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " ", "")) + 1) if index == "word" else F.greatest(F.length(text) - 2, F.lit(0))


def listed(pages: DataFrame, index: str) -> DataFrame:
    """The postings of pages(content_id, page_index, search_text), in the pages' order."""
    ship_package(pages.sparkSession)
    text = F.coalesce(fold(F.col("search_text")) if index == "word" else F.col("search_text"), F.lit(""))

    def run(batches):
        cut = _words if index == "word" else _trigrams
        for b in batches:
            ends = np.cumsum(pc.utf8_length(b.column("t")).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(b):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + PIECE, "right")))
                part = b.slice(lo, hi - lo)
                terms, page, lists, sizes = cut(pa.array(part.column("t").to_pylist(), pa.string()))
                take = pa.array(page)
                tf = np.diff(lists.offsets.to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([terms, part.column("content_id").take(take), part.column("page_index").take(take), pa.array(sizes[page].astype(np.int32)), pa.array(tf), lists], names=["term", "content_id", "page_index", "dl", "tf", "positions"])
                lo = hi

    return pages.select("content_id", "page_index", text.alias("t")).mapInArrow(run, POSTING)


def sorted_by_term(rows: DataFrame, parts: tuple[int, ...] = ()) -> DataFrame:
    """parts: a number of partitions; without, the session's."""
    return rows.repartitionByRange(*parts, "term", "content_id", "page_index").sortWithinPartitions("term", "content_id", "page_index")


def build(pages: DataFrame, index: str) -> Postings:
    """The postings of all pages as a frame, nothing written."""
    n, length = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(tokens_in(F.col("search_text"), index)), F.lit(0))).first()
    return Postings(index, pages.sparkSession, n, length, frame=listed(pages, index))


# ---- queries


def _tokens(p: Q.Phrase, index: str) -> list[tuple[str, int, bool]]:
    """(term, offset, is a prefix) of terms that together are the phrase: each word, or trigrams that cover the text."""
    if index == "word":
        words = [t for part in p.parts for t in word_tokens(part)]
        return [(t, i, p.prefix and i == len(words) - 1) for i, t in enumerate(words)]
    text = phrase_text(p, index)
    return [(text[i : i + 3], i, False) for i in sorted({*range(0, len(text) - 2, 3), len(text) - 3})] if len(text) >= 3 else []


def _size_of(p: Q.Phrase, index: str) -> int:
    """The phrase's tokens, as NEAR counts them."""
    return len(_tokens(p, index)) if index == "word" else max(len(phrase_text(p, index)) - 2, 0)


def taking_part(starts: list[np.ndarray], sizes: list[int], distance: int) -> list[int]:
    """For each phrase of a NEAR group, how many of its places take part: places of all phrases of which the last begins no
    more than `distance` tokens after each other one ends."""
    lasts = np.unique(np.concatenate(starts))
    low = [np.searchsorted(s, lasts - n - distance) for s, n in zip(starts, sizes, strict=True)]
    high = [np.searchsorted(s, lasts, "right") for s in starts]
    full = reduce(np.logical_and, [h > a for a, h in zip(low, high, strict=True)])
    out = []
    for s, a, h in zip(starts, low, high, strict=True):
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, a[full], 1)
        np.add.at(cover, h[full], -1)
        out.append(int((np.cumsum(cover)[:-1] > 0).sum()))
    return out


def _near(node: Q.Near, starts: list[Column], index: str) -> Column:
    """array<int> of taking_part() from columns of positions."""
    sizes, distance = [_size_of(p, index) for p in node.phrases], node.distance
    kind = pa.list_(pa.int32())

    @F.arrow_udf("array<int>")
    def counts(*columns: pa.Array) -> pa.Array:
        held = [c.to_pylist() for c in columns]
        return pa.array([taking_part([np.sort(np.array(p, np.int64)) for p in row], sizes, distance) if all(row) else [0] * len(sizes) for row in zip(*held, strict=True)], kind)

    return counts(*starts)


def rank(postings: Postings, node) -> DataFrame:
    """(content_id, page_index, rank) of the pages that match."""
    index, phrases, groups = postings.index, Q.phrases(node), nears(node)
    tokens = [_tokens(p, index) for p in phrases]
    grouped = {k + j for g, k in groups for j in range(len(g.phrases))}
    placed = {(t, x) for k, (ts, p) in enumerate(zip(tokens, phrases, strict=True)) for t, _, x in ts if len(ts) > 1 or p.first or k in grouped}
    every = sorted({(t, x) for ts in tokens for t, _, x in ts})

    def lists(of: list[tuple[str, bool]]) -> DataFrame:
        return postings.lists([t for t, x in of if not x], [t for t, x in of if x])

    # of each phrase's terms the rarest, which the pages must have
    rarest = {min(ts, key=lambda t: (t[2], postings.common.get(t[0], 0), t[0]))[::2] for ts in tokens if ts}
    rest = [t for t in every if t not in rarest]
    rows = lists(sorted(rarest))
    if rest:
        rows = rows.unionByName(lists(rest).join(rows.select("content_id", "page_index"), ["content_id", "page_index"], "left_semi"))

    def held(key: tuple[str, bool]) -> Column:
        hit = F.col("term").startswith(key[0]) if key[1] else F.col("term") == key[0]
        return F.flatten(F.collect_list(F.when(hit, F.col("positions")))) if key in placed else F.sum(F.when(hit, F.col("tf")).otherwise(0)).cast("int")

    names = {key: f"__p{k}" for k, key in enumerate(every)}
    # dl is one to a page; as a key it leaves both uses of `found` with one and the same exchange
    found = rows.groupBy("content_id", "page_index", F.col("dl").alias("__dl")).agg(F.lit(1).alias("__one"), *[held(key).alias(names[key]) for key in every])
    starts: dict[int, Column] = {}
    counts: dict[int, Column] = {}
    for k, (p, ts) in enumerate(zip(phrases, tokens, strict=True)):
        if not ts:
            counts[k] = F.lit(0 if phrase_text(p, index) else None).cast("int")
        elif (ts[0][0], ts[0][2]) not in placed:
            counts[k] = F.col(names[ts[0][0], ts[0][2]])
        else:
            together = reduce(F.array_intersect, [F.transform(F.col(names[t, x]), _back(i)) for t, i, x in ts])
            starts[k] = F.filter(together, lambda x: x == 0) if p.first else together
            counts[k] = F.size(starts[k])
    found = found.withColumns({f"__n{k}": c for k, c in counts.items()})
    counts = {k: F.col(f"__n{k}") for k in counts}
    dfs = found.agg(*[F.coalesce(F.sum((F.coalesce(c, F.lit(0)) > 0).cast("long")), F.lit(0)).alias(f"__df{k}") for k, c in counts.items()])
    part = dict(counts)
    for g, k in groups:  # NEAR limits which places count, not in how many rows a phrase is
        own = range(k, k + len(g.phrases))
        if all(i in starts for i in own):
            found = found.withColumn(f"__near{k}", _near(g, [starts[i] for i in own], index))
            part |= {i: F.get(F.col(f"__near{k}"), F.lit(i - k)) for i in own}
    hit, tf = matched(node, part, list(range(len(phrases))))
    average = postings.length / postings.total if postings.total else 0.0
    rows = found.where(hit).crossJoin(F.broadcast(dfs))  # one row
    rows = rows.withColumns({"__all": F.lit(postings.total), "__avg": F.lit(float(average or 1))})
    return rows.select("content_id", "page_index", bm25(tf).alias("rank"))


def _back(i: int):
    return lambda x: x - i
