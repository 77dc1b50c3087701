"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage.

The index holds, for each term, its items in order with their BM25 impacts, cut into aligned blocks of BLOCK items with
each block's greatest impact; items are numbered by the score that retrieves them, so the items of a block need about the
same. Every passage (overlapping windows, twice the longest item, so each occurrence of an item lies whole in one) is a
query. An item is retrieved where its score reaches `share` of its score for itself. As in block-max WAND, bounds come
first and nothing above the threshold is lost:
- the pivot: with a passage's terms in order of their greatest impacts, those below the pivot can't reach the least need
  together, so an item must hold a term from the pivot on, and only those lists are walked, block by block;
- block maxima: blocks whose maxima (and, for the lists below the pivot, greatest impacts) stay under the block's need are
  skipped; in the others the lists below the pivot are probed for their block's own maximum, and bounded again;
- the postings of the blocks that remain are scored in full.
This runs set at a time, in arrays, for as many passages as have STEP list blocks between them, so the memory is bounded
whatever the number of items. Then question and answer must both overlap: the passage must hold the given shares of their
word 3-grams. An item's answer is its last sentence, or the second half of a lone sentence.

Words are lower-cased runs of letters, digits and non-ASCII, so punctuation and case make no difference. The index
is broadcast in shards of about SHARD_ITEMS items of ITEM_WORDS words at most (dealt by hash); document counts are global,
and a worker holds one shard at a time. Longer items are retrieved by pieces, of equal length, but judged as a whole, over
the passage and an item's length around it.

Defined cases: null and empty texts, of documents or items, match nothing; repeated items match each on its own; ties are
all reported; an empty table on either side gives no match; texts of any length are read whole; the columns of the
documents pass through, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import ragged
from .common import Scratch, free_name, ship_package
from .vectext import PUNCTUATION, buffers, chunks, span_hashes, windows, words

K1, B, BLOCK, GRAM = 1.2, 0.75, 8, 3
SHARD_ITEMS, ITEM_WORDS = 20_000, 512
#: List blocks that are bounded at once.
STEP = 1 << 20
#: Sums in another order may differ in the last place.
SLACK = 1 - 1e-9
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of lower-case text."""
    row, start, end = words(data, offs, PUNCTUATION)
    return row, span_hashes(data, start, end)


def text_hashes(text: str) -> np.ndarray:
    data, _ = buffers(lowered(pa.array([text])))
    return term_hashes(data, np.array([0, len(data)]))[1]


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer."""
    parts = [p for p in _SENTENCE.split(text) if len(text_hashes(p))]
    if len(parts) > 1:
        return text_hashes(" ".join(parts[:-1])), text_hashes(parts[-1])
    h = text_hashes(text)
    return h[: len(h) // 2], h[len(h) // 2 :]


def grams(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of runs of GRAM words, or of the whole when it is shorter."""
    if not len(h):
        return h
    return np.unique(windows(h, np.zeros(len(h), np.int64), min(GRAM, len(h)))[1])


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    peak: np.ndarray  # greatest impact of each term
    block_first: np.ndarray  # per term, where its blocks begin (one more at the end)
    block: np.ndarray  # block numbers by term
    block_key: np.ndarray  # term and block number as one sorted number
    block_peak: np.ndarray
    block_at: np.ndarray  # where each term block's postings begin (one more at the end)
    piece: np.ndarray  # postings by term and piece
    impact: np.ndarray
    need: np.ndarray  # per piece, the score from which it is retrieved
    block_need: np.ndarray  # per block, the least of these
    item: np.ndarray  # per piece, its item
    question: list  # per item
    answer: list
    around: list  # per item, the words around a passage that it is judged over: none for items of one piece
    length: int  # words of the longest piece


def build(rows: list[tuple], n_items: int, average: float, df: dict[int, int], share: float) -> Index:
    """rows: (id, text) of the shard's items; n_items, average and df are over all items."""
    ids, seqs, item, question, answer, around = [], [], [], [], [], []
    for i, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        h = text_hashes(text)
        if not len(h):
            continue
        n = -(-len(h) // ITEM_WORDS)
        seqs += np.array_split(h, n)
        item += [len(ids)] * n
        q, a = question_and_answer(text)
        ids.append(i)
        question.append(grams(q))
        answer.append(grams(a))
        around.append(len(h) if n > 1 else 0)
    scored = []
    for h in seqs:
        t, tf = np.unique(h, return_counts=True)
        n = np.array([df[int(x)] for x in t.view(np.int64)], float)
        idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
        scored.append((t, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / average))))
    order = sorted(range(len(seqs)), key=lambda k: (scored[k][1].sum(), k))
    z = np.zeros(0)
    term = np.concatenate([scored[k][0] for k in order]).astype(np.uint64) if order else np.zeros(0, np.uint64)
    impact = np.concatenate([scored[k][1] for k in order]) if order else z
    piece = np.repeat(np.arange(len(order)), [len(scored[k][0]) for k in order])
    need = share * np.bincount(piece, impact, len(order))
    by = np.lexsort((piece, term))
    term, piece, impact = term[by], piece[by], impact[by]
    terms, first = np.unique(term, return_index=True)
    of = np.searchsorted(terms, term)
    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (piece[1:] // BLOCK != piece[:-1] // BLOCK)])) if len(of) else np.zeros(0, np.int64)
    block = (piece[cut] // BLOCK).astype(np.int64)
    blocks = np.arange(0, len(order), BLOCK)
    return Index(
        ids=ids,
        terms=terms,
        peak=np.maximum.reduceat(impact, first) if len(first) else z,
        block_first=np.append(np.searchsorted(of[cut], np.arange(len(terms))), len(cut)).astype(np.int64),
        block=block,
        block_key=of[cut] * len(blocks) + block,
        block_peak=np.maximum.reduceat(impact, cut) if len(cut) else z,
        block_at=np.append(cut, len(term)).astype(np.int64),
        piece=piece,
        impact=impact,
        need=need,
        block_need=np.minimum.reduceat(need, blocks) if len(order) else z,
        item=np.array([item[k] for k in order], np.int64),
        question=question,
        answer=answer,
        around=around,
        length=max(map(len, seqs), default=0),
    )


def search(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, piece, score) of all pieces that reach their need, from the distinct (passage, term number) pairs."""
    z = np.zeros(0, np.int64)
    if not len(passage):
        return z, z, z.astype(float)
    by = np.lexsort((index.peak[term], passage))
    passage, term = passage[by], term[by]
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    upto = np.cumsum(index.peak[term])
    n = np.diff(np.append(first, len(term)))
    reach = upto - np.repeat(upto[first] - index.peak[term[first]], n)
    above = reach >= index.need.min() * SLACK  # from the pivot on
    pivot = first + np.add.reduceat(~above, first, dtype=np.int64)
    below = np.where(pivot > first, reach[np.maximum(pivot - 1, 0)], 0.0)  # what the lists below it can add
    cost = np.where(above, index.block_first[term + 1] - index.block_first[term], 0)
    cost = np.cumsum(np.add.reduceat(cost, first))
    out, lo = [], 0
    while lo < len(first):  # passages by the list blocks that they walk
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + STEP, "right")))
        out.append(_scored(index, term, first[lo:hi], pivot[lo:hi], np.append(first, len(term))[lo + 1 : hi + 1], below[lo:hi], passage[first[lo:hi]]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scored(index: Index, term: np.ndarray, first: np.ndarray, pivot: np.ndarray, end: np.ndarray, below: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search() of some passages: passage k has the terms first[k] to end[k], those from pivot[k] on above the pivot."""
    n_blocks = len(index.block_need)
    at = ragged(pivot, end - pivot)
    count = index.block_first[term[at] + 1] - index.block_first[term[at]]
    walked = ragged(index.block_first[term[at]], count)
    key = np.repeat(np.repeat(np.arange(len(first)), end - pivot), count) * n_blocks + index.block[walked]
    spots, of = np.unique(key, return_inverse=True)
    who, block = spots // n_blocks, spots % n_blocks
    bound = np.bincount(of, index.block_peak[walked], len(spots))
    least = index.block_need[block] * SLACK
    live = bound + below[who] >= least
    probes, probed = [], []
    left = np.flatnonzero(live)
    for lo in range(0, len(left), 1 << 15):  # the lists below the pivot, where their greatest impacts may still do
        s = left[lo : lo + (1 << 15)]
        n = (pivot - first)[who[s]]
        spot = np.repeat(s, n)
        key = term[ragged(first[who[s]], n)] * n_blocks + block[spot]
        found = np.minimum(np.searchsorted(index.block_key, key), len(index.block_key) - 1)
        hit = index.block_key[found] == key
        spot, found = spot[hit], found[hit]
        bound[s] += np.bincount(spot, index.block_peak[found], len(spots))[s]
        live[s] = bound[s] >= least[s]
        probes.append(found[live[spot]])
        probed.append(spot[live[spot]])
    go = live[of]
    entry = np.concatenate([walked[go], *probes])
    spot = np.concatenate([of[go], *probed])
    count = index.block_at[entry + 1] - index.block_at[entry]
    post = ragged(index.block_at[entry], count)
    key = np.repeat(who[spot], count) * len(index.need) + index.piece[post]
    pairs, of = np.unique(key, return_inverse=True)
    score = np.bincount(of, index.impact[post], len(pairs))
    piece = pairs % max(len(index.need), 1)
    hit = score >= index.need[piece] * SLACK
    return name[pairs // max(len(index.need), 1)][hit], piece[hit], score[hit]


def overlap(g: np.ndarray, held: np.ndarray) -> float:
    """The share of the grams of a question or an answer that the words hold."""
    if not len(g):
        return 1.0
    n = min(GRAM, len(held))
    none = np.zeros(len(held), np.int64)
    own = windows(held, none, n)[1]
    if len(g) == 1:  # a part shorter than GRAM words is one run: look for runs of any shorter length too
        own = np.concatenate([windows(held, none, m)[1] for m in range(1, n + 1)])
    return float(np.isin(g, own).mean())


def _matches(index: Index, row: np.ndarray, h: np.ndarray, rows: int, question: float, answer: float) -> list[list[dict]]:
    """Per row, its verified items, from (row, hash) of every word."""
    out: list[list[dict]] = [[] for _ in range(rows)]
    if not len(h) or not index.ids:
        return out
    stride = max(32, index.length)
    begin = np.searchsorted(row, np.arange(rows + 1))
    pos = np.arange(len(row)) - begin[row]
    t = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[t] == h)
    # passage k of a row holds its words from k * stride on, 2 * stride of them; numbered across rows
    base = np.concatenate([[0], np.cumsum(np.diff(begin) // stride + 1)])
    own = base[row[known]] + pos[known] // stride
    back = pos[known] >= stride
    pairs = np.unique(np.concatenate([own, own[back] - 1]) * len(index.terms) + np.concatenate([t[known], t[known][back]]))
    passage, piece, score = search(index, pairs // len(index.terms), pairs % len(index.terms))
    best: dict[tuple[int, int], dict] = {}
    for p, k, s in zip(passage.tolist(), index.item[piece].tolist(), score.tolist(), strict=True):
        r = int(np.searchsorted(base, p, "right")) - 1
        lo = begin[r] + (p - base[r]) * stride
        held = h[max(lo - index.around[k], begin[r]) : min(lo + 2 * stride + index.around[k], begin[r + 1])]
        share = [overlap(g[k], held) for g in (index.question, index.answer)]
        if share[0] >= question and share[1] >= answer:
            old = best.get((r, k))
            if old is None or old["score"] < s:
                best[r, k] = {"item_id": index.ids[k], "score": s, "question_overlap": share[0], "answer_overlap": share[1]}
    for (r, _), found in sorted(best.items(), key=lambda x: x[0]):
        out[r].append(found)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, question: float = 0.5, answer: float = 0.5, leaks_col: str = "leaks") -> DataFrame:
    """docs and one more column, leaks: array of (item_id, score, question_overlap, answer_overlap)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "items")
    leaks_col = free_name(docs, leaks_col)
    kind = items.schema[item_id].dataType.simpleString()
    src = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))

    def terms(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(lowered(b.column("text"))):
                row, h = term_hashes(data, offs)
                n = np.bincount(row, minlength=hi - lo)
                each = [np.unique(h[e - c : e]).view(np.int64) for e, c in zip(np.cumsum(n), n, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(n, pa.int64()), pa.array(each, pa.list_(pa.int64()))], names=["id", "text", "n", "terms"])

    held = scratch.write(src.mapInArrow(terms, f"id {kind}, text string, n long, terms array<long>").where("n > 0"))
    n_items, average = held.agg(F.count(F.lit(1)), F.avg("n")).first()
    shards = max(1, -(-held.agg(F.sum(F.ceil(F.col("n") / ITEM_WORDS))).first()[0] // SHARD_ITEMS)) if n_items else 0
    df = scratch.write(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    shared = []
    for k in range(shards):  # one shard at a time in the driver's memory too
        mine = held.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        counts = df.join(mine.select(F.explode("terms").alias("term")).distinct(), "term")
        rows = [tuple(r) for r in mine.select("id", "text").collect()]
        shared.append(spark.sparkContext.broadcast(build(rows, n_items, average, {r.term: r.df for r in counts.collect()}, share)))
    scratch.free()
    return _searched(docs, shared, kind, text_col, leaks_col, question, answer)


def _searched(docs: DataFrame, shards: list, kind: str, text_col: str, leaks_col: str, question: float, answer: float) -> DataFrame:
    names = [f"c{k}" for k in range(len(docs.columns) + 1)]
    at = docs.columns.index(text_col)
    found_type = pa.list_(pa.struct([("item_id", to_arrow_type(docs.sparkSession.createDataFrame([], f"i {kind}").schema["i"].dataType)), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(batches):
        for b in batches:
            split = []
            for lo, hi, data, offs in chunks(lowered(b.column(at))):
                split.append((lo, hi, *term_hashes(data, offs)))
            found: list[list[dict]] = [[] for _ in range(len(b))]
            for shared in shards:
                for lo, hi, row, h in split:
                    for k, more in enumerate(_matches(shared.value, row, h, hi - lo, question, answer)):
                        found[lo + k] += more
                if len(shards) > 1:  # read again for the next batch, from the worker's own disk
                    shared.__dict__.pop("_value", None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, found_type)], names=names)

    schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)] + [f"c{len(docs.columns)} array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double>>"])
    return docs.toDF(*names[:-1]).mapInArrow(run, schema).toDF(*docs.columns, leaks_col)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): a row for each document and item that it holds."""
    found = find_leaks(docs.select(F.col(id_col).alias("id"), F.col(settings.pop("text_col", "text")).alias("text")), items, **settings)
    out = found.select("id", F.explode("leaks").alias("leak")).select("id", "leak.*")
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    name = free_name(docs, "leaks")
    return find_leaks(docs, items, leaks_col=name, **settings).where(F.size(name) == 0).drop(name)
