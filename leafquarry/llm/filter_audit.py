"""What each of several filters removes, alone and behind others, in every order they can be applied.

A document's failures make a mask, a bit for each filter. Spark counts the masks of each part: all documents, those labelled
good and those labelled toxic. These histograms are the rows of an integer matrix with a column for each mask; multiplied by
fixed matrices with a column for each step of each order (32 by 600 for five filters) they give what is kept, removed,
redundantly failed, uniquely failed and lost, and, summed over the orders, each filter's Shapley share.

Duplicates: a document fails as one where a smaller id has the identical text (by its SHA-256). The smallest id of each text
is counted map-side first, and documents are joined to it by text and id together, so that a text which a third of all rows
share is no hot key. The histograms are summed within tasks, so a large part is none either.

Defined cases: a null text counts as empty (and equals other empty ones); a null part is the empty string; rows with a null
id are never duplicates and make no other row one; of rows with one id and text none is smaller, so all stay; an id that is
labelled several times is good or toxic where any label says so; labels without a document, and null labels, count nothing;
an empty table has no part and gives no row; texts of any length are taken whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_package
from .spans import let

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions of the op12 contract that look at one text: A short, B repetitive, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    few = let(words, lambda ws: F.struct((F.size(ws) < 100).alias("A"), (100 * F.size(F.array_distinct(ws)) < 80 * F.size(ws)).alias("B")))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)
    return {"AB": few, "C": capitals, "D": text.rlike("[#$%&*|]")}


def failing(docs: DataFrame, scratch: Scratch, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask) of each document under the five filters of the contract; A is bit 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = text_failures(text)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    held = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), *[c.alias(k) for k, c in found.items()])
    mask = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate(("AB.A", "AB.B", "C", "D"))), F.lit(0))
    held = scratch.write(held.select("id", "part", "same", mask.cast("int").alias("mask")))
    first = held.where("id is not null").groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    # of hashes alone and never small: by shuffle on text and id
    joined = held.join(first.hint("merge"), ["same", "id"], "left")
    later = F.col("id").isNotNull() & F.col("first").isNull()
    return joined.select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def histograms(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) from masks(id, part, mask) and labels(id, quality, toxic)."""
    said = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masks.join(said, "id", "left")
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def matrices(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """((order, step) of each column, matrices by outcome): rows are masks, entries 1 where the mask has the outcome there."""
    orders = ["".join(p) for p in permutations(letters)]
    columns = [(o, s) for o in orders for s in range(1, len(letters) + 1)]
    masks = np.arange(1 << len(letters))[:, None]
    own = np.array([1 << letters.index(o[s - 1]) for o, s in columns])
    before = np.array([sum(1 << letters.index(c) for c in o[: s - 1]) for o, s in columns])
    fails, gone = (masks & own) != 0, (masks & before) != 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    return columns, {k: v.astype(np.int64) for k, v in found.items()}


def interactions(hist: DataFrame, letters: str = "ABCDE", at_once: int = 16) -> DataFrame:
    """A row for each part, order of the letters and step, from histograms(); at_once parts are multiplied at a time."""
    ship_package(hist.sparkSession)
    parts = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # a row for each mask

    def run(batches: Iterator[pa.RecordBatch]):
        columns, of = matrices(letters)
        own = np.array([letters.index(o[s - 1]) for o, s in columns])
        order, step = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())
        for whole in batches:
            for lo in range(0, len(whole), at_once):
                b = whole.slice(lo, at_once)
                rows, m = b.column("rows").flatten(), len(b)
                stacked = np.zeros((3, m, 1 << len(letters)), np.int64)  # all, good, toxic
                at = np.repeat(np.arange(m), np.diff(b.column("rows").offsets.to_numpy()))
                for k, name in enumerate(("n", "good", "toxic")):
                    stacked[k, at, rows.field("mask").to_numpy()] = rows.field(name).to_numpy()
                every, good, toxic = stacked
                got = {k: every @ v for k, v in of.items()} | {"good_lost": good @ of["removed"], "toxic_lost": toxic @ of["removed"]}
                by_letter = np.stack([got["removed"][:, own == k].sum(axis=1) for k in range(len(letters))], axis=1)
                got["shapley"] = by_letter[:, own]
                take = pa.array(np.tile(np.arange(len(columns)), m))
                part = b.column("part").take(pa.array(np.repeat(np.arange(m), len(columns))))
                yield pa.RecordBatch.from_arrays([part, order.take(take), step.take(take), *[pa.array(got[c].ravel()) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """interactions() of the contract's five filters over docs."""
    scratch = Scratch(docs.sparkSession, "audit")
    return interactions(scratch.write(histograms(failing(docs, scratch, part_col, id_col, text_col), labels, id_col)))
