"""LM scoring by context-tree weighting over bytes, beside a smoothed word unigram.

Each byte is eight binary decisions; each decision has a tree of the last 0 to `DEPTH` bytes as context. A tree node
holds how often the decision went 0 and 1 in the training texts. Its Krichevsky-Trofimov estimate is weighted half and
half with the product of its children (deeper contexts), bottom-up; the weights that this gives mix the estimates of all
depths top-down into one probability for each decision. Texts end with a zero byte and begin after DEPTH of them.

Nothing about the corpus is gathered in one place: counts are per (block of rows, key), summed by key, and each block's
own words and byte strings are sent back to it with their values. A block's texts come in packs, one at a time, so a task
holds one block's vocabulary and a pack.

Defined cases: null and empty texts have one token, the end; a null id is not held out; with no training texts every
estimate is uniform; repeated rows and ids are scored each on its own; an empty table gives an empty result; texts of any
length are read whole; blocks go by file and place (input that is no file is written once).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, block_of, counted_by_block, each_pack, look_up, packed, settled, ship_package, with_answers
from .vectext import chunks, lower_ascii, span_hashes, words

DEPTH = 4
WORD, GRAM = 0, 1


def byte_grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every byte and of the zero that ends each row: the last DEPTH bytes and this one, as a long."""
    n = len(offs) - 1
    lens = np.diff(offs) + 1
    row = np.repeat(np.arange(n), lens)
    first = np.cumsum(lens) - lens
    ext = np.zeros(int(lens.sum()), np.int64)
    place = np.arange(len(ext)) - first[row]
    inside = place < lens[row] - 1
    ext[inside] = data
    gram = ext.copy()
    for k in range(1, DEPTH + 1):
        back = np.zeros(len(ext), np.int64)
        back[k:] = ext[: len(ext) - k]
        gram |= np.where(place >= k, back, 0) << (8 * k)
    return gram, row


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, A-Z lower-cased."""
    low = lower_ascii(data)
    row, start, end = words(low, offs)
    return span_hashes(low, start, end).view(np.int64), row


def block_counts(src: DataFrame) -> DataFrame:
    """(block, kind, key, n): the words and grams of each block of rows, and how often its training texts have them."""

    def parts(batch: pa.RecordBatch):
        train = (~batch.column("held").to_numpy(zero_copy_only=False)).astype(float)
        for lo, _, data, offs in chunks(batch.column("text")):
            for kind, (keys, row) in ((WORD, word_keys(data, offs)), (GRAM, byte_grams(data, offs))):
                u, at = np.unique(keys, return_inverse=True)
                yield kind, u, np.bincount(at, train[lo + row], len(u)).astype(np.int64)

    return counted_by_block(src.select("block", "held", "text"), parts, "block long, kind byte, key long, n long")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 0.5 (Stirling's series at x + 8)."""
    z, shift = x + 8, x
    for k in range(1, 8):
        shift = shift * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.ln(shift)


def decisions(grams: DataFrame, *keep: str) -> DataFrame:
    """Each gram's eight decisions: (keep..., ctx, node, bit); node is 1 and then the bits before, as a binary number."""
    sym, i = F.col("key").bitwiseAND(F.lit(255)), F.col("i")
    out = grams.select(*keep, "key", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    node = F.expr("shiftleft(1L, i) | shiftrightunsigned(key & 255L, 8 - i)")
    bit = F.expr("shiftrightunsigned(key & 255L, 7 - i) & 1L")
    return out.select(*keep, F.shiftrightunsigned("key", 8).alias("ctx"), node.cast("int").alias("node"), bit.cast("int").alias("bit"))


def tree(grams: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """By depth: (ctx, node, acc, rem): the probability of a 1 mixed down to this depth, and the weight left for deeper."""
    n = lambda bit: F.sum(F.when(F.col("bit") == bit, F.col("n")).otherwise(0)).cast("double")
    level = decisions(grams, "n").groupBy("ctx", "node").agg(n(0).alias("a"), n(1).alias("b"), F.lit(0.0).alias("deep"))
    levels = []
    half = math.log(0.5)
    for d in range(DEPTH, -1, -1):
        kt = log_gamma(F.col("a") + 0.5) + log_gamma(F.col("b") + 0.5) - log_gamma(F.col("a") + F.col("b") + 1) - math.log(math.pi)
        level = level.withColumn("kt", kt)
        both = F.greatest("kt", "deep") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("deep"))))
        level = level.withColumn("all", F.col("kt") if d == DEPTH else F.lit(half) + both)
        level = level.withColumn("w", F.lit(1.0) if d == DEPTH else F.exp(F.lit(half) + F.col("kt") - F.col("all")))
        level = scratch.write(level.select("ctx", "node", "a", "b", "all", "w"))
        levels.insert(0, level)
        mask = (1 << 8 * (d - 1)) - 1 if d else 0
        level = level.groupBy(F.col("ctx").bitwiseAND(F.lit(mask).cast("long")).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("all").alias("deep"))
    out = []
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    for d, level in enumerate(levels):
        if d:
            above = out[-1].select(F.col("ctx").alias("up"), "node", F.col("acc").alias("acc0"), F.col("rem").alias("rem0"))
            level = level.withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1).cast("long"))).join(above, ["up", "node"])
        else:
            level = level.withColumn("acc0", F.lit(0.0)).withColumn("rem0", F.lit(1.0))
        out.append(scratch.write(level.select("ctx", "node", (F.col("acc0") + F.col("rem0") * F.col("w") * one).alias("acc"), (F.col("rem0") * (1 - F.col("w"))).alias("rem"))))
    return out


def gram_scores(grams: DataFrame, nodes: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(key, value): log10 of the probability of each gram's last byte after its context, for grams seen or not."""
    left, found = scratch.write(decisions(grams, "key")), []
    for d in range(DEPTH, -1, -1):
        mask = F.lit((1 << 8 * d) - 1).cast("long")
        at = left.withColumn("c", F.col("ctx").bitwiseAND(mask)).join(nodes[d].withColumnRenamed("ctx", "c"), ["c", "node"], "left")
        at = scratch.write(at.select("key", "ctx", "node", "bit", (F.col("acc") + 0.5 * F.col("rem")).alias("one")))
        found.append(at.where("one is not null"))
        left = at.where("one is null").select("key", "ctx", "node", "bit")
    found.append(left.withColumn("one", F.lit(0.5)))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    p = F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))
    return every.groupBy("key").agg(F.sum(F.log10(p)).alias("value"))


def held_out(id_col: str) -> Column:
    """The op6 contract's fold, which no training sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each document."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "ctw")
    docs = settled(docs, scratch)
    source = dict(scratch.tables)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), text.alias("text"), block_of(docs, text).alias("block"))
    counted = scratch.write(block_counts(src))
    by_key = scratch.write(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    seen = by_key.where(F.col("kind") == WORD).agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    n_ends = src.where(~F.col("held")).count()
    n_train, n_distinct = int(seen[0] or 0) + n_ends, int(seen[1] or 0) + (n_ends > 0)
    grams = by_key.where(F.col("kind") == GRAM)
    nodes = tree(grams.where("n > 0").select("key", "n"), scratch)
    values = gram_scores(grams.select("key"), nodes, scratch)
    values = by_key.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(values.select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value"))
    values = scratch.write(values)
    scratch.free(counted, values, *source.values())
    answers = counted.select("kind", "block", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    total = n_train + 0.1 * (n_distinct + 1)

    def scored(batches):
        for known, rows in each_pack(batches):
            rows = rows.to_batches()[0]
            words_of, grams_of = (known.get(k, (np.zeros(0, np.int64), np.zeros(0))) for k in (WORD, GRAM))
            for lo, hi, data, offs in chunks(rows.column("text")):
                n, part = hi - lo, rows.slice(lo, hi - lo)
                keys, row = word_keys(data, offs)
                c = look_up(words_of, keys)
                tokens, hits = np.bincount(row, minlength=n) + 1, np.bincount(row[c > 0], minlength=n) + (n_ends > 0)
                base = np.bincount(row, np.log10((c + 0.1) / total), n) + math.log10((n_ends + 0.1) / total)
                keys, row = byte_grams(data, offs)
                lp = np.bincount(row, look_up(grams_of, keys), n)
                longs = [pa.array(x, pa.int64()) for x in (tokens, hits, np.full(n, n_train))]
                doubles = [pa.array(x, pa.float64()) for x in (base, lp, -lp / math.log10(2) / (np.diff(offs) + 1))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), *longs, *doubles], names=out_names)

    out_names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = with_answers(packed(src, "text"), answers).mapInArrow(scored, schema)
    return out.withColumnRenamed("id", id_col)
