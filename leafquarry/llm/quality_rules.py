"""Quality rules: counts over words and lines, and perplexity bands of a modified Kneser-Ney character model.

The model has orders 1 to 4 over UTF-16 code units (a code point beyond 16 bits is a pair of them, which nothing else is), so
a 4-gram is exactly a long and no character shares another's counts. Spark counts the grams of blocks of rows and derives continuation counts, discounts, and interpolated
probabilities order by order. The tables stay whole, in Spark: each block gets its own grams' values back by a join and
holds them as sorted arrays, where its texts look them up.

No text may vouch for itself, or a text that nothing else resembles would look likely. So the texts are dealt into halves by
their hash (copies are in the same half), each half has a model of its own, whole and summing to one, and a text is scored
by the model of the other half.

A document's bits per character (code unit) must lie in its language's band: the median -/+ `width` times the middle distance on
that side, which is taken times the root of the document's characters, since a mean over more of them scatters less. The
median is exact over all documents to STEP bits and the distances to 1 %. Nothing but that step widens a band.

Defined cases: null and empty texts have no words and fail the base rules; a null language is a language of its own; a
language with one document has a band around it; repeated rows and ids are judged each on its own; an empty table gives
an empty result; where a half has no text, its model gives all symbols the same; texts of any length are read whole; only
the id, text and language columns are read; rows are told apart by file and place (input that is no file is written once).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, block_of, counted_by_block, each_pack, free_name, look_up, packed, row_key, settled, ship_package, with_answers
from .vectext import chunks, mix, span_hashes, windows, words

ORDER = 4
# Fixed values of the op9 contract.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
STEP = 1 / 500  # bits a character
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set within each row's bytes."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(offs) - 1
    row, start, end = words(data, offs)
    out = {"n_words": np.bincount(row, minlength=n)}
    lead = (data & 0xC0) != 0x80  # first bytes of code points
    lead_sum = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    out["word_chars"] = np.bincount(row, lead_sum[end] - lead_sum[start], n).astype(np.int64)
    out["n_symbols"] = per_row(_IS_SYMBOL[data], offs)
    # lines that have a word: from a row's start or a line feed to the next
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    has = np.unique(np.searchsorted(starts, start, "right") - 1) if len(start) else np.zeros(0, np.int64)
    bounds = np.concatenate([starts[1:], [len(data)]])
    ends = bounds - ((bounds > 0) & (data[np.maximum(bounds - 1, 0)] == 10)) if len(data) else bounds
    line_row = np.searchsorted(offs, starts[has], "right") - 1
    line = span_hashes(data, starts[has], ends[has])
    keyed = mix(line ^ mix(line_row.astype(np.uint64) + np.uint64(1)))
    first = np.unique(keyed, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)
    # words of windows that stand twice or more in their row
    at, h = windows(span_hashes(data, start, end), row, WINDOW)
    keyed = mix(h ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed)
    s = keyed[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    again = at[order[(same[1:] | same[:-1])[: len(s)]]]
    edge = np.bincount(again, minlength=len(row) + 1) - np.bincount(np.minimum(again + WINDOW, len(row)), minlength=len(row) + 1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(edge)[: len(row)] > 0], minlength=n)
    return out


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams as longs, row of each): the 4-gram that ends at each character; rows begin with three zeros."""
    lead = (data & 0xC0) != 0x80
    n_chars = per_row(lead, offs) + per_row(data >= 0xF0, offs)  # four bytes make a pair
    sym = np.frombuffer(data.tobytes().decode().encode("utf-16-le"), np.uint16).astype(np.uint64)
    row = np.repeat(np.arange(len(n_chars)), n_chars)
    first = np.cumsum(n_chars) - n_chars
    place = np.arange(len(sym)) - first[row]
    gram = sym.copy()
    for k in range(1, ORDER):
        back = np.zeros(len(sym), np.uint64)
        back[k:] = sym[: len(sym) - k]
        gram |= np.where(place >= k, back, 0) << np.uint64(16 * k)
    return gram.view(np.int64), row


def gram_counts(src: DataFrame) -> DataFrame:
    """(block, kind, key, n): the grams of each block of rows; kind is the half that its texts belong to."""

    def parts(batch: pa.RecordBatch):
        half = batch.column("half").to_numpy()
        for h in np.unique(half).tolist():
            for _, _, data, offs in chunks(batch.column("text").filter(pa.array(half == h))):
                yield h, *np.unique(symbols(data, offs)[0], return_counts=True)

    return counted_by_block(src.select("block", "half", "text"), parts, "block long, kind byte, key long, n long")


def discounts(t: DataFrame) -> list[tuple[float, float, float]]:
    """Of each half's counts, what modified Kneser-Ney takes off a count of one, of two and of more."""
    n = t.agg(*[F.sum((F.col(f"c{h}") == k).cast("long")) for h in (0, 1) for k in (1, 2, 3, 4)]).first()
    out = []
    for h in (0, 1):
        of = [x or 0 for x in n[4 * h : 4 * h + 4]]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        # where no gram has such a count the formula has no value: half of the count then; never all of it or nothing
        out.append(tuple(min(max(0.1, k - (k + 1) * y * of[k] / of[k - 1]), k - 0.1) if of[k - 1] and of[k] else k * 0.5 for k in (1, 2, 3)))
    return out


def gram_scores(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, s0, s1): log2 of the probability of each gram's last symbol after the others, by the model of the texts of
    the other half than 0 and 1. Every gram of either half has a row, so one that a model never saw backs off exactly."""
    c = lambda h: F.sum(F.when(F.col("kind") == h, F.col("n")).otherwise(0))
    counts = {ORDER: scratch.write(counted.groupBy(F.col("key").alias("gram")).agg(c(0).alias("c0"), c(1).alias("c1")))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many one longer grams each stands
        seen = [F.sum((F.col(f"c{h}") > 0).cast("long")).alias(f"c{h}") for h in (0, 1)]
        counts[n] = scratch.write(counts[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram")).agg(*seen))
    lower = None
    for n in range(1, ORDER + 1):
        t = counts[n].withColumn("ctx", F.shiftrightunsigned("gram", 16))
        off = []
        for h, d in enumerate(discounts(counts[n])):
            k = F.col(f"c{h}")
            off.append(F.when(k == 0, 0.0).when(k == 1, d[0]).when(k == 2, d[1]).otherwise(d[2]))
        sums = [x for h in (0, 1) for x in (F.sum(f"c{h}").alias(f"total{h}"), F.sum(off[h]).alias(f"free{h}"))]
        t = t.join(t.groupBy("ctx").agg(*sums), "ctx")
        if lower is None:
            t = t.withColumns({"low0": F.lit(2.0**-16), "low1": F.lit(2.0**-16)})
        else:
            short = lower.select(F.col("gram").alias("suffix"), F.col("p0").alias("low0"), F.col("p1").alias("low1"))
            t = t.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))).join(short, "suffix")
        p = [F.when(F.col(f"total{h}") > 0, (F.col(f"c{h}") - off[h] + F.col(f"free{h}") * F.col(f"low{h}")) / F.col(f"total{h}")).otherwise(F.col(f"low{h}")) for h in (0, 1)]
        lower = scratch.write(t.select("gram", p[0].alias("p0"), p[1].alias("p1")))
    return lower.select("gram", F.log2("p1").alias("s0"), F.log2("p0").alias("s1"))


def _middle(table: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys..., at): the median of a whole number, from a histogram of at most some thousand bins a key."""
    bins = table.groupBy(*keys, F.round(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*keys).agg(F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("at"))


def bands(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, mid, below, above) over all documents with words: the median of bits, and the middle distance from it on
    either side, times the root of the document's characters."""
    scored = scored.where("n_words > 0")
    mid = scratch.write(_middle(scored, F.col("bits") / STEP, "lang").select("lang", (F.col("at") * STEP).alias("mid")))
    off = scored.join(mid, "lang").withColumn("off", F.col("bits") - F.col("mid")).where(F.abs("off") > STEP / 2)
    far = _middle(off.withColumn("side", F.col("off") > 0), 100 * F.log(F.abs("off") * F.sqrt("chars")), "lang", "side")
    side = lambda above: F.max(F.when(F.col("side") == above, F.exp(F.col("at") / 100)))
    return mid.join(far.groupBy("lang").agg(side(False).alias("below"), side(True).alias("above")), "lang", "left")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), width: float = 5.0) -> DataFrame:
    """(id, keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits, kept) of each document."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    others = [id_col, *keep]
    docs = settled(docs, scratch)
    source = dict(scratch.tables)
    text = F.coalesce(F.col(text_col), F.lit(""))
    half = F.pmod(F.xxhash64(text), F.lit(2)).cast("byte")
    language = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))  # null is apart from empty
    src = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(others)], language.alias("lang"), text.alias("text"), half.alias("half"), block_of(docs, text).alias("block"))
    counted = scratch.write(gram_counts(src))
    values = scratch.write(gram_scores(counted, scratch))
    scratch.free(counted, values, *source.values())
    value = F.when(F.col("kind") == 0, F.col("s0")).otherwise(F.col("s1"))
    answers = counted.select("block", "kind", F.col("key").alias("gram")).join(values, "gram").select("block", "kind", F.col("gram").alias("key"), value.alias("value"))
    kept_names = [f"c{k}" for k in range(len(others))] + ["lang"]

    def score(batches):
        for known, rows in each_pack(batches):
            rows = rows.to_batches()[0]
            half = rows.column("half").to_numpy()
            for lo, hi, data, offs in chunks(rows.column("text")):
                found = measures(data, offs)
                gram, row = symbols(data, offs)
                total = np.zeros(hi - lo)
                for h, table in known.items():
                    own = half[lo:hi][row] == h
                    total -= np.bincount(row[own], look_up(table, gram[own]), hi - lo)
                chars = np.bincount(row, minlength=hi - lo)
                made = [pa.array(found[k], pa.int64()) for k in names] + [pa.array(chars, pa.int64()), pa.array(total / np.maximum(chars, 1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*[rows.column(k).slice(lo, hi - lo) for k in kept_names], *made], names=out_names)

    out_names = [*kept_names, *names, "chars", "bits"]
    kinds = [docs.schema[c].dataType.simpleString() for c in others]
    schema = ", ".join([f"c{k} {t}" for k, t in enumerate(kinds)] + ["lang string"] + [f"{k} long" for k in [*names, "chars"]] + ["bits double"])
    scored = scratch.write(with_answers(packed(src, "text"), answers).mapInArrow(score, schema))
    scratch.free(scored, *source.values())
    band = scratch.write(bands(scored, scratch))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    reach = lambda side: STEP + width * F.coalesce(F.col(side), F.lit(0.0)) / F.sqrt("chars")
    out = scored.join(band, "lang", "left").withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("mid") - reach("below"), F.col("mid") + reach("above")), F.lit(False)))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], *names, "base_failed", "bits", "kept")


def passing(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    docs = settled(docs, Scratch(docs.sparkSession, "quality"))
    row = free_name(docs, "__row")
    numbered = docs.withColumn(row, row_key(docs))
    kept = quality_rules(numbered, id_col, keep=(row,), **settings).where("kept").select(row)
    return numbered.join(kept.hint("shuffle_hash"), row, "left_semi").drop(row)
