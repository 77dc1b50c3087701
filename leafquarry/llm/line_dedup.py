"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Lines with a word are the alphabet; a suffix starts at each of them and ends with its document. Level k gives each
suffix the rank of its first 2**k lines among all suffixes, by a range-partitioned sort of the pairs (rank of the first
half, rank of the second half): prefix doubling. Suffixes whose rank nobody shares are settled and leave. Suffixes with a
longest common prefix of at least m lines form one interval of the array; two overlapping ranks of level floor(log2 m)
name that interval, wherever in the array it lies, so no task scans the array across its ranges. A run is worth deleting
from `min_words` words on, so for each suffix the interval at the least such m is looked up, forward from its start and
backward from each line's end. A maximal repeated run of that many words is the union of the windows within it: each of its
lines is in the first or last such window that holds it, and each such window lies in an interval with an earlier place.
So the lines deleted are those of the maximal runs (tests hold them against a plain suffix array with its LCP intervals),
while doubling ends at the longest window instead of the longest run, which whole copies would stretch to a document.
In each interval the first copy (by id, then row, then line) stays and the later copies are deleted,
and so are the wordless lines between two deleted lines.

Defined cases: null and empty texts have no lines and stay as they are (null becomes empty); exact copies lose all their
lines, and `emptied` says so; ids may repeat or be null (nulls come first), rows are told apart by file and place (input
that is no file is written once); an empty table gives an empty result; texts of any length are read whole; other columns
pass through untouched, and the four new ones, which come last, get other names where theirs are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, row_key, settled, ship_package
from .vectext import chunks, mix, span_hashes, words

MIN_WORDS = 50


def line_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, words) of every line that has a word."""
    row, start, _ = words(data, offs)
    starts = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    of = np.searchsorted(starts, start, "right") - 1
    has, n = np.unique(of, return_counts=True)
    bounds = np.concatenate([starts[1:], [len(data)]])[has]
    ends = bounds - (data[bounds - 1] == 10)
    return np.searchsorted(offs, starts[has], "right") - 1, starts[has], ends, n


def shortest_windows(row: np.ndarray, n: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of the shortest windows of min_words words, from each line on and up to each line, within rows."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    row_end = np.searchsorted(row, row, "right")
    row_start = np.searchsorted(row, row, "left")
    s = np.arange(len(row))
    e = np.searchsorted(upto, upto[s] + min_words, "left")
    ahead = e <= row_end
    back = np.searchsorted(upto, upto[s + 1] - min_words, "right") - 1
    behind = back >= row_start
    first = np.concatenate([s[ahead], back[behind]])
    length = np.concatenate([(e - s)[ahead], (s + 1 - back)[behind]])
    both = np.unique(first * (len(row) + 1) + length)
    return both // (len(row) + 1), both % (len(row) + 1)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, pos, line, lens) of each line with a word: its hash, and the lengths of the windows that start there."""

    def cut(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                row, start, end, n = line_bounds(data, offs)
                first, length = shortest_windows(row, n, min_words)
                per = np.bincount(first, minlength=len(row))
                lens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(length, pa.int32()))
                pos = np.arange(len(row)) - np.searchsorted(row, row, "left")
                part = b.slice(lo, hi - lo)
                rows = part.column("row").take(pa.array(row))
                hashes = mix(span_hashes(data, start, end)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), rows, pa.array(pos, pa.int32()), pa.array(hashes), lens], names=["id", "row", "pos", "line", "lens"])

    kind, row_kind = (docs.schema[c].dataType.simpleString() for c in ("id", "row"))
    return docs.mapInArrow(cut, f"id {kind}, row {row_kind}, pos int, line long, lens array<int>")


def sorted_ranks(groups: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys..., rank): 1 + how many suffixes sort before, from groups(keys..., n), by a range-partitioned sort.

    A task numbers its own range; the ranges' sizes, one number each, give the offsets."""

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            before = seen + np.cumsum(n) - n
            seen += int(n.sum())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("n"), pa.array(before), pa.array(np.full(len(n), part), pa.int32())], names=[*keys, "n", "before", "part"])

    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = scratch.write(ordered.mapInArrow(number, ", ".join(f"{k} long" for k in keys) + ", n long, before long, part int"))
    sizes = sorted(tuple(r) for r in held.groupBy("part").agg(F.sum("n")).collect())  # one row a range
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    shift = scratch.spark.createDataFrame(offsets, "part int, shift long")
    return held.join(F.broadcast(shift), "part").select(*keys, (F.col("before") + F.col("shift") + 1).alias("rank"))


def later_copies(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(row, first, lines): windows of lines with a word that an earlier place has too. docs: id, row, text."""
    lines = scratch.write(_lines(docs, min_words))
    shared = scratch.write(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    ranked = sorted_ranks(shared, ["line"], scratch)
    level = scratch.write(lines.select("row", "pos", "line").join(scratch.write(ranked), "line").select("row", "pos", "rank"))
    wanted = lines.where(F.size("lens") > 0).select("id", "row", "pos", F.explode("lens").alias("m"))
    longest = wanted.agg(F.max("m")).first()[0] or 0
    found = []
    for k in range(longest.bit_length()):
        half = 1 << k
        here = wanted.where((F.col("m") >= half) & (F.col("m") < 2 * half))
        ends = level.select("row", F.col("pos").alias("last"), F.col("rank").alias("r2"))
        named = here.join(level.withColumnRenamed("rank", "r1"), ["row", "pos"]).withColumn("last", F.col("pos") + F.col("m") - half).join(ends, ["row", "last"])
        named = scratch.write(named.select("id", "row", "pos", "m", "r1", "r2"))
        interval = named.groupBy("m", "r1", "r2").agg(F.min(F.struct("id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        interval = scratch.write(interval.select("m", "r1", "r2", F.col("first.row").alias("row0"), F.col("first.pos").alias("pos0")))
        later = named.join(interval, ["m", "r1", "r2"]).where((F.col("row") != F.col("row0")) | (F.col("pos") != F.col("pos0")))
        found.append(scratch.write(later.select("row", F.col("pos").alias("first"), F.col("m").alias("lines"))))
        if 2 * half > longest or level.isEmpty():
            break
        after = level.select("row", (F.col("pos") - half).alias("pos"), F.col("rank").alias("b"))
        pairs = scratch.write(level.withColumnRenamed("rank", "a").join(after, ["row", "pos"]))
        groups = scratch.write(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        ranked = scratch.write(sorted_ranks(groups, ["a", "b"], scratch))
        level = scratch.write(pairs.join(ranked, ["a", "b"]).select("row", "pos", "rank"))
    out = docs.sparkSession.createDataFrame([], f"row {docs.schema['row'].dataType.simpleString()}, first int, lines int")
    for f in found:
        out = out.unionByName(f)
    return out


def cut_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """(text without the runs, lines with a word, how many of them went, runs as (first, end) among those lines)."""
    parts = text.split("\n")
    worded = [i for i, p in enumerate(parts) if p.strip(" \t\n\v\f\r")]
    merged: list[list[int]] = []
    for first, n in sorted(runs):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], first + n)
        else:
            merged.append([first, first + n])
    drop: set[int] = set()
    for first, end in merged:
        drop.update(range(worded[first], worded[end - 1] + 1))
    return "\n".join(p for i, p in enumerate(parts) if i not in drop), len(worded), sum(e - f for f, e in merged), [tuple(m) for m in merged]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut, and n_lines, n_removed, removed (array of first:end among the lines with a word), emptied."""
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    docs = settled(docs, scratch)
    source = dict(scratch.tables)
    row = free_name(docs, "__row")
    src = docs.withColumn(row, row_key(docs))
    runs = later_copies(src.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text")), min_words, scratch)
    spans = scratch.write(runs.groupBy("row").agg(F.collect_list(F.struct("first", "lines")).alias("runs")))
    scratch.free(spans, *source.values())

    spans = spans.withColumnRenamed("row", row)
    # always by shuffle: the spans grow with the corpus
    names = [free_name(docs, x) for x in ("n_lines", "n_removed", "removed", "emptied")]
    spot, got = free_name(docs, "__runs"), free_name(docs, "__cut")
    joined = src.join(spans.withColumnRenamed("runs", spot).hint("shuffle_hash"), row, "left")

    @F.arrow_udf("struct<text:string,n_lines:int,n_removed:int,removed:array<string>>")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
            if t is None or not found:
                out.append(None)
                continue
            left, lines, gone, parts = cut_lines(t, [(x["first"], x["lines"]) for x in found])
            out.append({"text": left, "n_lines": lines, "n_removed": gone, "removed": [f"{x}:{y}" for x, y in parts]})
        return pa.array(out, kind)

    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.list_(pa.string()))])
    # only texts with a run go to Python; in the others a match is a line from its first word on
    whole = F.coalesce(F.col(text_col), F.lit(""))
    done = joined.withColumn(got, cut(F.when(F.col(spot).isNotNull(), whole), F.col(spot)))
    lines = F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D][^\n]*+")).cast("int")
    hit = F.col(got).isNotNull()
    added = [F.when(hit, F.col(got)["n_lines"]).otherwise(lines), F.when(hit, F.col(got)["n_removed"]).otherwise(0), F.when(hit, F.col(got)["removed"]).otherwise(F.array().cast("array<string>")), F.coalesce(F.col(got)["n_removed"] == F.col(got)["n_lines"], F.lit(False))]
    columns = [F.when(hit, F.col(got)["text"]).otherwise(whole).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return done.select(*columns, *[c.alias(n) for c, n in zip(added, names, strict=True)])
