"""Shards of near equal size by sampled splitters; DataFrame functions only.

Rows are ordered by a key: the MD5 of the text, then the id, then the row's file and place. So equal texts stand together,
and a group of them of any size still has a place to be cut at. A sample of keys is drawn, each row weighted by its share of
all bytes and of all rows; its quantiles split the key range into `ranges` ranges, and ranges that come out overfull are
split again by a sample of their own. Rows are dealt out by range, numbered and summed within, and offset by the sums of the
ranges before, which gives each row its exact place in bytes and rows of the whole order, whatever the splitters were.

Law `bytes`: shard = where the middle of a row lies among all bytes. A group of equal texts goes whole to where its own
middle lies, unless it holds more than `slack` of a shard's bytes or rows; such a group is cut at rows. So a shard's bytes
differ from an equal part by at most slack / 2, or half a row, at either end.

Sizes: the sample has about `ranges` times `draws` rows, the splitters and the ranges' sums at most a few times `ranges`
rows, whatever the input; these alone are broadcast or meet in one task.

Defined cases: a null text has no bytes and stands with empty ones; a null id comes first among equal texts; rows equal in
text and id are ordered by file and place (their shards and slots may be exchanged with no difference in the result); a row
larger than a shard's part makes its neighbours' shards smaller or empty; fewer rows than shards leave shards empty; an
empty table gives an empty result; other columns are not read. Input that is no file is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_key, settled
from .spans import place_among

SHARDS, RANGES, DRAWS, SLACK = 16, 512, 16, 0.02
KEY = ("key", "id", "file", "at")


def _drawn(rows: DataFrame, n: int, total: int, draws: int, seed: int) -> DataFrame:
    """rows drawn at least once, with `draws`: on average its share of all bytes and rows, times the number of draws."""
    share = F.col("size") / (2.0 * total) + 1.0 / (2.0 * n)
    luck = F.pmod(F.xxhash64("file", "at", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return rows.withColumn("draws", F.floor(share * draws + luck)).where("draws > 0")


def _quantiles(sample: DataFrame, parts: Column, apart: list[str]) -> DataFrame:
    """The keys at which the running sum of draws, within `apart`, passes each of `parts` equal parts."""
    w = Window.partitionBy(*apart).orderBy("k")
    held = sample.withColumn("upto", F.sum("draws").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("draws").over(Window.partitionBy(*apart)))
    passed = F.floor(F.col("upto") * parts / F.col("all")) > F.floor((F.col("upto") - F.col("draws")) * parts / F.col("all"))
    return held.where(passed & (F.col("upto") < F.col("all"))).select("k")


def _sorted(splitters: DataFrame) -> DataFrame:
    return splitters.agg(F.array_sort(F.collect_set("k")).alias("splitters"))


def ranged(rows: DataFrame, n: int, total: int, ranges: int, draws: int, scratch: Scratch) -> DataFrame:
    """rows with `range`, a number that rises with the key; rows: key, id, file, at, size, n of them with total bytes."""
    key = F.struct(*KEY)
    splitters = scratch.write(_quantiles(_drawn(rows, n, total, ranges * draws, 1).select(key.alias("k"), "draws"), F.lit(ranges), []))

    def dealt(by: DataFrame) -> DataFrame:
        return rows.crossJoin(F.broadcast(_sorted(by))).withColumn("range", place_among(F.col("splitters"), key, (4 * ranges).bit_length())).drop("splitters")  # one row

    # a range has a share of 1 / ranges on average; one of more than twice that is split again
    load = F.sum("size") / (2.0 * total) + F.count(F.lit(1)) / (2.0 * n)
    first = dealt(splitters)
    overfull = scratch.write(first.groupBy("range").agg(F.ceil(load * ranges).alias("parts"), F.count(F.lit(1)).alias("held")).where("parts > 2 and held > 1").select("range", "parts"))
    if overfull.isEmpty():
        return first
    again = _drawn(first.join(F.broadcast(overfull), "range"), n, total, 4 * ranges * draws, 2).select("range", "parts", key.alias("k"), "draws")
    more = _quantiles(again, F.col("parts"), ["range"])
    return dealt(scratch.write(splitters.unionByName(more)))


def shards(docs: DataFrame, count: int = SHARDS, slack: float = SLACK, ranges: int = RANGES, draws: int = DRAWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, size, text_crc32, shard, slot) of each document; row is common.row_key of the settled input."""
    scratch = Scratch(docs.sparkSession, "shards")
    docs = settled(docs, scratch)
    source = dict(scratch.tables)
    row, text = row_key(docs), F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.md5(text).alias("key"), row["file"].alias("file"), row["at"].alias("at")))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(1))).first()
    held = scratch.write(ranged(rows, max(n, 1), total, ranges, draws, scratch))

    one = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    zero = lambda c: F.coalesce(F.sum(c).over(one), F.lit(0))
    sums = scratch.write(sums.withColumn("bytes0", zero("bytes")).withColumn("rows0", zero("rows")))
    # a group that reaches over the edge of a range: its sums are those of its parts
    edges = sums.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("in")).where("in > 1").select("key")
    spread = held.join(F.broadcast(edges), "key").groupBy("key").agg(F.sum("size").alias("all_bytes"), F.count(F.lit(1)).alias("all_rows"))
    start = held.join(F.broadcast(edges), "key").groupBy("range", "key").agg(F.sum("size").alias("own"))
    start = start.join(F.broadcast(sums.select("range", "bytes0", "bytes", "low")), "range")
    start = start.groupBy("key").agg(F.min(F.when(F.col("low") == F.col("key"), F.col("bytes0")).otherwise(F.col("bytes0") + F.col("bytes") - F.col("own"))).alias("all_start"))
    spread = scratch.write(spread.join(start, "key"))

    w = Window.partitionBy("range").orderBy(*KEY)
    group = Window.partitionBy("range", "key")
    placed = held.repartitionByRange("range").join(F.broadcast(sums.select("range", "bytes0", "rows0")), "range").join(F.broadcast(spread), "key", "left")
    placed = placed.withColumn("before", F.col("bytes0") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("place", F.col("rows0") + F.row_number().over(w) - 1)
    own = {"all_bytes": F.sum("size").over(group), "all_rows": F.count(F.lit(1)).over(group), "all_start": F.min("before").over(group)}
    placed = placed.withColumns({c: F.coalesce(c, x) for c, x in own.items()})
    whole = (F.col("all_bytes") * count <= slack * total) & (F.col("all_rows") * count <= slack * n)
    twice = F.when(whole, 2 * F.col("all_start") + F.col("all_bytes")).otherwise(2 * F.col("before") + F.col("size"))
    shard = F.least(F.call_function("div", twice * count, F.lit(2 * total)), F.lit(count - 1)).cast("int")
    placed = scratch.write(placed.select("file", "at", "id", "size", "crc", shard.alias("shard"), "place"))
    first = scratch.write(placed.groupBy("shard").agg(F.min("place").alias("first")))
    scratch.free(placed, first, *source.values())
    out = placed.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select(F.struct("file", "at").alias("row"), F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def digest(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The op13 contract's row for each document."""
    return sharded.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
