"""Helpers that several operators share: durable intermediate tables, row identity, blocks of text, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship_package as ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written intermediate tables. They cut lineage and survive lost executors; free() deletes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/leafquarry-{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.tables = 0, {}

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[path] = out
        return out

    def free(self, *keep: DataFrame) -> None:
        """Delete all tables but keep: only where what is still to run reads those alone."""
        jvm = self.spark._jvm
        for path, table in list(self.tables.items()):
            if not any(table is k for k in keep):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                del self.tables[path]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of df's."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def settled(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with rows that can be told apart however often they are read: docs itself where it is columns and filters of
    Parquet files, the one source whose rows have a place in their file; a written copy of it otherwise."""
    plan = docs._jdf.queryExecution().analyzed()
    same = plan.deterministic()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return docs if same and _is_parquet(plan) else scratch.write(docs)


def _is_parquet(plan) -> bool:
    if plan.nodeName() != "LogicalRelation":
        return False
    of = plan.relation()
    return of.getClass().getSimpleName() == "HadoopFsRelation" and of.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def row_key(docs: DataFrame) -> Column:
    """A row's identity: its file (64 bits of the path) and its place there, which no split or executor changes. docs must
    be settled()."""
    source = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(source["file_path"]).alias("file"), source["row_index"].alias("at"))


#: Rows of a file that share a block, and the characters from which a text has a block of its own.
BLOCK_ROWS, LONG = 8192, 1 << 18


def block_of(docs: DataFrame, text: Column, *apart: Column) -> Column:
    """A number that BLOCK_ROWS rows in a row of one file share, those alike in `apart`; a long text has its own. It depends
    on the rows alone, so all readings agree on it; docs must be settled()."""
    at = row_key(docs)
    return F.when(F.length(text) > LONG, F.xxhash64(at["file"], at["at"], F.lit(1), *apart)).otherwise(F.xxhash64(at["file"], F.floor(at["at"] / BLOCK_ROWS), F.lit(0), *apart))


def packed(src: DataFrame, text: str, pack_bytes: int = 1 << 20) -> DataFrame:
    """(block, pack): the rows of src, by its column block, in compressed packs of about pack_bytes of text, one row at
    least. So texts travel to their block in some two thirds of their size as files, and are read there pack by pack."""

    def run(batches):
        waiting: dict[int, list] = {}

        def close(block: int) -> pa.RecordBatch:
            held, _ = waiting.pop(block)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "pack"])

        for batch in batches:
            blocks, of = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            for k, block in enumerate(blocks.tolist()):
                b = batch.take(pa.array(np.flatnonzero(of == k))) if len(blocks) > 1 else batch
                # a row counts for some bytes besides its text, so that empty ones fill a pack too
                sizes = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(text)).cast(pa.int64()).fill_null(0).to_numpy() + 64)])
                lo = 0
                while lo < len(b):
                    held = waiting.setdefault(block, [[], 0])
                    hi = int(np.searchsorted(sizes, sizes[lo] + max(pack_bytes - held[1], 0), "right")) - 1
                    if hi <= lo and held[0]:
                        yield close(block)
                        continue
                    hi = max(hi, lo + 1)
                    held[0].append(b.slice(lo, hi - lo))
                    held[1] += int(sizes[hi] - sizes[lo])
                    lo = hi
            while len(waiting) > 16:
                yield close(next(iter(waiting)))
        for block in list(waiting):
            yield close(block)

    return src.mapInArrow(run, "block long, pack binary")


def with_answers(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block's answers (block, kind, key, value) and then its packs, in one partition, for each_pack()."""
    known = answers.select("block", "kind", "key", "value", F.lit(None).cast("binary").alias("pack"))
    texts = packs.select("block", F.lit(127).cast("byte").alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "pack")
    return known.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")


def each_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, tuple[np.ndarray, np.ndarray]], pa.Table]]:
    """(known, rows) of each pack; known: by kind, the block's keys, sorted, and their values. Only these and one pack are
    held at a time, so a block's texts may be of any size."""
    block, parts, known = None, {}, {}
    for b in batches:
        blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
            if hi == lo:
                continue
            if blocks[lo] != block:
                block, parts, known = blocks[lo], {}, {}
            part = b.slice(lo, hi - lo)
            if kinds[lo] != 127:
                parts.setdefault(int(kinds[lo]), []).append((part.column("key").to_numpy(), part.column("value").to_numpy()))
                continue
            for kind, held in parts.items():
                key, value = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                order = np.argsort(key)
                known[kind] = key[order], value[order]
            parts = {}
            for pack in part.column("pack"):
                yield known, pa.ipc.open_stream(pack.as_py()).read_all().combine_chunks()


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values of keys, all of which the table has. Each distinct key is sought once, in order, which spares the cache."""
    if not len(keys):
        return np.zeros(0)
    distinct, at = np.unique(keys, return_inverse=True)
    return table[1][np.searchsorted(table[0], distinct)][at]


def counted_by_block(src: DataFrame, parts_of, schema: str) -> DataFrame:
    """Rows (block, kind, key, n): for each block, the keys that parts_of(batch) counts, summed within a task. parts_of
    yields (kind, sorted distinct keys, counts)."""

    def run(batches):
        held: dict[int, dict[int, list]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) == 1:
                return parts[0]
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def flush(block: int) -> Iterator[pa.RecordBatch]:
            for kind, parts in held.pop(block).items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n)], names=["block", "kind", "key", "n"])

        for batch in batches:
            blocks, of = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            for k, block in enumerate(blocks.tolist()):
                own = held.pop(block, {})
                held[block] = own  # the latest at the end
                for kind, keys, n in parts_of(batch.take(pa.array(np.flatnonzero(of == k))) if len(blocks) > 1 else batch):
                    parts = own.setdefault(kind, [])
                    parts.append((keys, n))
                    if sum(len(p[0]) for p in parts[1:]) > max(1 << 18, len(parts[0][0])):  # the new parts outweigh the merged one
                        own[kind] = [merged(parts)]
            while len(held) > 4:  # a block that comes again has rows twice, which sum
                yield from flush(next(iter(held)))
        for block in list(held):
            yield from flush(block)

    return src.mapInArrow(run, schema)


def by_block(batches: Iterator[pa.RecordBatch], column: str = "block") -> Iterator[tuple[int, pa.Table]]:
    """(block, its rows) from batches that come in the order of the block."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        at = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and at[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = int(at[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Each round gives the nodes new random priorities, hooks every node to the neighbour (or itself) of the least, jumps
    until every node names its root, and contracts the edges to roots. A node with an edge is a root only where it has the
    least priority of its neighbourhood, so in expectation at least half of them go in each round, and the chains to a
    root, of falling priorities, are logarithmic too. Hot nodes are only ever aggregated by min (map-side first) or joined
    between two exchanges, which adaptive execution can split. No edge or label reaches the driver."""
    left = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    labels, salt = None, 0
    while not left.isEmpty():
        salt += 1
        rated = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("p"), F.col(c).alias("up"))  # noqa: B023, E731
        both = left.select(F.col("a").alias("node"), rated("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), rated("a").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("near"))
        hook = scratch.write(least.select("node", F.least("near", rated("node"))["up"].alias("up")))
        while True:
            up2 = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = scratch.write(hook.join(up2, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            if hook.where("moved").isEmpty():
                break
        hook = hook.select("node", "up")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), "up")
            labels = scratch.write(labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        to_a = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        to_b = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = scratch.write(left.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.write(labels.join(least, "root").select("node", "component"))
