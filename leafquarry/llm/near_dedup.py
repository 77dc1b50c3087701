"""MinHash near-dedup with odd sketches.

1. Every text becomes the set of its 5-word shingles; texts with equal sets form a class, and only classes go on.
2. `BANDS` bands of `ROWS` MinHash values each put classes into buckets. A pair at the threshold misses all buckets with
   a probability below 1e-6 (at 0.8; 1e-9 at 0.85).
3. Classes that share a bucket get an odd sketch: SKETCH_HASHES MinHash samples folded into a parity bitmap. The
   population count of two bitmaps' XOR estimates how many samples differ; pairs whose estimate lies `MARGIN` (about five
   standard deviations) below the threshold are passed over.
4. The others are confirmed on the full sets, inside the bucket, which gives out a forest of links only: pairs that links
   so far have joined are not looked at, since they can't change the groups, and no candidate pair leaves a block.
A bucket of more than CHUNK classes (or CHUNK_SHINGLES shingles) is dealt out in chunks by hash: first each chunk for
itself; then pairs of chunks, but none within a component that the first links already make. So no task holds more than
two chunks, and what a hot bucket of near copies costs is its classes, not their pairs.

Defined cases: null and empty texts have no shingles, link with nothing and are kept; texts under five words are one
shingle, the whole sequence; ids may repeat (each row is judged, equal ids are kept together) or be null (kept only where
the whole group has none); an empty table gives an empty result; texts of any length are read whole; rows are told apart
by file and place (input that is no file is written once); only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import Scratch, by_block, connected_components, free_name, row_key, settled, ship_package
from .vectext import chunks, lower_ascii, mix, span_hashes, windows, words

SHINGLE, BANDS, ROWS, SKETCH_HASHES, SKETCH_BITS, MARGIN, CHUNK, CHUNK_SHINGLES = 5, 28, 4, 512, 2048, 0.09, 1024, 1 << 22
_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = (_RNG.integers(0, 2**31, BANDS * ROWS + SKETCH_HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS + SKETCH_HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    low = lower_ascii(data)
    row, start, end = words(low, offs)
    h = span_hashes(low, start, end)
    at, shingles = windows(h, row, SHINGLE)
    n = len(offs) - 1
    bounds = np.searchsorted(row[at], np.arange(n + 1))
    first, count = np.searchsorted(row, np.arange(n)), np.bincount(row, minlength=n)
    out = []
    for k in range(n):
        if bounds[k] < bounds[k + 1]:
            out.append(np.unique(shingles[bounds[k] : bounds[k + 1]]))
        elif count[k]:
            whole = np.uint64(count[k])
            for w in h[first[k] : first[k] + count[k]].tolist():
                whole = np.uint64((int(whole) * 0xD6E8FEB86659FD93 + w) % 2**64)
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(s: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """MinHash values lo to hi of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(hi - lo, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 2048):
        part = _MUL[lo:hi, None] * x[None, k : k + 2048]
        part += _ADD[lo:hi, None]
        np.minimum(best, part.min(1), out=best)
    return best


def band_keys(s: np.ndarray) -> np.ndarray:
    m = min_hashes(s, 0, BANDS * ROWS).reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
    return key.view(np.int64)


def class_key(s: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of the set's MinHash samples, as 64-bit words."""
    m = min_hashes(s, BANDS * ROWS, BANDS * ROWS + SKETCH_HASHES).astype(np.uint64)
    at = mix(m + (np.arange(SKETCH_HASHES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64)


def most_differing_bits(similarity: float) -> int:
    """The population count up to which the sketches' estimate of the similarity is this or more."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * SKETCH_HASHES * (1 - similarity) / SKETCH_BITS)))


def _signed(docs: DataFrame) -> DataFrame:
    """(row, id, n, cls, bands) of every text; cls and bands are null without shingles."""

    def sign(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                sets = shingle_sets(data, offs)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["row", "id", "n", "cls", "bands"],
                )

    row, kind = (docs.schema[c].dataType.simpleString() for c in ("row", "id"))
    return docs.mapInArrow(sign, f"row {row}, id {kind}, n long, cls binary, bands array<long>")


def _sketched(texts: DataFrame) -> DataFrame:
    """(cls, shingles, sketch) from (cls, text)."""

    def sketch(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                sets = shingle_sets(data, offs)
                yield pa.RecordBatch.from_arrays([b.slice(lo, hi - lo).column("cls"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([odd_sketch(s).tobytes() for s in sets], pa.binary())], names=["cls", "shingles", "sketch"])

    return texts.mapInArrow(sketch, "cls binary, shingles array<long>, sketch binary")


def forest(cls: list[bytes], chunk: np.ndarray, component: np.ndarray, sketch: np.ndarray, flat: np.ndarray, offs: np.ndarray, percent: int, most: int) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of one block as all its links would: a forest, so fewer than it has classes.

    A pair is looked at where its classes lie in different components, by the links so far, and (in a block of two chunks)
    in different chunks; where its odd sketches differ in at most `most` bits; and then on the full sets."""
    n, size = len(cls), np.diff(offs)
    label = np.unique(component, return_inverse=True)[1]
    codes = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    across = bool((chunk != chunk[0]).any())
    out = []
    for i in range(n - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if across:
            j = j[chunk[j] != chunk[i]]
        j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
        if len(j):
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64) <= most]
        if not len(j):
            continue
        mark[codes[offs[i] : offs[i + 1]]] = True
        common = np.zeros(len(j), np.int64)
        upto = np.concatenate([[0], np.cumsum(size[j])])
        lo = 0
        while lo < len(j):  # some of the sets at a time, so the working memory is bounded
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 20), "right")) - 1)
            common[lo:hi] = np.add.reduceat(mark[codes[ragged(offs[j[lo:hi]], size[j[lo:hi]])]], upto[lo:hi] - upto[lo], dtype=np.int64)
            lo = hi
        mark[codes[offs[i] : offs[i + 1]]] = False
        for k in j[100 * common >= percent * (size[i] + size[j] - common)].tolist():
            if label[k] != label[i]:
                out.append((cls[i], cls[k]))
                label[label == label[k]] = label[i]
    return out


def _links(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b) from members (block, cls, chunk, component, sketch, shingles): each block's forest."""

    def link(batches):
        for _, t in by_block(batches):
            if len(t) < 2:
                continue
            t = t.combine_chunks()
            sets = t.column("shingles").chunk(0)
            offs = sets.offsets.to_numpy().astype(np.int64)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), -1)
            component = np.array(t.column("component").to_pylist(), object)
            found = forest(t.column("cls").to_pylist(), t.column("chunk").to_numpy(), component, sketch, sets.flatten().to_numpy(), offs - offs[0], percent, most)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = members.select("block", "cls", "chunk", "component", "sketch", "shingles").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(link, "a binary, b binary")


def _parts(size, total):
    """Into how many chunks classes are dealt, by their number and their shingles."""
    return F.greatest(F.ceil(size / CHUNK), F.ceil(total / CHUNK_SHINGLES)).cast("int")


def _across(large: DataFrame, component: DataFrame) -> DataFrame:
    """(block, cls, chunk, component) of buckets that have several chunks: pairs of chunks that can still hold a link.

    Within a bucket, a component of more than a chunk has chunks of its own and the others share some; two chunks of one
    component need no block. So the rows grow with the classes outside the large components, not with the pairs within."""
    held = large.join(component.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    per = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    own = (F.col("size") > CHUNK) | (F.col("total") > CHUNK_SHINGLES)
    per = per.withColumn("family", F.when(own, F.col("component")).otherwise(F.expr("X''")))
    several = per.groupBy("key").agg(F.count(F.lit(1)).alias("components")).where("components > 1").select("key")
    families = per.join(several, "key", "left_semi").groupBy("key", "family").agg(_parts(F.sum("size"), F.sum("total")).alias("parts"))
    label = F.xxhash64("family", "part")
    chunks = families.select("key", "family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("key", "family", label.alias("chunk"))
    one, two = (chunks.select("key", F.col("family").alias(f"f{k}"), F.col("chunk").alias(f"c{k}")) for k in (1, 2))
    alike = (F.col("f1") == F.col("f2")) & (F.col("f1") != F.expr("X''"))
    blocks = one.join(two, "key").where((F.col("c1") <= F.col("c2")) & ~alike)
    blocks = blocks.select("key", "c1", "c2", F.xxhash64("key", "c1", "c2").alias("block"))
    of = per.select("key", "component", "family").join(families, ["key", "family"])
    held = held.join(of, ["key", "component"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    held = held.select("key", "cls", "component", label.alias("chunk"))
    sides = [blocks.select("key", F.col("c1").alias("chunk"), "block"), blocks.where("c1 <> c2").select("key", F.col("c2").alias("chunk"), "block")]
    return held.join(sides[0].unionByName(sides[1]), ["key", "chunk"]).select("block", "cls", "chunk", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(row, id, n_shingles, component_id, kept, first): component_id is the smallest id reachable over links of percent or
    more; first marks one row of each group; row is common.row_key of the settled input."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "near")
    src = settled(docs, scratch)
    src = src.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(src).alias("row"))
    source = dict(scratch.tables)
    signed = scratch.write(_signed(src))
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("lead")
    classes = signed.where("n > 0").groupBy("cls").agg(lead, F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.select("cls", "lead", "lead.row", "n", "bands"))

    keys = classes.select("cls", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
    sizes = scratch.write(sizes.select("key", _parts(F.col("size"), F.col("total")).alias("parts")))
    dealt = keys.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = scratch.write(dealt.select("key", "cls", "n", "parts", "chunk"))
    wanted = dealt.select("cls").distinct().join(classes.select("cls", "row"), "cls")
    sets = scratch.write(_sketched(src.select("row", "text").join(wanted.hint("shuffle_hash"), "row").select("cls", "text")))
    most = most_differing_bits(percent / 100 - MARGIN)

    # first within each chunk of a bucket; the same classes often meet in many bands: one block of them is enough
    blocks = dealt.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("cls")).alias("members")).where(F.size("members") > 1)
    blocks = blocks.groupBy(F.xxhash64("members").alias("block"), F.size("members").alias("size")).agg(F.first("members").alias("members"))
    blocks = blocks.select("block", F.explode("members").alias("cls"), F.lit(0).cast("long").alias("chunk"))
    links = scratch.write(_links(blocks.join(sets, "cls").withColumn("component", F.col("cls")), percent, most))
    component = connected_components(spark, links, scratch)
    large = dealt.where("parts > 1").select("key", "cls", "n")
    if not large.isEmpty():  # then between the chunks of large buckets, where these links leave several components
        more = scratch.write(_links(_across(large, component).join(sets, "cls"), percent, most))
        component = connected_components(spark, links.unionByName(more), scratch)

    labelled = classes.select("cls", "lead").join(component.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "lead", F.coalesce("component", "cls").alias("component"))
    labelled = scratch.write(labelled)
    smallest = labelled.groupBy("component").agg(F.min("lead").alias("first"))
    label = scratch.write(labelled.join(smallest, "component").select("cls", "first"))
    scratch.free(signed, label, *source.values())
    out = signed.select("row", "id", "n", "cls").join(label, "cls", "left")
    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    out = out.select("row", "id", F.col("n").alias("n_shingles"), first.alias("first"))
    out = out.select("row", "id", "n_shingles", F.col("first.id").alias("component_id"), F.col("id").eqNullSafe(F.col("first.id")).alias("kept"), (F.col("row") == F.col("first.row")).alias("first"))
    return out.withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents with one of each group: the first row of its smallest id. Their own columns, untouched."""
    docs = settled(docs, Scratch(docs.sparkSession, "near"))
    row = free_name(docs, "__row")
    first = near_dedup(docs, id_col, text_col, percent).where("first").select(F.col("row").alias(row))
    return docs.withColumn(row, row_key(docs)).join(first.hint("shuffle_hash"), row, "left_semi").drop(row)
