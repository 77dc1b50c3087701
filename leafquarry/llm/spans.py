"""Positions of regular-expression matches as Spark columns, JVM-side only.

Patterns here are written so that Java's matcher neither recurses nor rescans a run from each of its characters:
repeats are possessive, and a run is entered only at its start (or where the last match ended, \\G).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose offsets are summed together; offsets of later groups are shifted once, so the work stays linear.
GROUP = 256
SPAN = "array<struct<start:int,end:int,match:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches (split) and the matches alternate, so running sums of their lengths are the offsets."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)

    def located(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        pairs = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(x.alias("match"), g.alias("gap"), F.length(x).alias("len")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = s["pos"] + x["gap"]
            one = F.struct(at.alias("start"), (at + x["len"]).alias("end"), x["match"].alias("match"))
            return F.struct((at + x["len"]).alias("pos"), F.concat(s["out"], F.array(one)).alias("out"))

        def grouped(p: Column) -> Column:
            groups = F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / GROUP).cast("int")), lambda k: F.aggregate(F.slice(p, k * GROUP + 1, GROUP), start, step))

            def shifted(gs: Column) -> Column:
                first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
                bases = F.aggregate(gs, first, lambda s, g: F.struct((s["pos"] + g["pos"]).alias("pos"), F.concat(s["out"], F.array(s["pos"])).alias("out")))["out"]
                return F.flatten(F.zip_with(gs, bases, lambda g, b: F.transform(g["out"], lambda x: F.struct((x["start"] + b).alias("start"), (x["end"] + b).alias("end"), x["match"].alias("match")))))

            return let(groups, shifted)

        return let(pairs, grouped)

    return let(hits, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(SPAN)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tag(spans: Column, kind: str, order: int) -> Column:
    """The spans as (start, order, end, kind), which sort as reported."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("o"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(tagged: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.sort_array(tagged), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def place_among(ordered: Column, value: Column, bits: int) -> Column:
    """How many of a sorted array's entries are below the value: a binary search over fewer than 1 << bits entries."""
    below = lambda i: F.coalesce(F.get(ordered, i - 1) < value, F.lit(False))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(halves, F.lit(0), lambda at, s: F.when(below(at + s), at + s).otherwise(at))
