"""Secret scan with DataFrame functions only: key patterns, and sliding-window Shannon entropy per character class.

Candidate strings are maximal runs of [A-Za-z0-9+/_=-] of at least one window. For each character class a window of
`window` characters slides over the candidate; the characters that enter and leave change one count each, and with them
the sum of c * log2(c). A candidate is reported where some window
reaches its class's threshold, unless it fits the allow-list or overlaps a key pattern's span.

Defined cases: null and empty texts have no spans; repeated rows are scanned each on its own; an empty table gives an
empty result; a text of any length is scanned whole; only the id and text columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find_spans, joined, let, tag

# The key patterns of the op10 contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{32,}+"
MIN_ASSIGN = 8


@dataclass(frozen=True)
class CharClass:
    """A class of candidates: its whole-string pattern, and the bits per character from which a window is a secret."""

    name: str
    pattern: str
    bits: float


CLASSES = (CharClass("hex", r"^[0-9a-fA-F]+$", 3.0), CharClass("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
#: Not secrets whatever their entropy: no digit, no letter, separated words with or without a number, UUIDs, dates.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^(?:[A-Za-z]{2,}+[0-9]{0,4}[-_/=+]++)*+[A-Za-z]{2,}+[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T?[0-9]*Z?$",
)
WINDOW = 20


def window_entropy(value: Column, window: int) -> Column:
    """The greatest Shannon entropy (bits per character) of any window of the string (ASCII), by incremental counts.

    The counts are a string with a character for each code, so a step changes the two that move and copies the rest as
    bytes; the sum of c * log2(c) changes by the same two."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    cost = F.array(*[F.lit(0.0)] + [F.lit(k * math.log2(k)) for k in range(1, window + 2)])  # c * log2(c), by count

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code + 1, F.lit(1))) - 32

    def put(counts: Column, code: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + 32), code + 1, 1)

    def scan(c: Column) -> Column:
        zero = F.struct(F.lit(" " * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))

        def enter(s: Column, new: Column) -> Column:
            def add(n: Column) -> Column:
                total = s["sum"] + F.element_at(cost, n + 2) - F.element_at(cost, n + 1)
                return F.struct(put(s["counts"], new, n + 1).alias("counts"), total.alias("sum"), (s["i"] + 1).alias("i"), s["best"].alias("best"))

            return let(count(s["counts"], new), add)

        def leave(s: Column) -> Column:
            """Note the full window that ends here, and drop its first character."""

            def drop(old: Column) -> Column:
                def less(n: Column) -> Column:
                    total = s["sum"] + F.element_at(cost, n) - F.element_at(cost, n + 1)
                    best = F.greatest(s["best"], F.lit(math.log2(window)) - s["sum"] / window)
                    return F.struct(put(s["counts"], old, n - 1).alias("counts"), total.alias("sum"), s["i"].alias("i"), best.alias("best"))

                return let(count(s["counts"], old), less)

            return F.when(s["i"] < window, s).otherwise(let(F.element_at(c, s["i"] - window + 1), drop))

        return F.aggregate(c, zero, lambda s, new: let(enter(s, new), leave))["best"]

    return let(codes, scan)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, assign, access, hex, entropy): arrays of spans (start, end, match) in code points of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= MIN_ASSIGN
    run = rf"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{{{window},}}+"
    found = src.select("id", F.filter(find_spans(text, ASSIGN), long_enough).alias("assign"), find_spans(text, ACCESS).alias("access"), find_spans(text, HEX).alias("hex"), find_spans(text, run).alias("runs"))
    base = F.concat("assign", "access", "hex")

    def secret(s: Column) -> Column:
        value, known = s["match"], F.lit(False)
        for a in allow:
            known = known | value.rlike(a)
        bits = F.lit(None).cast("double")
        for c in reversed(classes):
            bits = F.when(value.rlike(c.pattern), F.lit(c.bits)).otherwise(bits)
        clear = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(clear & ~known, window_entropy(value, window) >= bits).otherwise(F.lit(False))

    return found.select(F.col("id").alias(id_col), "assign", "access", "hex", F.filter("runs", secret).alias("entropy"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every secret of the key patterns replaced by its kind, JVM-side (offsets aren't needed)."""
    out = F.col(text_col)
    for kind, pattern in (("secret", ASSIGN), ("access-key", ACCESS), ("hex-key", HEX)):
        out = F.regexp_replace(out, pattern, f"<{kind}>")
    return docs.withColumn(text_col, out)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The op10 contract's row for each document."""
    base = F.concat(tag(F.col("assign"), "assign", 0), tag(F.col("access"), "access", 1), tag(F.col("hex"), "hex", 2))
    every = F.concat(base, tag(F.col("entropy"), "entropy", 3))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
