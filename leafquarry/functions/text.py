"""Text functions: JVM-side column expressions, and the same rules in Python for query strings."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters outside the diacritics rule that the word index folds.
FOLDED_VARIANTS = {"ſ": "s", "ẛ": "s", "µ": "μ", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ"}
#: File name extension to content type.
CONTENT_TYPES = {".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg"}


def normalize(text: Column) -> Column:
    """Letters and decimal digits in simple lower case, every other run one space, trimmed.

    Separators are cut before lower-casing; translate undoes the two context rules of Java's lower()."""
    spaced = F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", " ")
    return F.trim(F.regexp_replace(F.lower(F.translate(spaced, "İΣ", "iσ")), "  +", " "))


@lru_cache(1)
def folding() -> tuple[str, str]:
    """(from, to): letters that the word index folds, found by the rule: an ASCII base and exactly one mark."""
    pairs = dict(FOLDED_VARIANTS)
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            pairs[chr(cp)] = parts[0].lower()
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Normalised text as the word index sees it: without diacritics."""
    return F.translate(text, *folding())


def word_tokens(text: str, folded: bool = True) -> list[str]:
    """The word index's tokens of a query string: runs of letters, numbers and private use, folded."""
    table = str.maketrans(*folding()) if folded else {}
    spaced = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in text)
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in spaced).translate(table).split()


def java_literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The suffix from the last dot of the last path element, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def content_type(path: Column) -> Column:
    """pdf, png or jpeg by extension; null for other files."""
    kind = F.lit(None).cast("string")
    for ext, name in CONTENT_TYPES.items():
        kind = F.when(extension(path) == ext, name).otherwise(kind)
    return kind


def shortened(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def duration(seconds: Column) -> Column:
    """XhYYm, XmYYs, Xs, or <1s (0s for nothing)."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.concat((s / 3600).cast("long").cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m"))
    minutes = F.concat((s / 60).cast("long").cast("string"), F.lit("m"), two(s % 60), F.lit("s"))
    return F.when(seconds <= 0, "0s").when(seconds < 1, "<1s").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def annotation(value: Column) -> Column:
    """struct(image_type, description) of an image annotation given as text: JSON of an object, or plain text."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.from_json(text, "image_type string, description string")
    is_json = text.startswith("{") & F.try_parse_json(text).isNotNull()
    kind = F.when(is_json, F.trim(F.coalesce(parsed["image_type"], F.lit("")))).otherwise(F.lit(""))
    description = F.when(is_json, F.trim(F.coalesce(parsed["description"], F.lit("")))).otherwise(text)
    return F.struct(F.when(kind == "", "image").otherwise(kind).alias("image_type"), description.alias("description"))


def with_annotations(markdown: Column, annotations: Column) -> Column:
    """Markdown with a paragraph `[Image: type — description]` for each annotation that describes something."""
    parsed = F.transform(F.coalesce(annotations, F.array().cast("array<string>")), annotation)
    said = F.transform(F.filter(parsed, lambda a: a["description"] != ""), lambda a: F.concat(F.lit("\n\n[Image: "), a["image_type"], F.lit(" — "), a["description"], F.lit("]")))
    return F.concat(F.coalesce(markdown, F.lit("")), F.array_join(said, ""))
