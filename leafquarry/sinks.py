"""Sinks: NDJSON and text, from ordered result frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOLD, MARK, OFF = "\033[1m", "\033[33m", "\033[0m"


def number(x: float) -> str:
    """The shortest decimal of a double: 0 for 0.0, an exponent only below 1e-6 or from 1e21 on."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if x or str(x)[0] != "-" else "-0"
    text = repr(x)
    if "e" in text:
        mantissa, exponent = text.split("e")
        if abs(x) >= 1e21 or abs(x) < 1e-6:
            return f"{mantissa.removesuffix('.0')}e{'-' if exponent[0] == '-' else '+'}{abs(int(exponent)):02d}"
        return f"{x:.{len(mantissa.split('.')[1] if '.' in mantissa else '') + abs(int(exponent))}f}"
    return text


def _json(pairs: list[tuple[str, object]]) -> str:
    out = []
    for k, v in pairs:
        out.append(f"{json.dumps(k)}:{number(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False, separators=(',', ':'))}")
    return "{" + ",".join(out) + "}"


def found_json(results: DataFrame) -> Iterator[str]:
    """One object a line, in the columns' order; nothing for no results."""
    for r in results.toLocalIterator():
        yield _json(list(r.asDict().items()))


def found_text(results: DataFrame, verbose: bool = False, color: bool = False) -> Iterator[str]:
    n = 0
    for r in results.toLocalIterator():
        n += 1
        page = f" (page {r.page_index + 1})" if r.page_count > 1 else ""
        yield f"{BOLD if color else ''}{r.path}{OFF if color else ''}{page}"
        if verbose and r.snippet:
            shown = r.snippet.replace(">>>", MARK if color else "").replace("<<<", OFF if color else "")
            yield from ("    " + line for line in shown.split("\n"))
        if verbose:
            yield ""
    yield f"{n} result(s) found." if n else "No results found."


def stamp(at: Column) -> Column:
    """RFC 3339 in the session's time zone: Z for UTC, a fraction only where there is one."""
    fraction = F.regexp_replace(F.date_format(at, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.date_format(at, "XXX"))


def document_fields(documents: DataFrame) -> list[Column]:
    """The fields of a document's record, in order."""
    return [F.col("path"), stamp(F.col("created_at")).alias("created_at"), stamp(F.col("modified_at")).alias("modified_at"), F.col("page_count"), F.col("ocr_pending"), F.col("deleted")]


def json_lines(documents: DataFrame) -> DataFrame:
    """(line): each document as one JSON object, nulls included, in the frame's order."""
    return documents.select(F.to_json(F.struct(*document_fields(documents)), {"ignoreNullFields": "false"}).alias("line"))


def text_lines(documents: DataFrame) -> DataFrame:
    """(line): each document's time, path and pages, in the frame's order."""
    return documents.select(F.concat(stamp(F.col("created_at")), F.lit("  "), "path", F.lit("  ("), F.col("page_count").cast("string"), F.lit(" pages)")).alias("line"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_index, line): a heading and the text of each page, in order."""
    heading = F.concat(F.lit("--- page "), (F.col("page_index") + 1).cast("string"), F.lit(" ---"))
    return pages.select("page_index", F.posexplode(F.array(heading, "markdown")).alias("part", "line")).orderBy("page_index", "part").select("page_index", "line")


def found_lines(results: DataFrame, verbose: bool = False) -> DataFrame:
    """(line): each result's path, with its page where the document has several; verbose: the snippet below, indented, and
    an empty line. In the frame's order."""
    page = F.when(F.col("page_count") > 1, F.concat(F.lit(" (page "), (F.col("page_index") + 1).cast("string"), F.lit(")"))).otherwise("")
    head = F.concat("path", page)
    if not verbose:
        return results.select(head.alias("line"))
    below = F.transform(F.split(F.regexp_replace("snippet", ">>>|<<<", ""), "\n"), lambda x: F.concat(F.lit("    "), x))
    return results.select(F.concat_ws("\n", F.array(head), F.when(F.col("snippet") != "", below), F.array(F.lit(""))).alias("line"))


def document_json(documents: DataFrame) -> Iterator[str]:
    return (r.line for r in json_lines(documents).toLocalIterator())


def documents_text(documents: DataFrame) -> Iterator[str]:
    n = 0
    for r in text_lines(documents).toLocalIterator():
        n += 1
        yield r.line
    yield ""
    yield f"{n} document(s)."


def document_text(document: DataFrame) -> Iterator[str]:
    for r in document.select(*document_fields(document)).toLocalIterator():
        for name, value in r.asDict().items():
            yield f"{name}: {str(value).lower() if isinstance(value, bool) else value}"


def pages_json(path: str, pages: DataFrame) -> str:
    rows = [{"page_index": r.page_index, "markdown": r.markdown} for r in pages.toLocalIterator()]
    if not rows:
        raise LookupError(f"no pages found for {path}")
    return _json([("path", path), ("pages", rows)])


def pages_text(path: str, pages: DataFrame) -> Iterator[str]:
    n = 0
    for r in pages.toLocalIterator():
        n += 1
        yield f"--- page {r.page_index + 1} ---"
        yield r.markdown
    if not n:
        raise LookupError(f"no pages found for {path}")


def progress_line(i: int, n: int, status: str, name: str, detail: str = "") -> str:
    return f"[{i}/{n}] {status}: {name}" + (f" ({detail})" if detail else "")


def cost_text(cost: DataFrame, redo: bool) -> str:
    r = cost.first()
    if not r["items"]:
        return "No documents found." if redo else "Nothing is pending."
    what = "documents" if redo else "pending contents"
    return f"{r['items']} {what}, {r['pages']} pages: ${r['dollars']:.2f}"
