"""Snippets: the window of a page's text that best shows a query's phrases, with the phrases marked."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import folding

OPEN, CLOSE, GAP = ">>>", "<<<", "..."


def tokens_of(text: str, index: str) -> list[tuple[int, int]]:
    """(start, end) of each token: words, or every three characters."""
    if index != "trigram":
        return [m.span() for m in re.finditer(r"[^ ]+", text)]
    return [(i, i + 3) for i in range(len(text) - 2)]


def instances(text: str, phrases: list[tuple[str, bool, bool]], index: str) -> list[tuple[int, int, int]]:
    """(token offset, phrase number, tokens) of every occurrence, sorted. phrases: text, is a prefix, must come first."""
    out = []
    if index != "trigram":
        words = (text.translate(str.maketrans(*folding())) if index == "word" else text).split(" ") if text else []
        for k, (p, prefix, _) in enumerate(phrases):
            want = p.split()
            n = len(want)
            same = lambda i: words[i : i + n - 1] == want[:-1] and (words[i + n - 1].startswith(want[-1]) if prefix else words[i + n - 1] == want[-1])  # noqa: E731, B023
            out += [(i, k, n) for i in range(len(words) - n + 1) if want and same(i)]
    else:
        for k, (p, _, _) in enumerate(phrases):
            at = text.find(p) if len(p) >= 3 else -1
            while at >= 0:
                out.append((at, k, len(p) - 2))
                at = text.find(p, at + 1)
    return sorted(x for x in out if not x[0] or not phrases[x[1]][2])


def best_window(found: list[tuple[int, int, int]], total: int, size: int) -> int:
    """The first token of the window: the first place of a phrase is worth 1000, any more 1, the text's start 120."""

    def worth(at: int) -> tuple[int, int, int]:
        inside = [x for x in found if at <= x[0] < at + size]
        score = len(inside) + 999 * len({k for _, k, _ in inside})
        return score, min((o for o, _, _ in inside), default=at), max((o + n for o, _, n in inside), default=at)

    best = start = 0
    for offset, _, _ in found:
        score, first, last = worth(offset)
        if score > best:
            best, start = score, min(max(first - int((size - (last - first)) / 2), 0), max(total - size, 0))
        if total > size and offset > 0 and worth(0)[0] + 120 > best:
            best, start = worth(0)[0] + 120, 0
    return start


def snippet(text: str, phrases: list[tuple[str, bool, bool]], index: str, size: int) -> str:
    tokens = tokens_of(text, index)
    found = instances(text, phrases, index)
    if not tokens:
        return text
    start = best_window(found, len(tokens), size)
    end = min(start + size, len(tokens))
    runs: list[list[int]] = []  # tokens marked, overlaps merged
    for offset, _, n in found:
        if start <= offset < end:
            if runs and offset <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], offset + n - 1)
            else:
                runs.append([offset, offset + n - 1])
    begin, stop = (tokens[start][0] if start else 0), (tokens[end - 1][1] if end < len(tokens) else len(text))
    out, at = GAP * (start > 0), begin
    for a, b in runs:
        b = min(b, end - 1)
        out += text[at : tokens[a][0]] + OPEN + text[tokens[a][0] : tokens[b][1]] + CLOSE
        at = tokens[b][1]
    return out + text[at:stop] + GAP * (end < len(tokens))


def snippet_udf(words: list[tuple[str, bool, bool]], trigrams: list[tuple[str, bool, bool]], size: int, exact: bool = False):
    """A vectorised function of (search_text, search_source), for the few rows that are returned. exact: words keep their
    diacritics."""
    index = "exact" if exact else "word"

    @F.pandas_udf("string")
    def make(text, source):
        import pandas as pd

        return pd.Series([snippet(t or "", trigrams if s == "trigram" else words, "trigram" if s == "trigram" else index, size) for t, s in zip(text, source, strict=True)], dtype=object)

    return make
