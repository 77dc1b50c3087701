"""Paths and globs: driver-side resolution, and predicates as column expressions."""

from __future__ import annotations

import glob
import os
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name

META = "*?[{"


def has_meta(pattern: str) -> bool:
    return any(c in pattern for c in META)


def expand_home(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def alternatives(pattern: str) -> list[str]:
    """The patterns without braces that a pattern stands for; raises ValueError for an open brace."""
    start = pattern.find("{")
    if start < 0:
        return [pattern]
    depth, cuts = 0, [start]
    for i in range(start, len(pattern)):
        depth += {"{": 1, "}": -1}.get(pattern[i], 0)
        if pattern[i] == "," and depth == 1:
            cuts.append(i)
        if depth == 0:
            cuts.append(i)
            parts = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
            return [x for p in parts for x in alternatives(pattern[:start] + p + pattern[i + 1 :])]
    raise ValueError(f"invalid pattern {pattern!r}: unclosed brace")


def glob_regex(pattern: str) -> str:
    """A regular expression for a whole path. `**` spans directories, `*` and `?` stay within one."""
    out, i = "", 0
    if "{" in pattern:
        return "(?:" + "|".join(glob_regex(p) for p in alternatives(pattern)) + ")"
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid pattern {pattern!r}: unclosed class")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def anchored(pattern: str) -> str:
    """A pattern without a separator names files at any depth; a relative one starts at the working directory."""
    pattern = expand_home(pattern)
    if "/" not in pattern and "\\" not in pattern:
        return "**/" + pattern
    return pattern if pattern.startswith("/") else os.path.join(os.getcwd(), pattern)


def matches_any(path: Column, patterns: list[str]) -> Column:
    """True where the path fits one of the patterns: one regular expression in the scan's filter."""
    if not patterns:
        return F.lit(False)
    return path.rlike("(?s)^(?:" + "|".join(glob_regex(anchored(p)) for p in patterns) + ")$")


def check_excludes(excludes: list[str]) -> None:
    """Globs must be well-formed; other excludes must be files that exist."""
    for e in excludes:
        if has_meta(e):
            glob_regex(anchored(e))
        elif "/" in e or "\\" in e or os.path.exists(expand_home(e)):
            if not os.path.exists(expand_home(e)):
                raise ValueError(f"exclude {e}: no such file")
            if os.path.isdir(expand_home(e)):
                raise ValueError(f"exclude {e}: is a directory")


def glob_root(pattern: str) -> str:
    """The longest directory before the first element with a wildcard, absolute."""
    parts = expand_home(pattern).split("/")
    fixed = []
    for p in parts:
        if has_meta(p):
            break
        fixed.append(p)
    root = "/".join(fixed) or ("/" if pattern.startswith("/") else ".")
    return os.path.abspath(root)


def minimal_roots(roots: list[str]) -> list[str]:
    """Without repeats and without roots that lie in another; shortest first."""
    kept: list[str] = []
    for r in sorted({os.path.normpath(x) for x in roots}, key=lambda x: (len(x), x)):
        if not any(r == k or r.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(r)
    return kept


def resolve(paths: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(resolved paths in order, minimal roots, warnings). A glob without a match is a warning, a missing path an error."""
    found: dict[str, None] = {}
    roots, warnings = [], []
    for p in map(expand_home, paths):
        if has_meta(p):
            glob_regex(p)
            hits = sorted({h for x in alternatives(p) for h in glob.glob(x, recursive=True, include_hidden=True)})
            if not hits:
                warnings.append(f"no match for {p}")
            roots.append(glob_root(p))
            found |= dict.fromkeys(map(os.path.abspath, hits))
        else:
            if not os.path.exists(p):
                raise FileNotFoundError(f"stat {p}: no such file or directory")
            full = os.path.abspath(p)
            found[full] = None
            roots.append(full if os.path.isdir(full) else os.path.dirname(full))
    return list(found), minimal_roots(roots), warnings


def within(path: Column, roots: list[str]) -> Column:
    """True where the path is one of the roots or lies below one; no roots means everywhere."""
    if not roots:
        return F.lit(True)
    tests = [(path == r) | path.startswith(r.rstrip("/") + "/") for r in map(os.path.normpath, roots)]
    return reduce(lambda a, b: a | b, tests)


def like_regex(token: str) -> str:
    """A SQL LIKE '%token%' without an escape character, ASCII case-insensitive."""
    parts, literal = [], ""
    for c in token:
        if c in "%_":
            parts += ["\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"] * bool(literal) + [".*" if c == "%" else "."]
            literal = ""
        else:
            literal += c
    parts += ["\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"] * bool(literal)
    return "(?is)" + "".join(parts)


def path_has(path: Column, tokens: list[str], mode: str) -> Column:
    tests = [path.rlike(like_regex(t)) for t in tokens]
    return reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), tests)


__all__ = ["alternatives", "anchored", "base_name", "check_excludes", "expand_home", "glob_regex", "glob_root", "has_meta", "like_regex", "matches_any", "minimal_roots", "path_has", "resolve", "within"]
