"""URL filter: a bit-parallel wildcard automaton that simulates every glob rule at once over each canonical URL.

Rules are globs over the canonical URL `host + path` (host lower-cased; see split_url). `*` is any run without `/`,
`**` any run, `?` any one character but `/`; the glob must span the whole canonical URL. All globs are packed, one bit
for each literal position, into rows of 64-bit words (multiword Shift-And with self-loops for the stars).

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule with a literal in it;
an empty table gives an empty result; repeated rows and urls are judged each on its own; ties between rules that fit are
broken by greater length, then by earlier place in the rule list; other columns of the input are kept out of the way
because only the id and url columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block), name as reported, and globs of which any may fit; weight decides between rules."""

    verdict: str
    name: str
    globs: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and all its subdomains, for paths that start with path."""
    return Rule(verdict, host + path, (f"{host}{path}**", f"*.{host}{path}**"), 1 << 20 | len(host + path))


def glob_rule(verdict: str, glob: str) -> Rule:
    """A plain glob; it decides only where no host rule fits."""
    return Rule(verdict, glob, (glob,), 0)


#: The rules of the op4 contract, then the globs of the method's own verdict.
CONTRACT_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
METHOD_GLOBS = ("*spam*", "*spam*/**", "*casino*", "*casino*/**", "*pills*", "*pills*/**", "**/wp-admin/**", "**/cgi-bin/**")


DEFAULT_RULES = (*CONTRACT_RULES, *(glob_rule("block", g) for g in METHOD_GLOBS))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


@dataclass
class Automaton:
    """All globs as one bit-parallel machine. Literal position k of a glob is bit `first + k`; bit `first` is its start."""

    globs: list[str]
    size: int = 0
    codes: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        steps: list[list[tuple[str, str]]] = []  # per glob: (loop before this state, literal that leads on)
        for g in self.globs:
            parts, loop, i = [], "", 0
            while i < len(g):
                if g[i] == "*":
                    run = len(g[i:]) - len(g[i:].lstrip("*"))
                    loop = "**" if run > 1 or loop == "**" else "*"
                    i += run
                else:
                    parts.append((loop, g[i]))
                    loop, i = "", i + 1
            parts.append((loop, ""))
            steps.append(parts)
        self.size = sum(len(p) for p in steps)
        n_words = -(-self.size // 64)
        literals = sorted({c for p in steps for _, c in p if c and c != "?"} | {"/"})
        self.codes = {ord(c): k + 1 for k, c in enumerate(literals)}  # 0: any character that no glob names
        enter = np.zeros((len(literals) + 1, n_words), np.uint64)  # bits that this character can enter
        stay = np.zeros((len(literals) + 1, n_words), np.uint64)  # bits that this character leaves set
        start, final, slash = np.zeros(n_words, np.uint64), [], self.codes[ord("/")]
        bit = 0

        def put(mask: np.ndarray, b: int) -> None:
            mask[..., b // 64] |= np.uint64(1 << (b % 64))

        for parts in steps:
            put(start, bit)
            for loop, literal in parts:
                if loop == "**":
                    put(stay, bit)
                elif loop == "*":
                    for k in range(len(stay)):
                        if k != slash:
                            put(stay[k], bit)
                if literal == "?":
                    for k in range(len(enter)):
                        if k != slash:
                            put(enter[k], bit + 1)
                elif literal:
                    put(enter[self.codes[ord(literal)]], bit + 1)
                bit += 1
            final.append(bit - 1)
        self.enter, self.stay, self.start, self.final = enter, stay, start, np.array(final)

    def run(self, urls: Iterable[str], rows: int = 8192) -> np.ndarray:
        """A boolean matrix, urls by globs: which glob spans which whole url. The work is done a block of rows at a time."""
        urls = list(urls)
        out = np.zeros((len(urls), len(self.globs)), bool)
        for lo in range(0, len(urls), rows):
            self._block(urls[lo : lo + rows], out[lo : lo + rows])
        return out

    def _block(self, urls: list[str], out: np.ndarray) -> None:
        lens = np.array([len(u) for u in urls])
        flat = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.array(sorted(self.codes), np.uint32)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        code = np.where(known[at] == flat, np.array([self.codes[int(c)] for c in known])[at], 0)
        order = np.argsort(-lens, kind="stable")  # longest first: rows that have ended are a suffix
        offs = np.concatenate([[0], np.cumsum(lens)])[:-1][order]
        state = np.tile(self.start, (len(urls), 1))
        sorted_lens = lens[order]
        for step in range(int(lens.max(initial=0))):
            live = int(np.searchsorted(-sorted_lens, -step, "left"))  # rows longer than step
            c = code[offs[:live] + step]
            d = state[:live]
            carry = np.zeros_like(d)
            carry[:, 1:] = d[:, :-1] >> np.uint64(63)
            state[:live] = (((d << np.uint64(1)) | carry) & self.enter[c]) | (d & self.stay[c])
        hit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out[order] = hit.astype(bool)


def url_filter(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, glob): the verdict of the longest host rule that fits, else of the method's globs
    (the first that fits), else allow. rule is null unless a host rule fits; glob names the method's glob that decided."""
    ship_package(pages.sparkSession)
    globs = [g for r in rules for g in r.globs]
    owner = [k for k, r in enumerate(rules) for _ in r.globs]
    rank = sorted(range(len(rules)), key=lambda k: (-rules[k].weight, k))

    def judge(batches):
        machine = Automaton(globs)
        for b in batches:
            fits = machine.run(h + p for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True))
            by_rule = np.zeros((len(fits), len(rules) + 1), bool)
            for g, k in enumerate(owner):
                by_rule[:, k] |= fits[:, g]
            by_rule[:, -1] = True
            best = np.array([*rank, len(rules)])[by_rule[:, [*rank, len(rules)]].argmax(1)] if len(fits) else np.zeros(0, int)
            names = [r.name if r.weight else None for r in rules] + [None]
            method = [None if r.weight else r.name for r in rules] + [None]
            verdicts = [r.verdict for r in rules] + ["allow"]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("path"), pa.array([names[k] for k in best], pa.string()), pa.array([verdicts[k] for k in best], pa.string()), pa.array([method[k] for k in best], pa.string())],
                names=["id", "host", "path", "rule", "verdict", "glob"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"))
    host, path = split_url(F.col("__url"))
    src = src.select("id", host.alias("host"), path.alias("path"))
    return src.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, glob string").withColumnRenamed("id", id_col)
