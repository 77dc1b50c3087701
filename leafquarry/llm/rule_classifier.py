"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Boosted shallow trees are grown on a bounded sample of labelled documents; every path from a root to a node is a
conjunctive rule over the statistics; an L1-penalised logistic regression over the rules keeps few of them; those and
their weights become one column expression. Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts have statistics of 0 and get a score like any other; with no usable labels, or only
one class, every score is the share of label 1 (0.5 without labels); null ids are not held out and have no label; labels
that repeat for an id count once each; of rows that repeat an id, the one of the smallest hash of the text is fitted; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may use; with more, those of the smallest hash of the id.
SAMPLE_ROWS = 20_000


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Numbers about a text, from the text, its words and its lines that have a word."""
    n = F.greatest(F.length(text), F.lit(1))
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    pairs = F.zip_with(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), words, lambda a, b: a == b)
    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": (F.length(text) - F.size(words)) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_next": F.size(F.filter(pairs, lambda p: p)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": F.size(words) / n_lines,
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "symbols": share(r"[#*$%&|<>]"),
        "exclamations": share(r"[!?]"),
        "stops": share(r"[.,;:]"),
    }


def with_statistics(docs: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """names and one struct column of statistics, `__s`."""
    base = docs.select(*names, F.coalesce(text, F.lit("")).alias("__text"))
    words = F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(*names, "__text", words.alias("__words"), lines.alias("__lines"))
    stats = statistics(F.col("__text"), F.col("__words"), F.col("__lines"))
    return base.select(*names, F.struct(*[c.cast("double").alias(k) for k, c in stats.items()]).alias("__s"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold), and its weight."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float

    def holds(self, stats: str) -> Column:
        tests = [(F.col(f"{stats}.{k}") > t) if above else (F.col(f"{stats}.{k}") <= t) for k, above, t in self.parts]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: str = "__s") -> Column:
        terms = [F.when(r.holds(stats), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def grow(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int, leaf: int) -> list[tuple]:
    """The paths of boosted regression trees on the logistic residual: tuples of (feature, above, threshold)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            grown = []
            for rows, path in nodes:
                if path:
                    paths.append(path)
                gr, hr = g[rows], h[rows]
                best = None
                for f in range(x.shape[1]) if level < depth else ():
                    k = len(cuts[f]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(code[rows, f], w, k))[:-1] for w in (gr, hr, None))
                    gain = gs**2 / (hs + 1) + (gr.sum() - gs) ** 2 / (hr.sum() - hs + 1)
                    gain = np.where((ns >= leaf) & (len(rows) - ns >= leaf), gain, -np.inf)
                    if len(gain) and gain.max() > (best[0] if best else gr.sum() ** 2 / (hr.sum() + 1) + 1e-6):
                        best = (gain.max(), f, int(gain.argmax()))
                if best is None:
                    margin[rows] += rate * gr.sum() / (hr.sum() + 1)
                    continue
                _, f, at = best
                below = code[rows, f] <= at
                grown += [(rows[below], (*path, (f, False, float(cuts[f][at])))), (rows[~below], (*path, (f, True, float(cuts[f][at]))))]
            nodes = grown
    return list(dict.fromkeys(paths))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) of L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = r.shape
    size = 4.0 / max(1.0, np.linalg.norm(r.T @ r / n, 2) + 1)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ vw + vb))) - y
        nw = vw - size * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nb = vb - size * e.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(sample: list[tuple], names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4) -> RuleEnsemble:
    """sample: rows of statistics with the label last."""
    if not sample:
        return RuleEnsemble(0.0, ())
    a = np.array(sorted(sample), float)
    x, y = a[:, :-1], a[:, -1]
    if y.min() == y.max():
        return RuleEnsemble(40.0 if y[0] else -40.0, ())
    paths = grow(x, y, trees, depth, rate, 64, max(5, len(y) // 500))
    held = [reduce(np.logical_and, [(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in p]) for p in paths]
    if not held:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    bias, w = lasso_logistic(np.stack(held, 1).astype(float), y, penalty)
    return RuleEnsemble(bias, tuple(Rule(tuple((names[f], above, t) for f, above, t in p), float(v)) for p, v in zip(paths, w, strict=True) if abs(v) > 1e-4))


def held_out(id_col: str) -> Column:
    """The op7 contract's fold, which no fit sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **settings) -> RuleEnsemble:
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    usable = usable.where(F.crc32(F.col("__id").cast("string")) % 4 != 2).distinct()
    picked = usable.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample_rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(picked), "__id")
    # one row of each sampled id: where ids repeat, the text of the smallest hash
    texts = texts.select("__id", "__y", F.coalesce("__t", F.lit("")).alias("__t"))
    texts = texts.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__t").alias("h"), F.col("__t").alias("t")))["t"].alias("__t"))
    sample = with_statistics(texts, F.col("__t"), ["__y"]).select("__s.*", "__y")
    return fit([tuple(r) for r in sample.collect()], sample.columns[:-1], **settings)


def classify(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of each document."""
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    scored = with_statistics(src, F.col("__t"), ["__id"]).select("__id", model.score().alias("score"))
    return scored.select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
