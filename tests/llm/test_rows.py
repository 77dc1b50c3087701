"""Rows keep their identity when splits change, and components need few rounds."""

import random

import pytest

from leafquarry.llm import ctw, line_dedup, near_dedup, pii, quality_rules
from leafquarry.llm.common import Scratch, connected_components


def test_components(spark):
    r = random.Random(7)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + r.randrange(200), 1000 + r.randrange(200)) for _ in range(150)] + [(5000, 5000 + k) for k in range(1, 90)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    scratch = Scratch(spark, "components")
    got = {g.node: g.component for g in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {n: top(n) for n in got} and len(got) == len({n for a, b in edges if a != b for n in (a, b)})
    assert scratch.n < 60  # an ordered chain of 300 nodes takes few rounds
    assert connected_components(spark, spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def run_under(spark, path, build, monkeypatch, **settings):
    """The rows of build(docs), planned under one number of splits and run under another."""
    conf = {"spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet(path)
        out = build(docs)
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        return sorted(map(str, out.collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ren", "tu"]) for _ in range(r.randrange(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    rows = [(i, text(r.randrange(3, 14)), "xx") for i in range(90)]
    shared = text(8)
    rows += [(100 + i, rows[i % 7][1], "xx") for i in range(20)] + [(200 + i, f"{text(2)}\n{shared}\n{text(2)}", "xx") for i in range(20)]
    rows += [(300 + i, f"{text(2)} Zorblax who@mail.org", "xx") for i in range(6)]
    path = str(tmp_path_factory.mktemp("rows") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    return path


BUILDS = {
    "near_dedup": lambda d: near_dedup.near_dedup(d).drop("row"),
    "deduplicate": near_dedup.deduplicate,
    "line_dedup": line_dedup.line_dedup,
    "score": lambda d: ctw.score(d).selectExpr("doc_id", "n_known", "round(score, 6)"),
    "quality_rules": lambda d: quality_rules.quality_rules(d).selectExpr("doc_id", "kept", "round(bits, 6)"),
    "passing": quality_rules.passing,
    "personal": lambda d: pii.digest(pii.find_personal(d)),
    "sanitise": lambda d: pii.sanitise(d).drop("row"),
}


@pytest.mark.parametrize("name", BUILDS)
def test_other_splits(spark, written, name, monkeypatch):
    got = run_under(spark, written, BUILDS[name], monkeypatch)
    assert got == sorted(map(str, BUILDS[name](spark.read.parquet(written)).collect())) and got
