"""Line dedup, near-dedup, decontamination, scores and the pipeline against plain versions."""

import random

import brute
import numpy as np
import pytest

from leafquarry.llm import ctw, decontaminate, line_dedup, near_dedup
from pyspark.sql import functions as F


def frame(spark, rows, parts=3):
    return spark.createDataFrame(list(rows), "doc_id long, text string").repartition(parts).cache()


def test_line_dedup(spark):
    r = random.Random(5)
    lines = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3, 5, 12]))) for _ in range(14)] + ["", "  "]
    rows = []
    for i in range(120):
        k = [r.choice(lines) for _ in range(r.randrange(0, 25))]
        if i > 5 and r.random() < 0.6:
            src = rows[r.randrange(len(rows))][1].split("\n")
            a = r.randrange(len(src))
            k[r.randrange(len(k) + 1) : 0] = src[a : a + r.randrange(3, 20)]
        rows.append((i, "\n".join(k)))
    rows += [(900, None), (901, "")]
    df = frame(spark, rows).withColumn("row", F.lit("x")).withColumn("n_lines", F.lit(0))
    got = {g.doc_id: g for g in line_dedup.line_dedup(df, min_words=8).collect()}
    want = brute.line_dedup(rows, 8)
    assert {i: g.text for i, g in got.items()} == want
    assert sum(g.n_removed for g in got.values()) > 50 and got[900].row == "x" and got[900]._n_lines == 0
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_windows_delete_what_a_suffix_array_finds(spark):
    """All runs of 50 words or more that the LCP intervals of a plain suffix array name, over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = line_dedup.line_dedup(docs).select("doc_id", "text", "n_removed").collect()
    assert {g.doc_id: g.text for g in got} == brute.suffix_runs(rows) and sum(g.n_removed for g in got) > 300
    r = random.Random(6)
    few = [(i, "\n".join(r.choice("abcd ") * r.randrange(1, 3) + " x" * r.randrange(3) for _ in range(r.randrange(14)))) for i in range(40)]
    assert brute.suffix_runs(few, 6) == brute.line_dedup(few, 6)


def test_line_dedup_of_equal_ids(spark):
    text = "\n".join(["one two three four five six"] * 3 + ["a b c d e f g h"])
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string").coalesce(1)
    got = line_dedup.line_dedup(df, min_words=8).collect()
    assert sorted(g.emptied for g in got) == [False, True, True]  # one copy stays


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(spark, percent):
    r = random.Random(1)
    vocabulary, rows = [f"w{k}" for k in range(400)], []
    for i in range(350):
        if rows and r.random() < 0.7:
            w = rows[r.randrange(max(0, len(rows) - 40), len(rows))][1].split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 5, 20, 60, 100]))]
        rows.append((i, " ".join(w).upper() if r.random() < 0.2 else "\n".join(w)))
    rows += [(900, None), (901, ""), (902, " \n")]
    got = near_dedup.near_dedup(frame(spark, rows).withColumn("cls", F.lit(1)), percent=percent).collect()
    want = brute.components(rows, percent)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    assert len(want) > len({c for _, c in want.values()})


def test_near_dedup_of_equal_and_null_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, a), (None, a), (7, b), (7, a), (None, None), (None, "lone words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = sorted((r.doc_id or 0, r.text or "") for r in near_dedup.deduplicate(df).collect())
    assert kept == sorted([(5, a), (7, b), (0, ""), (0, "lone words here")])
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def test_large_bucket_is_dealt_in_chunks(spark, monkeypatch):
    """More classes in a bucket than a chunk holds: chunks are paired, and nothing is lost."""
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"v{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_dedup(frame(spark, rows), percent=85).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == brute.components(rows, 85)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    for j in (0.8, 0.9):
        errors = []
        for _ in range(40):
            n = 600
            c = int(n * 2 * j / (1 + j))
            u = rng.integers(0, 2**64, 2 * n - c, dtype=np.uint64)
            a, b = (near_dedup.odd_sketch(np.sort(x)) for x in (u[:n], u[n - c :]))
            z = int(np.bitwise_count(a ^ b).sum())
            errors.append(1 + near_dedup.SKETCH_BITS / (4 * near_dedup.SKETCH_HASHES) * np.log(1 - 2 * z / near_dedup.SKETCH_BITS) - j)
        assert abs(np.mean(errors)) < 0.01 and np.std(errors) < near_dedup.MARGIN / 4


ITEMS = [(1, "What colour was the old lighthouse keeper's second boat in winter? It was a faded shade of green."), (2, "Solve for the smallest prime above ninety with two odd digits only. Ninety seven."), (3, "A lone sentence about violet engines running backwards through quiet tunnels at dawn"), (4, None), (5, "")]


def test_decontaminate(spark):
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice(["the", "was", "of", "a", "old", "in", "running", "stone", "cloud"]) for _ in range(n))
    rows = [(i, filler(150)) for i in range(60)]
    rows += [(100, filler(90) + " " + ITEMS[0][1].upper() + " " + filler(90)), (101, ITEMS[2][1]), (102, filler(40) + "\n" + ITEMS[1][1] + ITEMS[0][1]), (103, "What colour was the old lighthouse keeper's second boat in winter?"), (104, None), (105, "")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = frame(spark, rows).withColumn("leaks", F.lit("mine"))
    got = {(g.doc_id, g.item_id) for g in decontaminate.leaks(df, items).collect()}
    assert got == {(100, 1), (101, 3), (102, 1), (102, 2)}  # 103 has the question alone
    left = decontaminate.decontaminate(df, items)
    assert left.columns == df.columns and left.count() == len(rows) - 3
    assert decontaminate.leaks(df, items.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), items).count() == 0


@pytest.mark.parametrize("step", [64, 1 << 20])
def test_search_loses_nothing(monkeypatch, step):
    monkeypatch.setattr(decontaminate, "STEP", step)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 25) % 300)) for i in range(120)]
    df: dict[int, int] = {}
    for _, t in rows:
        for x in set(decontaminate.text_hashes(t).view(np.int64).tolist()):
            df[x] = df.get(x, 0) + 1
    ix = decontaminate.build(rows, len(rows), 25.0, df, 0.4)
    pairs = sorted({(p, int(t)) for p in range(150) for t in rng.integers(0, len(ix.terms), rng.integers(1, 60))})
    passage, term = (np.array(x) for x in zip(*pairs, strict=True))
    got = set(zip(*(x.tolist() for x in decontaminate.search(ix, passage, term)[:2]), strict=True))
    want = set()
    for p in range(150):
        score = np.zeros(len(ix.need))
        for t in term[passage == p]:
            own = slice(ix.block_at[ix.block_first[t]], ix.block_at[ix.block_first[t + 1]])
            score[ix.piece[own]] += ix.impact[own]
        want |= {(p, int(k)) for k in np.flatnonzero(score >= ix.need)}
    assert got == want and want


def test_leaks_against_all_pairs(spark, monkeypatch):
    """Several shards, long items (in pieces, judged whole), repeated items, items without words."""
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 7)
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 40)
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(150)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, some(r.randrange(4, 30)) + r.choice([". ", " "]) + some(r.randrange(1, 9)) + ".") for i in range(25)]
    items += [(25, some(41)), (26, some(60) + ". " + some(25)), (27, some(200)), (3, items[4][1]), (3, items[4][1]), (30, None), (31, " ... ")]
    rows = []
    for i in range(70):
        parts = [some(r.randrange(0, 120))]
        if r.random() < 0.7:
            w = r.choice(items[:30])[1].split()
            a = r.choice([0, 0, len(w) // 3, len(w) // 2])
            w = w[a:] if r.random() < 0.5 else w[: len(w) - a]
            parts += [" ".join(x if r.random() < 0.93 else r.choice(vocabulary) for x in w), some(r.randrange(0, 60))]
        rows.append((i, " ".join(parts)))
    found = decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((g.doc_id, g.item_id, round(g.question_overlap, 6), round(g.answer_overlap, 6)) for g in found)
    want = sorted(brute.leaks(rows, items, 40))
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(want) > 15 and {26, 27} & {w[1] for w in want}


def test_scores(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["the ", "cat ", "A", "é", "\n", "dog"]) for _ in range(r.randrange(0, 12)))) for i in range(100)] + [(900, None), (901, "")]
    got = {g.doc_id: g for g in ctw.score(frame(spark, rows).withColumn("block", F.lit(1))).collect()}
    base, tree = brute.unigram(rows), brute.context_tree(rows)
    for i, _ in rows:
        assert tuple(got[i][1:5]) == base[i][:4]
        assert got[i].base_score == pytest.approx(base[i][4], abs=1e-8) and got[i].score == pytest.approx(tree[i], abs=1e-8)
    assert ctw.score(frame(spark, rows).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ren", "tu", "sa", "vo"]) for _ in range(r.randrange(2, 5)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    clean = [(i, text(8)) for i in range(40)]
    passage = text(6)
    item = " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6))
    near = clean[3][1].split(" ")
    near[40] = "changed"
    rows = clean + [(100, "too short"), (101, clean[0][1]), (102, " ".join(near).replace("\n", " ")), (103, clean[3][1].replace("\n", " ")), (104, text(3) + "\n" + passage), (105, text(3) + "\n" + passage), (106, text(3) + "\n" + item + "\n" + text(3)), (107, None)]
    df = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {g.doc_id: g for g in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) >= {i for i, _ in clean if i != 3} | {104, 105}
    assert not {100, 101, 106, 107} & set(got) and len({3, 102, 103} & set(got)) == 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns
    left = {d.doc_id: d.text for d in docs.collect()}
    assert passage in left[104] and passage not in left[105]
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).count() == len(rows)


def test_pipeline_against_plain(spark, tmp_path):
    """run() over copies, near copies, shared runs, leaks, junk, nulls, repeated rows of languages, against a plain version."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from leafquarry.llm import bpe

    r = random.Random(19)
    parts = {"xx": ["ka", "lo", "mi", "ren", "tu", "sa", "vo"], "yy": ["ün", "ße", "ich", "der", "ang", "ol"]}
    word = lambda x: "".join(r.choice(parts[x]) for _ in range(r.randrange(2, 5)))
    text = lambda n, x: "\n".join(" ".join(word(x) for _ in range(12)) for _ in range(n))
    rows = [(i, text(r.randrange(3, 12), x), x) for i, x in enumerate(["xx"] * 60 + ["yy"] * 40)]
    shared = text(6, "xx")
    items = [(k, text(2, "xx").replace("\n", ". ") + ".") for k in range(5)] + [(9, None), (10, text(60, "yy"))]
    rows += [(200 + i, f"{text(3, 'xx')}\n{shared}", "xx") for i in range(5)]
    rows += [(300 + i, f"{text(2, 'xx')}\n{items[i][1]}\n{text(2, 'xx')}", "xx") for i in range(4)] + [(310, items[6][1], "yy")]
    for i in range(20):
        w = rows[i][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((400 + i, " ".join(w).replace("\n", " "), rows[i][2]))
    rows += [(500, rows[0][1], "xx"), (501, None, "xx"), (502, "", None), (503, "too short", "yy"), (504, "".join(chr(r.randrange(0x21, 0x17F)) if k % 7 else " " for k in range(900)), "xx"), (505, text(4, "yy"), None)]
    df = spark.createDataFrame([(i, t, x, "s", len(t or ""), True) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, emptied boolean")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    half = {g.doc_id: g.h for g in df.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).alias("h")).collect()}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    want = brute.pipeline(rows, items, half, lambda t: tok.encode(t, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 60 < len(got) < len(rows) - 20
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
