"""Whitening, the filter audit and sharding against plain versions, and every registered query on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from leafquarry.llm import filter_audit, near_dedup, line_dedup, pii, sharding, whitening
from leafquarry.llm.queries import QUERIES

# ---- op11


def plain_whitening(rows, k=8):
    """Components by a dense eigensolver: {id: (deviation, whitened)}, explained."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    xs = [[math.floor(1024 * c) + 100000 for c in v] + [100000] * (d - len(v)) for _, v in kept]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    off = np.array([[n * a - s for a, s in zip(x, sums)] for x in xs], float) / n
    values, found = np.linalg.eigh(off.T @ off / n)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    w = off @ found / np.sqrt(values)
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    return [i for i, _ in kept], dev, w, values / np.trace(off.T @ off / n)


def as_frame(spark, rows, extra="label int"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<float>, {extra}").repartition(3)


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    scale = np.array([3.0, 2.5, 2.5, 1.8, 1.2, 1.0, 0.9, 0.8, *[0.3] * 32])
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=40) * scale + 5)]) for i in range(400)]
    rows += [(900, None), (901, [float("nan")] * 40), (902, [1.0] * 39 + [None]), (903, [float("inf")] + [0.0] * 39), (904, rows[7][1]), (904, rows[7][1]), (905, rows[3][1][:20]), (None, rows[9][1])]
    got = whitening.components_table(as_frame(spark, rows)).collect()
    ids, dev, want, shares = plain_whitening(rows)
    assert len(got) == len(ids) * 8 and {g.n for g in got} == {len(ids)} and max(g.identity_error for g in got) < 1e-10
    by = defaultdict(list)
    for g in got:
        by[g.component].append(g)
    for k in range(8):
        own = sorted(by[k + 1], key=lambda g: (g.vec_id or -1, g.deviation))
        plain = sorted(zip(ids, dev, want[:, k]), key=lambda r: (r[0] or -1, r[1]))
        assert [(g.vec_id, g.deviation) for g in own] == [r[:2] for r in plain]
        assert own[0].explained == pytest.approx(shares[k], rel=1e-9)
        a, b = np.array([g.whitened for g in own]), np.array([r[2] for r in plain])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_whitening_of_odd_tables(spark):
    count = lambda rows: whitening.components_table(as_frame(spark, rows, "component int")).count()
    assert count([]) == 0 and count([(1, None)]) == 0 and count([(1, [])]) == 0
    assert count([(1, [1.0, 2.0])]) == 0 and count([(1, [1.0, 2.0])] * 3) == 0  # nothing differs
    assert count([(1, [1.0, 2.0]), (2, [1.0, 5.0])]) == 2  # one dimension varies
    far = whitening.components_table(as_frame(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert {g.deviation for g in far} == {None, *(g.deviation for g in far)} and all(math.isfinite(g.whitened) for g in far)


def test_lanczos():
    """Restarts of a short basis, breakdown in an invariant space, and equal eigenvalues."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    for values, most in ((np.linspace(10, 1, 120), 40), (np.r_[[7.0] * 10, [1.0] * 110], 256), (np.r_[[5.0, 4.0, 3.0], [0.0] * 117], 256)):
        v = (q * values) @ q.T
        got, found, residuals, passes = whitening.lanczos(lambda x: v @ x, 120, 8, block=8, most=most, passes=400)
        assert got == pytest.approx(np.sort(values)[::-1][:8], abs=1e-9) and residuals.max() < 1e-9
        assert np.abs(found.T @ found - np.eye(8)).max() < 1e-10 and np.abs(v @ found - found * got).max() < 1e-9
    assert whitening.lanczos(lambda x: 0 * x, 5, 8)[0] == pytest.approx([0] * 5)


# ---- op12


def plain_audit(docs, labels):
    words = lambda t: [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {part or "": {} for _, _, part in docs}
    rows = []
    for i, t, part in docs:
        t = t or ""
        ws = words(t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    for part, own in out.items():
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                own[order, s + 1] = [sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
        for (order, s), v in own.items():
            v.append(total[order[s - 1]])
    return {(part, *k): tuple(v) for part, own in out.items() for k, v in own.items()}


def test_filter_audit(spark):
    r = random.Random(4)
    vocabulary = [f"{c}w{k}" for k in range(300) for c in "ab"]
    text = lambda n, k, shout, mark: " ".join((w.upper() * 2 if r.random() < shout else w) for w in r.choices(vocabulary[:k], k=n)) + mark
    docs = [(i, text(r.choice([5, 99, 100, 101, 180]), r.choice([40, 600]), r.choice([0, 0.1, 0.5]), r.choice(["", "", " 5%", "|"])), r.choice(["en", "fr", None, ""])) for i in range(90)]
    docs += [(200 + i, docs[i % 9][1], "fr") for i in range(30)] + [(3, docs[3][1], "en"), (3, docs[3][1], "de"), (None, docs[4][1], "en"), (300, None, "en"), (301, "", "en"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*range(60), *range(200, 230), 3, 3, 999]] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(g.part, g.filter_order, g.step): tuple(g)[3:] for g in filter_audit.audit(frame, said).collect()}
    assert got == plain_audit(docs, labels) and len(got) == 4 * 600
    assert filter_audit.audit(frame.limit(0), said).count() == 0
    assert all(v[4:6] == (0, 0) for v in (tuple(g)[3:] for g in filter_audit.audit(frame, said.limit(0)).collect()))


# ---- op13


def plain_shards(docs, count=16, slack=0.02):
    """{row number: (size, crc, shard)} by one sorted list."""
    rows = sorted((hashlib.md5((t or "").encode()).hexdigest(), (i is not None, i), k, len((t or "").encode()) + 1) for k, (i, t) in enumerate(docs))
    total, at, before, by = sum(x[3] for x in rows), 0, {}, defaultdict(list)
    for x in rows:
        before[x] = at
        at += x[3]
        by[x[0]].append(x)
    out = {}
    for own in by.values():
        size = sum(x[3] for x in own)
        whole = size * count <= slack * total and len(own) * count <= slack * len(rows)
        for x in own:
            twice = 2 * before[own[0]] + size if whole else 2 * before[x] + x[3]
            out[x[2]] = (x[3], zlib.crc32((docs[x[2]][1] or "").encode()), min(twice * count // (2 * total), count - 1))
    return out


@pytest.mark.parametrize("ranges,draws", [(512, 16), (8, 2), (3, 1)])
def test_shards(spark, ranges, draws):
    r = random.Random(9)
    docs = [(i, "".join(r.choice("abc dé\U0001f600") for _ in range(r.randrange(1, 60)))) for i in range(900)]
    docs += [(2000 + i, "a text that a third of all rows share " * 2) for i in range(500)] + [(3000 + i, r.choice(["", None])) for i in range(200)]
    docs += [(5, docs[5][1])] * 40 + [(None, docs[6][1])] * 3 + [(4000 + i, docs[i // 2][1]) for i in range(60)] + [(9, "long " * 3000)]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, shard int, key string").repartition(4)
    got = sharding.shards(frame, ranges=ranges, draws=draws).collect()
    want = plain_shards(docs)
    assert Counter((g.doc_id, g.size, g.text_crc32, g.shard) for g in got) == Counter((docs[k][0], *v) for k, v in want.items())
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_sizes(spark):
    """Near equal bytes, with a text that a third of all rows share; other groups of equal texts stay whole."""
    r = random.Random(10)
    docs = [(i, " ".join(r.choice(["ab", "cde", "fghi"]) for _ in range(r.randrange(1, 9)))) for i in range(4000)]
    docs = [(i, f"{t} {i // 2}") for i, t in docs]
    docs += [(i, docs[i % 700][1] + " again") for i in range(5000, 6500)] + [(10000 + i, "shared by a third of all") for i in range(2700)]
    got = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string"), ranges=64).collect()
    sizes = [sum(g.size for g in got if g.shard == s) for s in range(16)]
    assert max(abs(16 * s / sum(sizes) - 1) for s in sizes) < 0.02
    texts, where = dict(docs), defaultdict(set)
    for g in got:
        where[texts[g.doc_id]].add(g.shard)
    assert [t for t, s in where.items() if len(s) > 1] == ["shared by a third of all"]


def test_shards_of_odd_tables(spark):
    frame = lambda rows: sharding.digest(sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert frame([]) == []
    (only,) = frame([(None, None)])
    assert tuple(only) == (None, 1, 0, "bytes", 8, 0, None)
    assert len({g.shard for g in frame([(1, "same")] * 64)}) == 16  # copies beyond a shard's part are cut at rows


# ---- every registered query


CLASHING = ["row", "id", "key", "shard", "slot", "size", "part", "mask", "n_lines", "N_Removed", "removed", "emptied", "kept", "component_id", "n_shingles", "cls", "seen", "terms", "spans", "score", "predicted", "held_out", "n_words", "block", "pack", "verdict", "host", "path", "rule", "n_tokens", "tokens", "leaks", "first", "at", "file", "h", "n", "deviation", "whitened", "component", "same", "text_crc32"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, ties and columns that the operators use themselves, and the same ones bare; also as JSON and ORC."""
    r = random.Random(12)
    text = lambda n: "\n".join(" ".join(r.choice(["kal", "lor", "mit", "ren", "tus", "ov"]) + r.choice("abcdef") for _ in range(12)) for _ in range(n))
    texts = [text(r.randrange(1, 9)) for _ in range(60)]
    shared = text(7)
    docs = [(i, t, r.choice(["en", "fr", None]), "s") for i, t in enumerate(texts)] + [(100 + i, f"{shared}\nmail a{i}@b.org", "en", None) for i in range(6)]
    docs += [(200, None, None, None), (201, "", "en", "s"), (None, texts[3], "en", "s"), (7, texts[7], "fr", "s"), (7, texts[7], "fr", "s")]
    items = [(1, " ".join(texts[2].split()[:30])), (2, None), (None, "x")]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string"),
        "labels": ([(i, i % 2, i % 3 % 2) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
        "pages": ([(1, "http://WWW.Example.com/en/a?b#c", "x"), (2, None, None), (None, "no url", ""), (1, "https://a.net/es/", "x")], "page_id long, url string, html string"),
        "embeddings": ([(i, [r.random() for _ in range(12)], 1) for i in range(40)] + [(None, None, None)], "vec_id long, embedding array<float>, label int"),
    }
    top = tmp_path_factory.mktemp("odd")
    for name, (rows, schema) in tables.items():
        bare = spark.createDataFrame(rows, schema).coalesce(1)
        taken = {c.lower() for c in bare.columns}
        from pyspark.sql import functions as F

        more = bare.select("*", *[(F.lit(-7) if k % 2 else F.lit("clash")).alias(c) for k, c in enumerate(CLASHING) if c.lower() not in taken])
        bare.write.parquet(f"{top}/bare/{name}.parquet")
        more.write.parquet(f"{top}/clash/{name}.parquet")
    bare = spark.createDataFrame(*tables["documents"]).coalesce(1)
    bare.write.json(f"{top}/json")
    bare.write.orc(f"{top}/orc")
    return str(top)


def rounded(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_columns_that_clash(spark, odd, name):
    """Extra columns, whatever their names and types, change nothing in what a registered query returns."""
    bare, more = (QUERIES[name](spark, f"{odd}/{kind}") for kind in ("bare", "clash"))
    assert bare.columns == more.columns
    got = rounded(bare.collect())
    assert got == rounded(more.collect()) and got


RUNS = {"json": (near_dedup.deduplicate, line_dedup.line_dedup), "orc": (lambda d: pii.digest(pii.find_personal(d)), lambda d: sharding.digest(sharding.shards(d)))}


@pytest.mark.parametrize("kind", RUNS)
def test_other_formats(spark, odd, kind):
    """Files whose rows have no place of their own are written once, and give the same rows."""
    reader = getattr(spark.read.schema("doc_id long, text string, lang string, source string"), kind)
    for run in RUNS[kind]:
        assert rounded(run(reader(f"{odd}/{kind}")).collect()) == rounded(run(spark.read.parquet(f"{odd}/bare/documents.parquet")).collect())


def test_a_contact_list_in_two_versions(spark, tmp_path):
    """Twenty thousand addresses and as many words in each of two texts: 800 million pairs, two classes. What stands in both
    discloses, what stands in one does not, and a word that other texts have as well is not told apart."""
    shared = [f"word{k:05d}" for k in range(20000)]
    lists = [" ".join(f"{w} p{k}@mail.org" for k, w in enumerate(shared)) + f" only{v} p{v}x@mail.org common" for v in range(2)]
    rows = [(i, t) for i, t in enumerate(lists)] + [(10 + i, f"common text {i}") for i in range(30)] + [(50, "word00007 elsewhere"), (51, "word00007 again"), (52, "word00007 more"), (53, "word00009 alone")]
    found = {g.doc_id: g for g in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    marked = {i: {texts[i][s.start : s.end] for s in g.term} for i, g in found.items()}
    assert marked[0] == marked[1] == set(shared) - {"word00007", "word00009"} and not marked[50] and not marked[53] and not marked[10]
