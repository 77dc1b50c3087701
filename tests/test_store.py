"""The store: commits, two writers, segments, pruned reads, OCR that can be stopped."""

import json
import os
import subprocess
import sys
import threading
import time
from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from leafquarry import cli
from leafquarry.functions.text import normalize
from leafquarry.operators import enrich, postings, search, sweep
from leafquarry.operators.catalog import Catalog
from leafquarry.plans import query as Q
from leafquarry.schema import CONTENTS, DOCUMENTS, PAGES
from leafquarry.state import Change, Delta, Store
from pyspark.sql import functions as F

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
AT = datetime(2025, 1, 1)


def catalog(spark, n, pages=None, path="/d/{:04d}.pdf"):
    """n one-page documents; those without a text in pages wait for OCR."""
    pages = pages or {}
    contents = [(i, f"sum{i}", 1, i not in pages) for i in range(1, n + 1)]
    docs = [(i, path.format(i), i, AT, AT, i, False) for i in range(1, n + 1)]
    held = spark.createDataFrame([(i, i, 0, t, None) for i, t in pages.items()], PAGES)
    return Catalog(spark.createDataFrame(contents, CONTENTS), spark.createDataFrame(docs, DOCUMENTS), held.withColumn("search_text", normalize("markdown")))


def results(spark, texts):
    rows = [(i, f"/d/{i}", "OK", None, [(k, t) for k, t in enumerate(ts)]) for i, ts in texts.items()]
    return spark.createDataFrame(rows, "content_id long, path string, status string, error string, pages array<struct<page_index:int,markdown:string>>")


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file())


def test_commits(spark, tmp_path):
    at = str(tmp_path / "db")
    store = Store(spark, at)
    store.save(catalog(spark, 5, {3: "p zero", 4: "old"}))
    again = Store(spark, f"file:{at}")
    assert again.state == store.state and again.ids == sweep.Ids(6, 6, 5) and again.load().documents.count() == 5
    again.save(again.load().reset())
    assert Store(spark, at).ids == sweep.Ids(6, 6, 5) and Store(spark, at).load().documents.count() == 0  # ids are never used again
    for _ in range(3):
        store.save(catalog(spark, 2))
    assert len(os.listdir(f"{at}/log")) == 3 and len(os.listdir(f"{at}/documents")) == 3  # what readers may still hold
    store.write("held", store.load().pages)
    store.forget("held", "never")
    assert not os.path.exists(store.work("held"))
    with pytest.raises(ValueError):
        Store(spark, " ")
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "file"))
    newest = sorted(os.listdir(f"{at}/log"))[-1]
    Path(at, "log", newest).write_text(json.dumps({"schema": 9}))
    with pytest.raises(ValueError):
        Store(spark, at)


def test_migration(spark, tmp_path):
    """Folders of the two earlier layouts open, with all rows and ids."""
    for schema in (1, 2):
        at, c = tmp_path / f"v{schema}", catalog(spark, 3, {2: "**P** one"})
        for name in ("contents", "documents", "pages"):
            frame = getattr(c, name)
            (frame.drop("search_text") if schema == 1 and name == "pages" else frame).write.parquet(f"{at}/{name}/v=7")
        (at / "manifest.json").write_text(json.dumps({"schema": schema, "version": 7, "tables": dict.fromkeys(("contents", "documents", "pages"), 7), "next_id": {"contents": 40, "documents": 50}}))
        store = Store(spark, str(at))
        assert store.load().pages.where("search_text = 'p one'").count() == 1 and store.ids == sweep.Ids(40, 50, 3)
        assert not (at / "manifest.json").exists() and [p.name[:4] for p in (at / "pages").iterdir()] == ["seg="]
        assert Store(spark, str(at)).load().documents.count() == 3


def test_a_commit_that_comes_second_starts_again(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    store.save(catalog(spark, 4))
    seen = []

    def change(c):
        seen.append(sorted(r.id for r in c.documents.collect()))
        if len(seen) == 1:  # another writer gets in between
            other.commit(lambda _: Change(documents=Delta(None, catalog(spark, 1, path="/e/{}.pdf").documents.withColumn("id", F.lit(77).cast("long")))))
        return Change(documents=Delta(c.documents.where("id = 2").select("id")))

    store.commit(change)
    assert seen == [[1, 2, 3, 4], [1, 2, 3, 4, 77]]
    assert sorted(r.id for r in Store(spark, str(tmp_path / "db")).load().documents.collect()) == [1, 3, 4, 77]


SWEEP = """
import sys, time
from pyspark.sql import SparkSession
from leafquarry import cli
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.range(1).count()
open(sys.argv[2] + ".ready", "w").close()
import os
while not os.path.exists(sys.argv[3]):
    time.sleep(0.02)
sys.exit(cli.main(["--database", sys.argv[1], "--config", "/none", "sweep", sys.argv[2]], spark))
"""


def test_two_processes_sweep_at_once(spark, tmp_path):
    """Both start when both are ready; what each found is there, with ids of its own."""
    for k in "ab":
        (tmp_path / k).mkdir()
        for i in range(3):
            (tmp_path / k / f"{i}.png").write_bytes(f"{k}{i}".encode())
    db, go = str(tmp_path / "db"), tmp_path / "go"
    env = {**os.environ, "PYTHONPATH": TOP, "SPARK_LOCAL_DIRS": str(tmp_path)}
    running = [subprocess.Popen([sys.executable, "-c", SWEEP, db, str(tmp_path / k), str(go)], env=env, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True) for k in "ab"]
    until = time.time() + 120
    while not all((tmp_path / f"{k}.ready").exists() for k in "ab") and time.time() < until:
        time.sleep(0.1)
    go.touch()
    for p in running:
        out, err = p.communicate(timeout=180)
        assert p.returncode == 0 and "3 new" in out, err[-2000:]
    held = Store(spark, db).load()
    rows = held.documents_view().collect()
    assert sorted(r.path[-8:] for r in rows) == sorted(f"/{k}/{i}.png" for k in "ab" for i in range(3))
    assert len({r.id for r in rows}) == len({r.content_id for r in rows}) == 6


WORDS = ["tax", "alpha", "beta", "gamma", "report", "the", "of", "river", "heron", "slow"]
QUERIES = [("word", "tax OR river"), ("word", '"the report"'), ("word", "gam* NOT tax"), ("word", "NEAR(alpha beta, 2) OR slow"), ("trigram", '"pha"'), ("trigram", '"a tax"'), ("word", '"fresh words"')]


def texts(spark, seed, ids):
    import random

    r = random.Random(seed)
    return {i: " ".join(r.choices(WORDS, k=r.randrange(1, 150))) for i in ids}


def ranks(store, index, raw):
    return {(r.content_id, r.page_index): r["rank"] for r in postings.rank(store.indexes().of(index), Q.parse(raw)).collect()}


def same_as_rebuilt(spark, store, at):
    """Ranks of the store are those of a store built at once from the same pages."""
    whole = Store(spark, at)
    whole.save(store.load())
    assert whole.state["totals"] == store.state["totals"]
    for index, raw in QUERIES:
        assert ranks(store, index, raw) == pytest.approx(ranks(whole, index, raw), rel=1e-12), (index, raw)
    plain = {(r.content_id, r.page_index): r["rank"] for r in search.rank_pages(store.load().pages, Q.parse("tax OR river"), "word").collect()}
    assert ranks(store, "word", "tax OR river") == pytest.approx(plain)


def test_index_keeps_in_step(spark, tmp_path):
    """OCR of new contents, OCR again with other pages, and files that go, each in proportion to its change."""
    store = Store(spark, str(tmp_path / "db"))
    held = texts(spark, 1, range(1, 601))
    store.save(catalog(spark, 620, held))
    whole = size(tmp_path / "db")
    segments = {p.name for p in (tmp_path / "db" / "pages").iterdir()}
    store.stored(results(spark, {601: ["tax fresh words", "the report"], 602: ["river of slow tax"]}))
    assert size(tmp_path / "db") - whole < whole / 4 and segments < {p.name for p in (tmp_path / "db" / "pages").iterdir()}
    store.stored(results(spark, {5: ["fresh words again"], 601: ["alpha only"], 9999: ["no such content"]}))
    gone = store.load()
    kept = gone.documents.where("id not in (7, 8, 602)")
    store.commit(lambda c: store.replaced(c, replace(c, documents=kept).drop_orphans()))
    c = store.load()
    assert sorted((r.page_index, r.search_text) for r in c.pages.where("content_id in (5, 601, 602, 7)").collect()) == [(0, "alpha only"), (0, "fresh words again")]
    assert c.contents.where("id = 601").first().ocr_pending is False and c.contents.where("id = 603").first().ocr_pending is True
    assert len({r.id for r in c.pages.collect()}) == c.pages.count() == 599
    assert store.state["totals"]["pages"] == 599 and len(store.state["tables"]["pages"]["segments"]) == 2  # a segment that had lost half its rows is written anew
    same_as_rebuilt(spark, store, str(tmp_path / "whole"))


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    from leafquarry import state

    monkeypatch.setattr(state, "MERGE", 3)
    store = Store(spark, str(tmp_path / "db"))
    store.save(catalog(spark, 40, texts(spark, 2, range(1, 31))))
    for k in range(3):
        store.stored(results(spark, {31 + k: [texts(spark, 3 + k, [0])[0]]}))
    assert len(store.state["tables"]["pages"]["segments"]) == 2  # the three small ones are one
    store.stored(results(spark, {i: ["tax river"] for i in range(1, 13)}))  # over a quarter of the first is dead
    assert not store.state["tables"]["pages"]["dead"] and sum(s["rows"] for s in store.state["tables"]["pages"]["segments"]) == 33
    same_as_rebuilt(spark, store, str(tmp_path / "whole"))


def files_read(frame):
    """Files that the scans of a frame have opened, by its plan's own count."""
    frame.collect()
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            todo.append(node.plan())
        elif name.startswith("Scan "):
            n = node.metrics().get("numFiles")
            found.append((node.relation().location().rootPaths().head().toString(), n.get().value()))
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_few_files_are_read(spark, tmp_path):
    """One path opens one file of documents; one document's pages, and a page of results with its texts, open the folders of
    their blocks; a query's terms open the files they fall into."""
    store = Store(spark, str(tmp_path / "db"), block=16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.save(catalog(spark, 600, texts(spark, 4, range(1, 601)) | {33: "a heron called zebra", 590: "zebra two"}))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    count = lambda table: sum(1 for p in Path(tmp_path, "db", table).rglob("part-*"))
    assert count("pages") >= 38 and count("documents") >= 4 and count("word") >= 4
    path, c = "/d/0033.pdf", store.load()
    by = lambda found, table: sum(n for at, n in found if f"/{table}/" in at)
    got = files_read(store.at_path(path).by_path(path))
    assert by(got, "documents") == 1 and by(got, "contents") == 1
    assert store.at_path(path).by_path(path).first().checksum == "sum33" and not store.at_path("/none").by_path("/none").take(1)
    got = files_read(store.at_path(path).read(path))
    assert by(got, "documents") == 1 and by(got, "pages") == 1
    page = search.find(c.dealt.pages, c.documents, c.contents, search.Options("zebra", limit=5, path_fallback=False), indexes=store.indexes())
    assert [r.path for r in page.collect()] == ["/d/0590.pdf", path] and all(">>>zebra<<<" in r.snippet for r in page.collect())
    got = files_read(page)
    assert by(got, "pages") == 2 and by(got, "word") <= 2 * 1


def slow(log, wait):
    """A provider that writes down each call; all files but the first take long."""

    class Slow:  # here, so that it is sent to the workers by value
        price_per_page = 0.005

        def ocr_file(self, path, content_type):
            name = os.path.basename(path)
            with open(f"{log}/{name}.{time.time_ns()}", "w"):
                pass
            if name != "0001.pdf":
                time.sleep(wait)
            return [(0, f"text of {name}")]

    return Slow


def numbered(store, first):
    return store.write("numbered", enrich.jobs(store.load()).withColumn("n", F.col("content_id") - first))


def test_ocr_is_stopped(spark, tmp_path):
    """Stopped after the first file: it ends soon, the first file's text is stored, and the next run reads the others alone."""
    store = Store(spark, str(tmp_path / "db"))
    store.save(catalog(spark, 3))
    log, stop, told = tmp_path / "calls", threading.Event(), []
    log.mkdir()
    stopped = []

    def watch():
        until = time.time() + 60
        while len(list(log.iterdir())) < 2 and time.time() < until:
            time.sleep(0.02)
        stopped.append(time.monotonic())
        stop.set()

    threading.Thread(target=watch).start()
    at = str(log)
    work, kept = numbered(store, 1), []
    begin = lambda r: kept.append(time.monotonic()) or store.stored(r)
    enrich.in_waves(work, store.work("results"), slow(at, 30), begin, told.append, stop, 1).count()
    assert kept[-1] - stopped[0] < 1.5  # the call under way is not waited for
    assert [r.id for r in store.load().contents.where("not ocr_pending").collect()] == [1]
    assert ranks(store, "word", "text").keys() == {(1, 0)} and any(t.startswith("[1/3] OK: 0001.pdf") for t in told)
    for p in log.iterdir():
        p.unlink()
    store.forget("results", "numbered")
    out = enrich.in_waves(work := numbered(store, 2), store.work("results"), slow(at, 0), store.stored, told.append, threading.Event(), 2)
    assert sorted(p.name[:8] for p in log.iterdir()) == ["0002.pdf", "0003.pdf"] and work.count() == 2
    assert {r.status for r in out.collect()} == {"OK"} and store.load().contents.where("ocr_pending").count() == 0
    assert any("files read" in t for t in told)
