from datetime import datetime, timezone

import pytest

from leafquarry.operators import enrich, sweep
from leafquarry.operators.catalog import Catalog
from leafquarry.schema import CONTENTS, DOCUMENTS, PAGES


def day(n):
    return datetime(2025, 1, n)


def catalog(spark, contents, documents, pages=()):
    """contents: (id, checksum, page_count, pending); documents: (id, path, content_id, day, deleted)."""
    docs = [(i, p, c, day(d), day(d), d * 1000, x) for i, p, c, d, x in documents]
    return Catalog(spark.createDataFrame(list(contents), CONTENTS), spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(list(pages), PAGES))


@pytest.fixture
def small(spark):
    contents = [(1, "a", 1, True), (2, "b", 2, False), (3, "c", 3, False), (4, "d", 10, True)]
    documents = [(1, "/r1/first", 1, 1, False), (2, "/r1/second", 2, 2, False), (3, "/r2/third", 3, 3, False), (4, "/r2/gone", 4, 4, True), (5, "/r2/copy", 1, 2, False)]
    return catalog(spark, contents, documents, [(1, 3, 0, "p0", "p0"), (2, 3, 1, "p1", "p1"), (3, 3, 2, "p2", "p2"), (4, 4, 0, "old", "old")])


def paths(df):
    return [r.path for r in df.collect()]


def test_lists(small):
    assert paths(small.list()) == ["/r2/third", "/r1/second", "/r2/copy", "/r1/first"]
    assert paths(small.list(after=day(2))) == ["/r2/third", "/r1/second", "/r2/copy"]
    assert paths(small.list(before=day(2))) == ["/r1/first"]
    assert paths(small.list(limit=1, offset=1)) == ["/r1/second"]
    assert small.by_path("/r2/gone").first().deleted and not small.by_path("/none").take(1)
    assert small.by_checksum("b").first().id == 2


def test_statistics(small):
    assert tuple(small.pending_stats().first()) == (1, 1)
    assert tuple(small.stats().first()) == (4, 7)
    assert tuple(small.cost().first()) == (1, 1, 0.01) or small.cost().first().dollars == pytest.approx(0.005, abs=0.006)
    assert {(r.content_id, r.path) for r in small.representative_paths().collect()} == {(1, "/r1/first"), (2, "/r1/second"), (3, "/r2/third")}
    assert [r.id for r in small.pending_contents().collect()] == [1]
    assert [r.id for r in small.orphans().collect()] == [4]
    assert [r.id for r in small.live_contents().collect()] == [1, 2, 3]


def test_pages(small):
    assert [r.markdown for r in small.read("/r2/third", (1, 2)).collect()] == ["p1", "p2"]
    assert small.page("/r2/third", 0) == "p0"
    with pytest.raises(LookupError):
        small.page("/r2/third", 9)
    new = small.contents.sparkSession.createDataFrame([(3, [(0, "# Alpha **Beta**"), (1, "new-1")]), (1, [(0, "x")])], "content_id long, pages array<struct<page_index:int,markdown:string>>")
    after = small.replace_pages(new)
    assert sorted((r.content_id, r.page_index, r.search_text) for r in after.pages.collect()) == [(1, 0, "x"), (3, 0, "alpha beta"), (3, 1, "new 1"), (4, 0, "old")]
    assert {r.id: r.id in (1,) and r.id or r.id for r in after.pages.collect()} and len({r.id for r in after.pages.collect()}) == 4
    assert {r.id: r.ocr_pending for r in after.contents.collect()} == {1: False, 2: False, 3: False, 4: True}


def test_transitions(small, spark):
    seen = spark.createDataFrame([("/r1/first",)], "path string")
    gone = small.soft_delete_missing(seen, ["/r1"])
    assert {r.path for r in gone.documents.where("deleted").collect()} == {"/r1/second", "/r2/gone"}
    left = gone.drop_orphans()
    assert sorted(r.id for r in left.contents.collect()) == [1, 3] and sorted(r.id for r in left.documents.collect()) == [1, 3, 5] and left.pages.count() == 3
    assert small.reset().documents.count() == 0
    with pytest.raises(ValueError):
        small.insert_content("a", 1, 9)
    assert small.insert_content("z", 1, 9).mark_done([9]).contents.where("id = 9").first().ocr_pending is False


def scan(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, mtime_ns long, checksum string, page_count int, error string")


def test_sweep_flags(spark):
    """The pending flag over a first sweep, a touch, an edit, and an edit that keeps the time."""
    c = catalog(spark, [], [])
    ids, steps = (1, 1), [("v1", 1, True), ("v1", 2, False), ("v2", 3, True), ("v3", 3, False)]
    for k, (bytes_, at, pending) in enumerate(steps):
        decided = sweep.decide(c, scan(spark, ("/d/a.pdf", at, bytes_, 1, None)), ["/d"])
        c = sweep.apply(c, decided, sweep.Ids(10 * k + 1, 10 * k + 1))
        rows = c.documents_view().collect()
        c = Catalog(*(spark.createDataFrame(x.collect(), x.schema) for x in (c.contents, c.documents, c.pages)))
        assert [(r.checksum, r.ocr_pending) for r in rows] == [(bytes_, pending)], steps[k]
        c = Catalog(spark.createDataFrame(c.mark_done([r.content_id for r in rows]).contents.collect(), CONTENTS), c.documents, c.pages)


def test_sweep_actions(small, spark):
    rows = [("/r1/first", 1000, "a", 1, None), ("/r1/second", 9, "b", 2, None), ("/r2/gone", 1, "a", 1, None), ("/r2/copy", 2000, None, None, "bad"), ("/r2/new", 5, "a", 1, None), ("/r2/new", 5, "a", 1, None)]
    decided = sweep.decide(small, scan(spark, *rows), ["/r1", "/r2"])
    assert {r.path: r.action for r in decided.collect()} == {"/r1/first": "unchanged", "/r1/second": "touched", "/r2/gone": "restored", "/r2/copy": "failed", "/r2/new": "new", "/r2/third": "deleted"}
    assert sweep.counters(decided, 1).first().asDict() == {"scanned": 7, "new": 1, "updated": 0, "restored": 1, "deleted": 1, "unchanged": 3, "failed": 1}
    after = sweep.apply(small, decided, sweep.Ids(50, 60))
    assert {r.path for r in after.documents.where("not deleted").collect()} == {"/r1/first", "/r1/second", "/r2/gone", "/r2/copy", "/r2/new"}
    assert after.documents.where("path = '/r2/new'").first().id == 60


def test_ocr(spark):
    class Provider:
        price_per_page = 0.005

        def ocr_file(self, path, content_type):
            if "second" in path:
                raise OSError("x" * 500)
            return [(0, path), (1, "two")]

    c = catalog(spark, [(1, "a", 1, True), (2, "b", 1, True), (3, "c", 1, True)], [(1, "/first.pdf", 1, 1, False), (2, "/second.pdf", 2, 1, False), (3, "/third.txt", 3, 1, False), (4, "/copy.pdf", 1, 1, False)])
    results = enrich.run_ocr(enrich.jobs(c), Provider).cache()
    assert sorted((r.content_id, r.status) for r in results.collect()) == [(1, "OK"), (2, "FAIL"), (3, "SKIP")]
    after = c.replace_pages(results.where("status = 'OK'").select("content_id", "pages"))
    assert {r.id: r.ocr_pending for r in after.contents.collect()} == {1: False, 2: True, 3: True} and after.pages.count() == 2
    twice = spark.createDataFrame([(2, [(0, "z"), (1, "b"), (0, "a")])], "content_id long, pages array<struct<page_index:int,markdown:string>>")
    assert sorted((r.page_index, r.markdown) for r in c.replace_pages(twice).pages.collect()) == [(0, "a"), (1, "b")]  # the last one counts
    p = enrich.progress(results, 4, 10.0).first()
    assert (p.succeeded, p.failed, p.skipped, p.percent, p.eta) == (1, 1, 1, 75.0, 5.0)


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        enrich.retrying(call, lambda e: 0.0, jitter=lambda: 0.5, sleep=waits.append)
    assert len(calls) == 5 and waits == [1, 2, 4, 8]
    with pytest.raises(OSError):
        enrich.retrying(call, lambda e: None, sleep=waits.append)
    assert len(calls) == 6
