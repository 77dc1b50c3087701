import json
import os

import pytest

from leafquarry import cli, sinks
from leafquarry.functions import arguments, paths
from leafquarry.functions.text import annotation, content_type, duration, shortened, with_annotations
from leafquarry.schema import FOUND
from leafquarry.sources import config, files, ocr_http
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    for p in ("docs/a.pdf", "docs/sub/b.PDF", "docs/sub/c.png", "docs/_d.jpg", "docs/.e.jpeg", "docs/n.txt", "images/f.png", "docs/.DS_Store", "docs/._g.png", "docs/.Trash/h.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    return tmp_path


def pdf(objects, trailer=b"<< /Root 1 0 R >>"):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects)
    return b"%PDF-1.7\n" + body + b"trailer\n" + trailer + b"\n%%EOF\n"


def test_pdf_pages(tmp_path):
    import zlib

    from leafquarry.sources.pdf import page_count

    inner = b"1 0 2 34 << /Type /Catalog /Pages 2 0 R >>    << /Type /Pages /Count 12 /Kids [] >>"
    first = inner.index(b"<<")
    inner = b"1 0 2 %d" % (inner.index(b"<< /Type /Pages") - first) + b" " * (first - len(b"1 0 2 34")) + inner[first:]
    packed = zlib.compress(inner)
    stream = b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (first, len(packed)) + packed + b"\nendstream"
    plain = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 >>"), (3, b"<< /Type /Pages /Count 2 >>"), (4, b"<< /Type /Page /Annots << >> >>")]
    cases = {
        "plain": (pdf(plain), 3),
        "indirect": (pdf([plain[0], (2, b"<< /Type /Pages /Count 9 0 R >>"), (9, b" 5 ")]), 5),
        "updated": (pdf(plain) + pdf([(2, b"<</Type/Pages/Count 4>>")])[9:], 4),
        "packed": (pdf([(7, stream), (8, b"<< /Type /XRef /Root 1 0 R >>\nstream\nxx\nendstream")], b""), 12),
        "no root": (pdf(plain[1:], b"<< >>"), 3),
        "pages only": (pdf([(4, b"<< /Type /Page >>"), (5, b"<</Type/Page/X 1>>")], b"<< >>"), 2),
    }
    for name, (data, want) in cases.items():
        (tmp_path / name).write_bytes(data)
        assert page_count(str(tmp_path / name)) == want, name
    for bad in (b"", b"hello", b"%PDF-1.4 nothing", pdf([(1, b"<< >>")], b"<< /Encrypt 3 0 R >>")):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            page_count(str(tmp_path / "bad"))


def test_scan_is_cut_into_parts(tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / f"d{k % 5}" / f"e{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{k % 5}" / f"e{k % 3}" / f"{k}.png").write_bytes(b"x")
    whole = sorted(p for p, *_ in files.walk(str(tmp_path)))
    for most in (1, 4, 100):
        monkeypatch.setattr(files, "PARTS", most)
        cut = files.parts([str(tmp_path)], False)
        assert sorted(p for tops in cut for top in tops for p, *_ in files.walk(top)) == whole and len(whole) == 30
    assert len(cut) == 15


def names(df, top):
    return sorted(os.path.relpath(r.path, top) for r in df.collect())


def test_scan(spark, tree):
    all_ = names(files.scan(spark, [str(tree)]), tree)
    assert all_ == ["docs/.Trash/h.png", "docs/._g.png", "docs/.e.jpeg", "docs/_d.jpg", "docs/a.pdf", "docs/sub/b.PDF", "docs/sub/c.png", "images/f.png"]
    assert names(files.scan(spark, [str(tree)], skip_macos=True), tree) == ["docs/.e.jpeg", "docs/_d.jpg", "docs/a.pdf", "docs/sub/b.PDF", "docs/sub/c.png", "images/f.png"]
    assert names(files.scan(spark, [str(tree / "images"), str(tree / "docs/a.pdf"), str(tree / "none")]), tree) == ["docs/a.pdf", "images/f.png"]
    rows = {os.path.basename(r.path): r for r in files.measured(files.scan(spark, [str(tree)]), lambda p, k: 3 if p.endswith("a.pdf") else 1 / 0, ["f.png"]).collect()}
    assert rows["a.pdf"].page_count == 3 and rows["b.PDF"].error and rows["b.PDF"].checksum is None and "f.png" not in rows
    import hashlib

    assert rows["c.png"].checksum == hashlib.sha256(b"docs/sub/c.png").hexdigest() and rows["c.png"].page_count == 1


def test_resolve(tree):
    found, roots, warnings = paths.resolve([f"{tree}/docs/**/*.pdf", f"{tree}/docs/a.pdf", f"{tree}/images"])
    assert found == [f"{tree}/docs/a.pdf", f"{tree}/images"] and roots == [f"{tree}/docs", f"{tree}/images"] and not warnings
    assert paths.resolve([f"{tree}/x/*.pdf"])[2]
    with pytest.raises(FileNotFoundError):
        paths.resolve([f"{tree}/none"])
    assert paths.glob_root("/a/b/*/c.pdf") == "/a/b" and paths.glob_root("/*.pdf") == "/"
    assert paths.minimal_roots(["/a/b", "/a", "/ab", "/a/"]) == ["/a", "/ab"]
    for bad in (f"{tree}/docs/sub", f"{tree}/none.pdf", "[invalid"):
        with pytest.raises(ValueError):
            paths.check_excludes([bad])
    paths.check_excludes(["*.pdf", f"{tree}/docs/a.pdf"])


def test_globs(spark):
    cases = [("/a/b/c.pdf", "*.pdf", True), ("/a/b/c.pdf", "/a/*.pdf", False), ("/a/b/c.pdf", "/a/**/*.pdf", True), ("/a/c.pdf", "/a/**/*.pdf", True), ("/a/b.png", "/a/{b,c}.p?g", True), ("/a/d.png", "/a/[a-c].png", False), ("/a/d.png", "/a/[!a-c].png", True)]
    for path, pattern, want in cases:
        assert spark.range(1).select(paths.matches_any(F.lit(path), [pattern])).first()[0] is want, (path, pattern)
    with pytest.raises(ValueError):
        paths.matches_any(F.lit("x"), ["[invalid"])
    inside = lambda p, roots: spark.range(1).select(paths.within(F.lit(p), roots)).first()[0]
    assert inside("/a/b", ["/a"]) and not inside("/ab", ["/a"]) and inside("/x", []) and inside("/a", ["/a/"])


def test_arguments():
    assert arguments.page_range(page=1, context=3) == (0, 4) and arguments.page_range(start=1, end=3) == (1, 3) and arguments.page_range() is None
    for bad in ({"page": 1, "start": 1}, {"context": 1}, {"start": 3, "end": 1}, {"start": 1}, {"page": -1}):
        with pytest.raises(ValueError):
            arguments.page_range(**bad)
    assert arguments.time_bound("2025-01-02").isoformat() == "2025-01-02T00:00:00+00:00" and arguments.time_bound(" ") is None
    assert arguments.time_bound("2025-01-02T03:04:05+02:00").utcoffset().total_seconds() == 7200
    for bad in ("yesterday", "2025-01-02T03:04:05", "2025-13-01"):
        with pytest.raises(ValueError):
            arguments.time_bound(bad)
    with pytest.raises(ValueError):
        arguments.window(-1, 0)
    with pytest.raises(ValueError):
        arguments.concurrency(0)


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(duration(F.lit(s))) for s in (0, 0.5, 59, 61, 3661)] == ["0s", "<1s", "59s", "1m01s", "1h01m"]
    assert one(shortened(F.lit("x" * 60))) == "x" * 47 + "..." and one(content_type(F.lit("/a.b/C.JPeg"))) == "jpeg" and one(content_type(F.lit("/a.pdf/x"))) is None
    shapes = {'{"image_type":"scatter plot","description":"d"}': ("scatter plot", "d"), " text ": ("image", "text"), "": ("image", ""), "{broken": ("image", "{broken"), "{}": ("image", "")}
    for k, v in shapes.items():
        assert tuple(one(annotation(F.lit(k)))) == v
    assert one(with_annotations(F.lit("m"), F.array(F.lit("a"), F.lit(None).cast("string")))) == "m\n\n[Image: image — a]"


def test_http(tmp_path):
    f = tmp_path / "a.pdf"
    f.write_bytes(b"x")
    asked, waits = [], []

    def post(body):
        asked.append(json.loads(body))
        if len(asked) < 3:
            raise ocr_http.HttpError(429 if len(asked) == 1 else 503, "busy", "7" if len(asked) == 1 else None)
        image = lambda a: {"image_annotation": a}
        return json.dumps({"pages": [{"index": 0, "markdown": "t", "images": [image({"image_type": "plot", "description": "d"}), image("plain"), image('{"description": "in"}'), image(None)]}]}).encode()

    got = ocr_http.HttpOcr("u", "k", "m", {"name": "s"}, post, jitter=lambda: 0.5, sleep=waits.append).ocr_file(str(f), "pdf")
    assert got == [(0, "t\n\n[Image: plot — d]\n\n[Image: image — plain]\n\n[Image: image — in]")]
    assert waits == [7, 2] and asked[0]["document"]["document_url"] == "data:application/pdf;base64,eA==" and asked[0]["bbox_annotation_format"]["type"] == "json_schema"
    assert ocr_http.wait_for(ocr_http.HttpError(400, "no", None)) is None and ocr_http.wait_for(OSError()) == 0.0


def test_sinks(spark):
    rows = [("/a<b>.pdf", 0, 1, 'x "q"', -1.5e-6, "fts"), ("/b.pdf", 2, 3, "", 0.0, "path")]
    df = spark.createDataFrame(rows, FOUND)
    assert list(sinks.found_json(df)) == ['{"path":"/a<b>.pdf","page_index":0,"page_count":1,"snippet":"x \\"q\\"","rank":-0.0000015,"search_source":"fts"}', '{"path":"/b.pdf","page_index":2,"page_count":3,"snippet":"","rank":0,"search_source":"path"}']
    assert list(sinks.found_text(df)) == ["/a<b>.pdf", "/b.pdf (page 3)", "2 result(s) found."]
    assert list(sinks.found_text(df.limit(0))) == ["No results found."]
    assert [sinks.number(x) for x in (1.1e-7, 1e21, -0.25, 100.0)] == ["1.1e-07", "1e+21", "-0.25", "100"]
    assert sinks.progress_line(1, 2, "OK", "a") == "[1/2] OK: a"


def test_lines(spark):
    """Lines as columns: times with and without a fraction, nulls, and a page of results with its snippets."""
    from datetime import datetime, timezone

    at = datetime(2025, 1, 2, 3, 4, 5, 120000, tzinfo=timezone.utc)
    docs = spark.createDataFrame([("/a.pdf", at, at.replace(microsecond=0), None, True, False)], "path string, created_at timestamp, modified_at timestamp, page_count int, ocr_pending boolean, deleted boolean")
    assert list(sinks.document_json(docs)) == ['{"path":"/a.pdf","created_at":"2025-01-02T03:04:05.12Z","modified_at":"2025-01-02T03:04:05Z","page_count":null,"ocr_pending":true,"deleted":false}']
    assert list(sinks.documents_text(docs.fillna(3)))[0] == "2025-01-02T03:04:05.12Z  /a.pdf  (3 pages)"
    assert list(sinks.document_text(docs))[1:5] == ["created_at: 2025-01-02T03:04:05.12Z", "modified_at: 2025-01-02T03:04:05Z", "page_count: None", "ocr_pending: true"]
    found = spark.createDataFrame([("/b.pdf", 2, 3, "x >>>y<<<\nz", -1.0, "fts"), ("/c.pdf", 0, 1, "", 0.0, "path")], FOUND)
    assert [r.line for r in sinks.found_lines(found, verbose=True).collect()] == ["/b.pdf (page 3)\n    x y\n    z\n", "/c.pdf\n"]
    assert [r.line for r in sinks.found_lines(found).collect()] == ["/b.pdf (page 3)", "/c.pdf"]


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none")) == config.Config()
    (tmp_path / "c.yaml").write_text("paths:\n  - /a\n  - '/b'\ndatabase_path: /db\n")
    cfg = config.load(str(tmp_path / "c.yaml"))
    assert cfg == config.Config(("/a", "/b"), "/db") and config.database_path(None, cfg) == "/db" and config.database_path("/x", cfg) == "/x"
    with pytest.raises(ValueError):
        config.database_path(" ", cfg)


def test_cli(spark, tree, tmp_path, capsys):
    db = ["--database", str(tmp_path / "db"), "--config", str(tmp_path / "none")]
    run = lambda *a, ask=input: (cli.main([*db, *a], spark, ask), capsys.readouterr())
    assert run("sweep", str(tree / "images"))[0] == 0
    assert "1 unchanged" in run("sweep", str(tree / "images"))[1].out
    code, out = run("doc", "list", "--json")
    (row,) = [json.loads(x) for x in out.out.splitlines()]
    assert row["path"].endswith("f.png") and row["ocr_pending"] is True
    assert "$0.01" in run("cost")[1].out or "$0.00" in run("cost")[1].out
    code, out = run("find", "f.png", "--json")
    assert json.loads(out.out)["search_source"] == "path"
    assert run("find")[0] == 1 and run("read", "--path", "/none")[0] == 1 and run("doc", "get", "--path", "/none")[0] == 1
    assert "Nothing" in run("sweep", "--redo", str(tree / "images"), ask=lambda _: "n")[1].out
    (tree / "images/two.pdf").write_bytes(pdf([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Count 2 >>")]))
    assert "1 new" in run("sweep", str(tree / "images"))[1].out
    assert {json.loads(x)["path"][-7:]: json.loads(x)["page_count"] for x in run("doc", "list", "--json")[1].out.splitlines()} == {"two.pdf": 2, "s/f.png": 1}
    assert run("ocr")[0] == 1
    assert "2 succeeded, 0 failed" in run("ocr", "--provider", "leafquarry.queries:FakeProvider")[1].out
    found = [json.loads(x) for x in run("find", "images", "two", "--json")[1].out.splitlines()]
    assert [(f["search_source"], f["page_index"], f["page_count"]) for f in found] == [("fts", 0, 2)]
    rows = [json.loads(x) for x in run("sql", "SELECT f.path, d.page_count FROM find('Two, images', 'and') f JOIN documents d USING (path)")[1].out.splitlines()]
    assert [(r["path"][-7:], r["page_count"]) for r in rows] == [("two.pdf", 2)]
    assert run("read", "--path", str(tree / "images/two.pdf"), "--page", "0")[1].out.startswith("--- page 1 ---")
    os.remove(tree / "images/f.png")
    assert "1 deleted" in run("sweep", str(tree / "images"))[1].out


def test_stream(spark, tmp_path, tree):
    from leafquarry.state import Store
    from leafquarry.streaming.follow import follow

    rows = files.measured(files.scan(spark, [str(tree / "images")]))
    rows.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "db"))
    q = follow(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert store.load().documents.count() == 1
    version = store.state["version"]
    follow(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp2")).awaitTermination(120)
    assert store.state["version"] == version  # the same files again: nothing is written
