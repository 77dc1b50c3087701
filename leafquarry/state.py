"""The catalogue on disk: tables as segments of Parquet files, named by a log of numbered entries.

A commit writes what it adds as new segments, what it takes away as (segment, key) pairs, and one log entry that names all
segments and pairs that count from now on. An entry is created only if no other has its number; whoever comes second starts
again from what the first left. So writers never lose each other's changes, readers see whole snapshots only, and a commit
writes in proportion to its change. Segments of like size are merged when there are MERGE of them, and those that have lost
a quarter of their rows are written anew.

The pages' posting tables (see operators/postings.py) grow by the same segments, and their statistics by addition: an entry
holds the number of pages and tokens, less those that were taken away.

Layout below the store's folder: log/<number>.json; <table>/seg=<id>/ (contents and pages with a folder for each `block` of
content ids, documents sorted by path); word/ and trigram/seg=<id>/; dead/<id>; ranges/<table>-<id>.json, the files of a
sorted segment with their first and last values. The folder may lie on any file system that Spark reads; what Spark reads
there and what the driver reads there go through the same Hadoop client, so a path means one place.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize
from .operators import postings
from .operators.catalog import Catalog, Dealt, block_of
from .operators.postings import INDEXES, POSTING, File, Indexes, Postings
from .operators.sweep import Ids
from .schema import TABLES, VERSION

KEYS = {"contents": "id", "documents": "id", "pages": "content_id"}
#: Segments of like size that are merged, entries of the log that stay for readers, and tries of a commit.
MERGE, KEEP, TRIES = 8, 3, 30
#: Bytes of rows that one task sorts, and of a posting for each token of a text.
PART, POSTING_BYTES = 64 << 20, {"word": 64, "trigram": 48}


class Conflict(RuntimeError):
    """Other writers came first, time and again."""


class Folder:
    """The driver's small files in a folder, through Spark's own Hadoop client."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(self._conf)
        if self._fs.getScheme() == "file":  # without checksum files, which an edit by hand would leave behind
            self._fs = self._fs.getRawFileSystem()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._at, name) if name else self._at

    def is_file(self) -> bool:
        return self._fs.exists(self._at) and self._fs.getFileStatus(self._at).isFile()

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """The whole file, unless there is one of that name: then False, and it stays as it is. Of several writers one gets
        True: a link is made, or a rename done that replaces nothing, both one step on local disks and on HDFS."""
        beside = f"{name}.{uuid.uuid4().hex}"
        self.write(beside, text)
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(self._path(beside).toUri().getPath(), self._path(name).toUri().getPath())
            else:
                none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(self._fs.makeQualified(self._path(beside)), self._fs.makeQualified(self._path(name)), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.remove(beside)

    def names(self, name: str) -> list[str]:
        if not self._fs.exists(self._path(name)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name)))

    def bytes(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self._fs.exists(self._path(name)) else 0

    def changed(self, name: str) -> tuple[int, int]:
        """(bytes, last change) of a file, or of the files of a folder."""
        found = [x for x in self._fs.listStatus(self._path(name)) if x.isFile()]
        return sum(x.getLen() for x in found), max((x.getModificationTime() for x in found), default=0)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Delta:
    """Keys whose present rows go (their column is the table's key), and rows that come."""

    killed: DataFrame | None = None
    added: DataFrame | None = None


@dataclass(frozen=True)
class Change:
    """What a commit does to each table; a table that is None stays as it is. whole: nothing that was there stays."""

    contents: Delta | None = None
    documents: Delta | None = None
    pages: Delta | None = None
    whole: bool = False


class Store:
    def __init__(self, spark: SparkSession, path: str, block: int | None = None, indexes: tuple[str, ...] = INDEXES):
        """For a store that is new, or opened in an older layout: block, content ids that share a folder, by default from its
        first rows; indexes, the posting tables that its commits keep."""
        if not path.strip():
            raise ValueError("database path is empty")
        self.spark, self.path, self.folder, self.token = spark, path.rstrip("/"), Folder(spark, path), uuid.uuid4().hex[:12]
        if self.folder.is_file():
            raise ValueError(f"database path {path} is a file")
        self.folder.make()
        self._ranges = lru_cache(4096)(lambda name: tuple(map(tuple, json.loads(self.folder.read(f"ranges/{name}.json") or "[]"))))
        self._common = lru_cache(1024)(lambda name: json.loads(self.folder.read(f"ranges/common-{name}.json") or "{}"))
        empty = {n: {"segments": [], "dead": []} for n in TABLES}
        self.state = {"schema": VERSION, "version": 0, "block": block or 0, "indexes": list(indexes), "next_id": dict.fromkeys(TABLES, 1), "tables": empty, "totals": dict.fromkeys(("pages", *INDEXES), 0)}
        if not self.refresh():
            self._migrate()

    # ---- the log
    def refresh(self) -> bool:
        """Take up the last entry; False where there is none."""
        found = [n for n in self.folder.names("log") if n.endswith(".json")]
        if not found:
            return False
        state = json.loads(self.folder.read(f"log/{found[-1]}"))
        if state["schema"] != VERSION:
            raise ValueError(f"unknown schema version {state['schema']}")
        self.state = {"indexes": list(INDEXES)} | state
        return True

    @property
    def ids(self) -> Ids:
        return Ids(**self.state["next_id"])

    # ---- reading
    def _dead(self, table: str) -> DataFrame | None:
        held = self.state["tables"][table]["dead"]
        if not held:
            return None
        return self.spark.read.schema("seg string, key long").parquet(*[f"{self.path}/dead/{d['id']}" for d in held])

    def _rows(self, table: str, segments: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
        """The rows of a table that count, with `seg`, and `block` where they are dealt by it; of some segments or files."""
        of = [s["id"] for s in self.state["tables"][table]["segments"]] if segments is None else segments
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[table]) + (", words int, grams int" if table == "pages" else "") + ("" if table == "documents" else ", block int") + ", seg string"
        at = [f"{self.path}/{table}/seg={s}" for s in of] if files is None else files
        if not at:
            return self.spark.createDataFrame([], fields)
        rows, dead = self.spark.read.schema(fields).option("basePath", f"{self.path}/{table}").parquet(*at), self._dead(table)
        if dead is not None:
            rows = rows.join(dead.withColumnRenamed("key", KEYS[table]), ["seg", KEYS[table]], "left_anti")
        return rows

    def load(self) -> Catalog:
        return self._catalog(self._rows("documents"))

    def _catalog(self, documents: DataFrame) -> Catalog:
        contents, pages = (self._rows(n).select(*TABLES[n].names, "block") for n in ("contents", "pages"))
        dealt = Dealt(self.state["block"], contents, pages) if self.state["block"] else None
        return Catalog(contents.drop("block"), documents.select(*TABLES["documents"].names), pages.drop("block"), dealt)

    def stored(self, results: DataFrame) -> Catalog:
        """Commits OCR results(content_id, status, pages): those that succeeded, of contents that are still there."""

        def change(catalog: Catalog) -> Change | None:
            good = results.where("status = 'OK'").select("content_id", "pages")
            held = catalog.contents.join(good.select(F.col("content_id").alias("id")), "id", "left_semi")
            good = self.write("good", good.join(held.select(F.col("id").alias("content_id")), "content_id", "left_semi"))
            if good.isEmpty():
                return None
            old = catalog.pages.join(good.select("content_id"), "content_id", "left_semi").select(*catalog.pages.columns)
            new = replace(catalog, contents=held, pages=old).replace_pages(good, self.ids.pages)
            return Change(contents=Delta(held.select("id"), new.contents), pages=Delta(good.select("content_id"), new.pages))

        out = self.commit(change)
        self.forget("good")
        return out

    def at_path(self, path: str) -> Catalog:
        """The catalogue with the documents of those files alone that a path falls into."""
        found = [f"{self.path}/documents/seg={s['id']}/{name}" for s in self.state["tables"]["documents"]["segments"] for name, low, high in self._ranges(f"documents-{s['id']}") if low <= path <= high]
        return self._catalog(self._rows("documents", files=found))

    def indexes(self) -> Indexes:
        """The posting tables of the pages that the store keeps."""
        segments, dead = [s["id"] for s in self.state["tables"]["pages"]["segments"]], self._dead("pages")
        dead = None if dead is None else dead.withColumnRenamed("key", "content_id")

        def one(index: str) -> Postings:
            files = tuple(File(f"{self.path}/{index}/seg={s}/{name}", low, high) for s in segments for name, low, high in self._ranges(f"{index}-{s}"))
            common: dict[str, int] = {}
            for s in segments:
                for t, n in self._common(f"{index}-{s}").items():
                    common[t] = common.get(t, 0) + n
            return Postings(index, self.spark, self.state["totals"]["pages"], self.state["totals"][index], files, f"{self.path}/{index}", dead, common)

        return Indexes(*(one(i) if i in self.state["indexes"] else None for i in INDEXES), self.state["block"])

    # ---- frames that are read several times
    def work(self, name: str) -> str:
        """A folder for this store's own use, apart from other writers'."""
        return f"{self.path}/work/{self.token}/{name}"

    def write(self, name: str, frame: DataFrame) -> DataFrame:
        """A frame written beside the tables; forget() drops it."""
        frame.write.mode("overwrite").parquet(self.work(name))
        return self.spark.read.schema(frame.schema).parquet(self.work(name))

    def forget(self, *names: str) -> None:
        for n in names:
            self.folder.remove(f"work/{self.token}/{n}")

    # ---- writing
    def commit(self, make: Callable[[Catalog], Change | None]) -> Catalog:
        """make(catalogue) says what changes; it is called again, on the newer catalogue, where another writer came first. It
        must not write anything that a second call would not replace."""
        for k in range(TRIES):
            self.refresh()
            base, version = self.load(), self.state["version"]
            try:
                change = make(base)
                if change is None:
                    return base
                done = self._try(change)
            except Exception:
                self.refresh()
                if self.state["version"] < version + KEEP:
                    raise
                continue  # so many commits came in between that what was read may be gone
            if done:
                self.forget("change-contents", "change-documents")
                self._tidy()
                self._merge()
                return self.load()
            time.sleep(random.random() * min(2.0, 0.05 * 2**k))
        raise Conflict(f"{self.path}: {TRIES} commits came too late")

    def save(self, catalog: Catalog) -> Catalog:
        """All tables as they are in catalog, whatever was there."""
        return self.commit(lambda _: Change(*(Delta(None, getattr(catalog, n)) for n in TABLES), whole=True))

    def replaced(self, old: Catalog, new: Catalog) -> Change | None:
        """The change from old to new where no page is written: rows of contents and documents that differ, and the pages of
        contents that went. The differences are written to work/, from where the commit reads them. None without any."""
        deltas = {}
        for table in ("contents", "documents"):
            names = TABLES[table].names
            was = getattr(old, table).select("id", F.struct(*names).alias("was"))
            now = getattr(new, table).select("id", F.struct(*names).alias("now"))
            other = self.write(f"change-{table}", was.join(now, "id", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))))
            deltas[table] = Delta(other.where("was is not null").select("id"), other.where("now is not null").select("now.*"))
            if table == "contents":
                gone = other.where("now is null").select(F.col("id").alias("content_id"))
            deltas = {k: v for k, v in deltas.items() if k != table or not other.isEmpty()}
        return Change(**deltas, pages=None if gone.isEmpty() else Delta(gone)) if deltas else None

    def _try(self, change: Change) -> bool:
        """One attempt: the change's files and its entry; False, and none of them, where the entry's number is taken."""
        state, made = json.loads(json.dumps(self.state)), []
        if change.whole:
            state["tables"], state["totals"] = {n: {"segments": [], "dead": []} for n in TABLES}, dict.fromkeys(state["totals"], 0)
        if not state["block"] and change.contents is not None and change.contents.added is not None:
            # a thousand folders at most of what comes first, and rows enough for a file in each
            top = change.contents.added.agg(F.max("id")).first()[0] or 0
            state["block"] = max(1024, 1 << max(0, (top // 1024).bit_length()))

        def one(table: str) -> None:
            delta = getattr(change, table)
            if delta is not None and delta.killed is not None and state["tables"][table]["segments"]:
                self._kill(table, delta.killed, state, made)
            if delta is not None and delta.added is not None:
                self._add(table, delta.added, state, made)

        try:
            side_by_side(one, TABLES)
        except Exception:
            for name in made:
                self.folder.remove(name)
            raise
        return self._enter(state, made)

    def _enter(self, state: dict, made: list[str]) -> bool:
        state["version"] = self.state["version"] + 1
        self.folder.make("log")
        if self.folder.create(f"log/{state['version']:012d}.json", json.dumps(state)):
            self.state = state
            return True
        for name in made:
            self.folder.remove(name)
        return False

    def _kill(self, table: str, killed: DataFrame, state: dict, made: list[str]) -> None:
        key, name = KEYS[table], f"dead/{uuid.uuid4().hex[:16]}"
        rows = self._rows(table).join(killed.select(key).distinct(), key, "left_semi")
        if table == "pages":
            rows = rows.groupBy("seg", key).agg(F.count(F.lit(1)).alias("pages"), F.sum("words").alias("word"), F.sum("grams").alias("trigram"))
        rows.select("seg", F.col(key).alias("key"), *(state["totals"] if table == "pages" else ())).write.parquet(f"{self.path}/{name}")
        made.append(name)
        held = self.spark.read.parquet(f"{self.path}/{name}")
        sums = held.groupBy("seg").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in held.columns[2:]]).collect()  # a row for each segment
        if not sums:
            made.remove(name)
            self.folder.remove(name)
            return
        state["tables"][table]["dead"].append({"id": name[5:], "segments": {r.seg: r["pages" if table == "pages" else "rows"] for r in sums}})
        if table == "pages":
            for c in state["totals"]:
                state["totals"][c] -= sum(r[c] for r in sums)

    def _add(self, table: str, rows: DataFrame, state: dict, made: list[str]) -> None:
        seg = uuid.uuid4().hex[:16]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table] if f.name in rows.columns or f.name != "search_text"])
        n, top, *sums = self._segment(table, seg, rows, state["block"] or 1024, made)
        if not n:
            return
        state["tables"][table]["segments"].append({"id": seg, "rows": n})
        state["next_id"][table] = max(state["next_id"][table], top + 1)
        if table == "pages":
            for c, more in zip(("pages", *INDEXES), (n, *sums), strict=True):
                state["totals"][c] += more
            held = self.spark.read.schema(TABLES["pages"]).parquet(f"{self.path}/pages/seg={seg}")
            self._both(seg, lambda index: postings.listed(held, index), n, sums, state["indexes"], made)

    def _parts(self, size: int) -> tuple[int, ...]:
        """The number of partitions for so many bytes, where the session's is too small for tasks of PART bytes."""
        n = -(-size // PART)
        return (n,) if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else ()

    def _segment(self, table: str, seg: str, rows: DataFrame, block: int, made: list[str]) -> list[int]:
        """Writes a segment; (rows, greatest id), and the pages' tokens of either index. What follows from a page's markdown
        is found when it has been dealt, so that it does not travel."""
        at, key = f"{self.path}/{table}/seg={seg}", KEYS[table]
        made.append(f"{table}/seg={seg}")
        if table == "documents":
            rows.repartitionByRange("path").sortWithinPartitions("path").write.parquet(at)
            made.append(f"ranges/documents-{seg}.json")
            self._note(f"documents-{seg}", at, "path")
        elif table == "contents":
            dealt = rows.withColumn("block", block_of(F.col(key), block)).repartitionByRange("block", key).sortWithinPartitions("block", key)
            writer = dealt.write.partitionBy("block")  # the bloom filter is for the other way in
            writer.option("parquet.bloom.filter.enabled#checksum", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(at)
        else:
            order, texts = ("block", key, "page_index"), [c for c in ("markdown", "search_text") if c in rows.columns]
            size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64)).cast("long"))).first()[0] or 0
            dealt = rows.withColumn("block", block_of(F.col(key), block)).repartitionByRange(*self._parts(size), *order).sortWithinPartitions(*order)
            if "search_text" not in rows.columns:
                dealt = dealt.withColumn("search_text", normalize(F.col("markdown")))
            if "words" not in rows.columns:
                dealt = dealt.withColumns({"words": postings.tokens_in(F.col("search_text"), "word"), "grams": postings.tokens_in(F.col("search_text"), "trigram")})
            dealt.write.partitionBy("block").parquet(at)
        sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "grams") if table == "pages"]
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[table]) + (", words int, grams int" if table == "pages" else "")
        found = list(self.spark.read.schema(fields).parquet(at).agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(0)), *sums).first())
        if not found[0]:
            self.folder.remove(f"{table}/seg={seg}")
        return found

    def _note(self, name: str, at: str, column: str) -> None:
        """Notes the files of a sorted folder with their first and last values."""
        found = self.spark.read.parquet(at).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(column).alias("low"), F.max(column).alias("high")).collect()  # a row for each file
        self.folder.make("ranges")
        self.folder.write(f"ranges/{name}.json", json.dumps(sorted((r.file, r.low, r.high) for r in found)))

    def _both(self, seg: str, rows_of: Callable[[str], DataFrame], pages: int, tokens: list[int], indexes: list[str], made: list[str]) -> None:
        """The posting tables of a segment, side by side."""
        made += [x for i in indexes for x in (f"{i}/seg={seg}", f"ranges/{i}-{seg}.json", f"ranges/common-{i}-{seg}.json")]
        many = dict(zip(INDEXES, tokens, strict=True))
        side_by_side(lambda index: self._lists(index, seg, rows_of(index), pages, many[index]), indexes)

    def _lists(self, index: str, seg: str, rows: DataFrame, pages: int, tokens: int) -> None:
        at = f"{self.path}/{index}/seg={seg}"
        postings.sorted_by_term(rows, self._parts(tokens * POSTING_BYTES[index])).write.parquet(at)
        self._note(f"{index}-{seg}", at, "term")
        often = self.spark.read.schema(POSTING).parquet(at).groupBy("term").count().where(F.col("count") * 100 >= pages).orderBy(F.desc("count"), "term").limit(postings.COMMON)
        self.folder.write(f"ranges/common-{index}-{seg}.json", json.dumps({r[0]: r[1] for r in often.collect()}))

    # ---- upkeep
    def _merge(self) -> None:
        """Merges segments of a table that are too many or too hollow, as commits of their own. Another writer's commit in
        between lets a merge fall; the next one will do it."""
        for table in TABLES:
            held = self.state["tables"][table]
            lost: dict[str, int] = {}
            for d in held["dead"]:
                for s, n in d["segments"].items():
                    lost[s] = lost.get(s, 0) + n
            classes: dict[int, list[str]] = {}
            for s in held["segments"]:
                classes.setdefault(max(s["rows"], 1).bit_length() // 3, []).append(s["id"])
            few = next((c for c in classes.values() if len(c) >= MERGE), [])
            hollow = [s["id"] for s in held["segments"] if lost.get(s["id"], 0) * 4 > s["rows"]]
            again = dict.fromkeys([*few, *hollow, *(lost if len(held["dead"]) > MERGE else ())])
            if found := [s["id"] for s in held["segments"] if s["id"] in again]:
                self._rewrite(table, found)

    def _rewrite(self, table: str, old: list[str]) -> None:
        state, made, seg = json.loads(json.dumps(self.state)), [], uuid.uuid4().hex[:16]
        held = state["tables"][table]
        n, _, *sums = self._segment(table, seg, self._rows(table, old).drop("seg", "block"), state["block"], made)
        held["segments"] = [s for s in held["segments"] if s["id"] not in old] + [{"id": seg, "rows": n}] * (n > 0)
        held["dead"] = [d for d in held["dead"] if set(d["segments"]) & {s["id"] for s in held["segments"]}]
        if table == "pages" and n:
            dead = self._dead("pages")

            def alive(index: str) -> DataFrame:
                rows = self.spark.read.schema(POSTING + ", seg string").option("basePath", f"{self.path}/{index}").parquet(*[f"{self.path}/{index}/seg={s}" for s in old])
                return (rows if dead is None else rows.join(dead.withColumnRenamed("key", "content_id"), ["seg", "content_id"], "left_anti")).drop("seg")

            self._both(seg, alive, n, sums, state["indexes"], made)
        if self._enter(state, made):
            self._tidy()

    def _tidy(self) -> None:
        """Drops entries of the log but the last KEEP, with the files that only they name: readers may still hold those."""
        found = [n for n in self.folder.names("log") if n.endswith(".json")]
        held: set[str] = set()
        for n in found[-KEEP:]:
            if text := self.folder.read(f"log/{n}"):
                held |= named(json.loads(text))
        for n in found[:-KEEP]:
            text = self.folder.read(f"log/{n}")
            for name in named(json.loads(text)) - held if text else ():
                self.folder.remove(name)
            self.folder.remove(f"log/{n}")

    def _migrate(self) -> None:
        """A folder of version 1 or 2, snapshots named by manifest.json, becomes one of segments; version 1 pages have no
        search_text."""
        text = self.folder.read("manifest.json")
        if text is None:
            return
        old = json.loads(text)
        if old["schema"] not in (1, 2):
            raise ValueError(f"unknown schema version {old['schema']}")

        def table(name: str) -> DataFrame:
            at = old["tables"].get(name)
            return self.spark.createDataFrame([], TABLES[name]) if at is None else self.spark.read.parquet(f"{self.path}/{name}/v={at}")

        catalog = Catalog(*map(table, TABLES))
        if old["schema"] == 1:  # _segment() adds it
            catalog = replace(catalog, pages=catalog.pages.select(*[n for n in TABLES["pages"].names if n != "search_text"]))
        for name, n in old["next_id"].items():
            self.state["next_id"][name] = max(self.state["next_id"][name], n)
        self.commit(lambda _: Change(*(Delta(None, getattr(catalog, n)) for n in TABLES), whole=True))
        self.folder.remove("manifest.json")
        for name in TABLES:
            for old_version in self.folder.names(name):
                if old_version.startswith("v="):
                    self.folder.remove(f"{name}/{old_version}")
        self.folder.remove("postings")


def side_by_side(what: Callable[[str], None], names: Iterable[str]) -> None:
    """what(name) of all names at once; their Spark jobs share the cluster."""
    names = list(names)
    with ThreadPoolExecutor(max(len(names), 1)) as pool:
        for done in [pool.submit(inheritable_thread_target(lambda n=n: what(n))) for n in names]:
            done.result()


def named(state: dict) -> set[str]:
    """The files and folders that an entry of the log names."""
    out = set()
    for table, held in state["tables"].items():
        out |= {f"dead/{d['id']}" for d in held["dead"]}
        for s in held["segments"]:
            out.add(f"{table}/seg={s['id']}")
            if table == "documents":
                out.add(f"ranges/documents-{s['id']}.json")
            if table == "pages":
                out |= {x for i in INDEXES for x in (f"{i}/seg={s['id']}", f"ranges/{i}-{s['id']}.json", f"ranges/common-{i}-{s['id']}.json")}
    return out
