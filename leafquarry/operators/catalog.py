"""Catalogue operators: pure functions from frames to frames over contents, documents and pages."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import within
from ..functions.text import normalize

PAGE_PRICE = 0.005


def block_of(content_id: Column, block: int) -> Column:
    """The folder of a content's rows, where each `block` of ids have one."""
    return F.call_function("div", content_id, F.lit(block)).cast("int")


@dataclass(frozen=True)
class Dealt:
    """Contents and pages as they lie in folders by `block`, a column of theirs: rows that are joined to a few others by it
    too are read from those folders alone, which Spark finds out while it runs."""

    block: int
    contents: DataFrame
    pages: DataFrame


@dataclass(frozen=True)
class Catalog:
    contents: DataFrame
    documents: DataFrame
    pages: DataFrame
    dealt: Dealt | None = None

    # ---- projections, lookups and listings
    def documents_view(self) -> DataFrame:
        """Documents with their content's columns: the nine columns that every lookup and listing returns."""
        c = self.contents.select(F.col("id").alias("content_id"), "checksum", "page_count", "ocr_pending")
        out = self.documents.join(c, "content_id")
        return out.select("id", "path", "content_id", "checksum", "created_at", "modified_at", "page_count", "ocr_pending", "deleted")

    def live(self) -> DataFrame:
        return self.documents_view().where(~F.col("deleted"))

    def by_path(self, path: str) -> DataFrame:
        """One document by its exact path, deleted ones too."""
        if self.dealt is None:
            return self.documents_view().where(F.col("path") == path).limit(1)
        doc = self.documents.where(F.col("path") == path).withColumn("block", block_of(F.col("content_id"), self.dealt.block))
        c = self.dealt.contents.select(F.col("id").alias("content_id"), "block", "checksum", "page_count", "ocr_pending")
        out = c.join(F.broadcast(doc), ["content_id", "block"])  # paths are unique: one row
        return out.select("id", "path", "content_id", "checksum", "created_at", "modified_at", "page_count", "ocr_pending", "deleted").limit(1)

    def by_checksum(self, checksum: str) -> DataFrame:
        return self.contents.where(F.col("checksum") == checksum).limit(1)

    def all_documents(self) -> DataFrame:
        return self.live().orderBy("id")

    def pending_documents(self) -> DataFrame:
        return self.live().where("ocr_pending").orderBy("id")

    def list(self, after: datetime | None = None, before: datetime | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
        """Live documents, newest first, in a half-open time range; limit 0 is no limit."""
        out = self.live()
        if after is not None:
            out = out.where(F.col("created_at") >= F.lit(after))
        if before is not None:
            out = out.where(F.col("created_at") < F.lit(before))
        out = out.orderBy(F.desc("created_at"), "id")
        out = out.offset(offset) if offset > 0 else out
        return out.limit(limit) if limit > 0 else out

    def read(self, path: str, pages: tuple[int, int] | None = None) -> DataFrame:
        """(page_index, markdown) of a live path, in order; all pages or an inclusive range."""
        doc = self.documents.where((F.col("path") == path) & ~F.col("deleted")).select("content_id")
        if self.dealt is None:
            found = self.pages.join(F.broadcast(doc), "content_id")  # paths are unique: one row
        else:
            found = self.dealt.pages.join(F.broadcast(doc.withColumn("block", block_of(F.col("content_id"), self.dealt.block))), ["content_id", "block"])
        if pages is not None:
            found = found.where(F.col("page_index").between(*pages))
        return found.select("page_index", "markdown").orderBy("page_index")

    def page(self, path: str, index: int) -> str:
        """One page's text; LookupError without it."""
        got = self.read(path, (index, index)).take(1)
        if not got:
            raise LookupError(f"no page {index} of {path}")
        return got[0].markdown

    # ---- contents and their documents
    def _live_content_ids(self) -> DataFrame:
        return self.documents.where(~F.col("deleted")).select(F.col("content_id").alias("id"))

    def pending_contents(self) -> DataFrame:
        """Pending contents that a live document has."""
        return self.contents.where("ocr_pending").join(self._live_content_ids(), "id", "left_semi").orderBy("id")

    def orphans(self) -> DataFrame:
        """Contents that no live document has."""
        return self.contents.join(self._live_content_ids(), "id", "left_anti")

    def representative_paths(self) -> DataFrame:
        """(content_id, path): the path of each content's first live document."""
        return self.documents.where(~F.col("deleted")).groupBy("content_id").agg(F.min_by("path", "id").alias("path"))

    def live_contents(self) -> DataFrame:
        """Each content of a live document once, in order of its first one."""
        held = self.documents.where(~F.col("deleted")).select(F.col("id").alias("first"), F.col("content_id").alias("id"))
        first = held.groupBy("id").agg(F.min("first").alias("first"))
        return self.contents.join(first, "id").orderBy("first").drop("first")

    # ---- statistics
    def stats(self) -> DataFrame:
        """(documents, pages) of live documents; a shared content counts for each."""
        return self.live().agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"))

    def pending_stats(self) -> DataFrame:
        """(contents, pages) that wait for OCR; each content counts once."""
        waiting = self.contents.where("ocr_pending").join(self._live_content_ids(), "id", "left_semi")
        return waiting.agg(F.count(F.lit(1)).alias("contents"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"))

    def cost(self, redo: bool = False, price: float = PAGE_PRICE) -> DataFrame:
        """(items, pages, dollars) of the pending contents, or of all documents for a redo."""
        s = self.stats().withColumnRenamed("documents", "items") if redo else self.pending_stats().withColumnRenamed("contents", "items")
        return s.select("items", "pages", F.round(F.col("pages") * price, 2).alias("dollars"))

    # ---- transitions
    def insert_content(self, checksum: str, page_count: int, id: int) -> Catalog:
        if self.by_checksum(checksum).take(1):
            raise ValueError(f"content {checksum} is there already")
        new = self.contents.sparkSession.createDataFrame([(id, checksum, page_count, True)], self.contents.schema)
        return replace(self, contents=self.contents.unionByName(new))

    def mark_done(self, ids: list[int]) -> Catalog:
        done = F.col("id").isin(ids)
        return replace(self, contents=self.contents.withColumn("ocr_pending", F.when(done, F.lit(False)).otherwise(F.col("ocr_pending"))))

    def insert_document(self, id: int, path: str, content_id: int, modified_at: datetime, modified_ns: int) -> Catalog:
        new = self.documents.sparkSession.createDataFrame([(id, path, content_id, modified_at, modified_at, modified_ns, False)], self.documents.schema)
        return replace(self, documents=self.documents.unionByName(new))

    def update_documents(self, changes: DataFrame, restore: bool = False) -> Catalog:
        """changes(id, content_id, modified_at, modified_ns); created_at stays, restore also clears deleted."""
        new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in ("content_id", "modified_at", "modified_ns")])
        joined = self.documents.join(new, "id", "left")
        hit = F.col("__modified_at").isNotNull()
        cols = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("content_id", "modified_at", "modified_ns")}
        if restore:
            cols["deleted"] = F.when(hit, F.lit(False)).otherwise(F.col("deleted"))
        return replace(self, documents=joined.withColumns(cols).select(*self.documents.columns))

    def missing(self, seen: DataFrame, roots: list[str]) -> DataFrame:
        """Live documents in the roots whose path was not seen."""
        return self.documents.where(~F.col("deleted") & within(F.col("path"), roots)).join(seen.select("path"), "path", "left_anti")

    def soft_delete_missing(self, seen: DataFrame, roots: list[str]) -> Catalog:
        gone = self.missing(seen, roots).select("id", F.lit(True).alias("__gone"))
        out = self.documents.join(gone, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False)))
        return replace(self, documents=out.select(*self.documents.columns))

    def drop_orphans(self) -> Catalog:
        """Without contents that no live document has, their deleted documents and their pages."""
        keep = self.contents.join(self._live_content_ids(), "id", "left_semi")
        ids = keep.select(F.col("id").alias("content_id"))
        held = self.documents.join(ids, "content_id", "left_semi").select(*self.documents.columns)
        return Catalog(keep, held, self.pages.join(ids, "content_id", "left_semi").select(*self.pages.columns))

    def reset(self) -> Catalog:
        return Catalog(self.contents.limit(0), self.documents.limit(0), self.pages.limit(0))

    def upsert_pages(self, new: DataFrame, first_id: int | None = None) -> Catalog:
        """new(content_id, page_index, markdown) replaces or joins the pages; ids of replaced pages stay, others follow from
        first_id on, by default from the largest. Of rows with one key the last counts, by a column `place` if new has one,
        else by the text."""
        last = F.max_by("markdown", "place" if "place" in new.columns else "markdown")
        new = new.groupBy("content_id", "page_index").agg(last.alias("markdown"))
        old = self.pages.select("content_id", "page_index", F.col("id").alias("__id"))
        named = new.join(old, ["content_id", "page_index"], "left")
        if first_id is None:
            named = named.crossJoin(F.broadcast(self.pages.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("__first"))))
        fresh = named.where("__id is null")
        fresh = with_ids(fresh, ["content_id", "page_index"], F.col("__first") if first_id is None else F.lit(first_id))
        same = named.where("__id is not null").withColumn("id", F.col("__id"))
        rows = fresh.unionByName(same).select("id", "content_id", "page_index", "markdown", normalize("markdown").alias("search_text"))
        rest = self.pages.join(new.select("content_id", "page_index"), ["content_id", "page_index"], "left_anti")
        return replace(self, pages=rest.select(*self.pages.columns).unionByName(rows.select(*self.pages.columns)))

    def delete_pages(self, content_id: int) -> Catalog:
        return replace(self, pages=self.pages.where(F.col("content_id") != content_id))

    def replace_pages(self, results: DataFrame, first_id: int | None = None) -> Catalog:
        """results(content_id, pages array of (page_index, markdown)): upsert all, drop indexes from the number of pages on,
        and mark the contents done."""
        new = results.select("content_id", F.posexplode("pages").alias("place", "p")).select("content_id", "place", F.col("p.page_index").cast("int").alias("page_index"), F.col("p.markdown").alias("markdown"))
        size = results.select("content_id", F.size("pages").alias("__size"))
        out = self.upsert_pages(new, first_id)
        pages = out.pages.join(size, "content_id", "left").where(F.col("__size").isNull() | (F.col("page_index") < F.col("__size")))
        done = results.select(F.col("content_id").alias("id"), F.lit(True).alias("__done"))
        contents = self.contents.join(done, "id", "left").withColumn("ocr_pending", F.col("ocr_pending") & F.col("__done").isNull())
        return Catalog(contents.select(*self.contents.columns), self.documents, pages.select(*self.pages.columns))


def with_ids(rows: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """rows with `id`: consecutive from first on, the same whenever the plan runs. Rows are dealt into 256 groups by hash
    and numbered within; only the groups' sizes meet in one place."""
    held = rows.withColumn("__group", F.pmod(F.xxhash64(*keys), F.lit(256)).cast("int"))
    sizes = held.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__group", (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy(*keys))
    out = held.withColumn("__place", place).join(F.broadcast(before), "__group")  # 256 rows at most
    return out.withColumn("id", (first + F.col("__before") + F.col("__place") - 1).cast("long")).drop("__group", "__before", "__place")


def deduplicated_contents(files: DataFrame) -> DataFrame:
    """(checksum, page_count, first_path, paths) of files(path, checksum, page_count): the first path's page count stays."""
    first = F.min_by("page_count", "path").alias("page_count")
    return files.groupBy("checksum").agg(first, F.min("path").alias("first_path"), F.count(F.lit(1)).alias("paths"))
