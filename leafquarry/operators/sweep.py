"""Sweep: bring the catalogue in step with a scan of the files, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import within
from .catalog import Catalog, with_ids


@dataclass(frozen=True)
class Ids:
    """The next free ids; they only grow, so an id is never used twice."""

    contents: int = 1
    documents: int = 1
    pages: int = 1


def decide(catalog: Catalog, scan: DataFrame, roots: list[str]) -> DataFrame:
    """One row for each path on either side, with its action:

    failed (seen, unreadable), new, restored, updated (other bytes), touched (other time only), unchanged, deleted (live,
    in the roots, not seen), absent (anything else that was not seen)."""
    old = catalog.documents.join(catalog.contents.select(F.col("id").alias("content_id"), F.col("checksum").alias("old_checksum"), F.col("ocr_pending").alias("old_pending")), "content_id", "left")
    old = old.select("path", F.col("id").alias("document_id"), "old_checksum", "old_pending", F.col("modified_ns").alias("old_ns"), F.col("deleted").alias("was_deleted"))
    seen = scan.groupBy("path").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("mtime_ns", "checksum", "page_count", "error")], F.count(F.lit(1)).alias("times"))
    both = seen.join(old, "path", "full_outer")
    other_bytes, other_time = F.col("checksum") != F.col("old_checksum"), F.col("mtime_ns") != F.col("old_ns")
    gone = ~F.col("was_deleted") & within(F.col("path"), roots)
    action = (
        F.when(F.col("times").isNull(), F.when(gone, "deleted").otherwise("absent"))
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("document_id").isNull(), "new")
        .when(F.col("was_deleted"), "restored")
        .when(other_bytes, "updated")
        .when(other_time, "touched")
        .otherwise("unchanged")
    )
    pending = F.col("document_id").isNull() | F.col("old_pending") | (other_bytes & other_time)
    return both.withColumn("action", action).withColumn("wants_ocr", pending)


def counters(decided: DataFrame, excluded: int = 0) -> DataFrame:
    """One row: scanned (excluded files too), new, updated, restored, deleted, unchanged (touched files too), failed."""
    n = lambda *names: F.count(F.when(F.col("action").isin(*names), 1))
    again = F.coalesce(F.sum(F.col("times") - 1), F.lit(0))  # a file reached through two paths is unchanged the second time
    return decided.agg(
        (F.coalesce(F.sum("times"), F.lit(0)) + excluded).alias("scanned"),
        n("new").alias("new"),
        n("updated").alias("updated"),
        n("restored").alias("restored"),
        n("deleted").alias("deleted"),
        (n("unchanged", "touched") + again).alias("unchanged"),
        n("failed").alias("failed"),
    )


def apply(catalog: Catalog, decided: DataFrame, ids: Ids) -> Catalog:
    """The catalogue after the sweep, orphans dropped. New contents take the flag of their first path."""
    readable = decided.where(F.col("action").isin("new", "restored", "updated", "touched", "unchanged"))
    fresh = readable.join(catalog.contents.select("checksum"), "checksum", "left_anti")
    fresh = fresh.groupBy("checksum").agg(F.min_by(F.struct("page_count", "wants_ocr"), "path").alias("f"))
    fresh = fresh.select("checksum", "f.page_count", F.col("f.wants_ocr").alias("ocr_pending"))
    fresh = with_ids(fresh, ["checksum"], F.lit(ids.contents))
    contents = catalog.contents.unionByName(fresh.select(*catalog.contents.columns))
    known = contents.select("checksum", F.col("id").alias("new_content"))
    placed = readable.join(known, "checksum").withColumn("mtime", F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000).cast("long")))

    added = placed.where("action = 'new'")
    added = with_ids(added, ["path"], F.lit(ids.documents))
    added = added.select("id", "path", F.col("new_content").alias("content_id"), F.col("mtime").alias("created_at"), F.col("mtime").alias("modified_at"), F.col("mtime_ns").alias("modified_ns"), F.lit(False).alias("deleted"))
    moved = placed.where("action in ('restored', 'updated', 'touched')").select(F.col("document_id").alias("id"), "new_content", "mtime", F.col("mtime_ns").alias("new_ns"))
    gone = decided.where("action = 'deleted'").select(F.col("document_id").alias("id"), F.lit(True).alias("gone"))
    docs = catalog.documents.join(moved, "id", "left").join(gone, "id", "left")
    docs = docs.select(
        "id",
        "path",
        F.coalesce("new_content", "content_id").alias("content_id"),
        "created_at",
        F.coalesce("mtime", "modified_at").alias("modified_at"),
        F.coalesce("new_ns", "modified_ns").alias("modified_ns"),
        F.when(F.col("gone"), True).when(F.col("new_content").isNotNull(), False).otherwise(F.col("deleted")).alias("deleted"),
    )
    return Catalog(contents, docs.unionByName(added), catalog.pages).drop_orphans()
