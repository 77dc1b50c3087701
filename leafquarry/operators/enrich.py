"""Enrichment: run an OCR provider over contents and put its pages into the catalogue."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_type
from ..schema import OCR_RESULT
from ..shipping import ship_package
from .catalog import Catalog


class Provider(Protocol):
    """What turns a file into pages; it is called on the executors."""

    price_per_page: float

    def ocr_file(self, path: str, content_type: str) -> list[tuple[int, str]]:
        """(page index, markdown) of each page."""


def jobs(catalog: Catalog, redo: bool = False) -> DataFrame:
    """(content_id, path, content_type): pending contents, or all live ones, by their first live path."""
    contents = catalog.live_contents() if redo else catalog.pending_contents()
    paths = catalog.representative_paths()
    return contents.select(F.col("id").alias("content_id")).join(paths, "content_id").withColumn("content_type", content_type(F.col("path")))


def run_ocr(work: DataFrame, make_provider: Callable[[], Provider], workers: int = 4) -> DataFrame:
    """ocr() in `workers` tasks."""
    return ocr(work.repartition(workers), make_provider)


def ocr(work: DataFrame, make_provider: Callable[[], Provider]) -> DataFrame:
    """(content_id, path, status, error, pages): OK, FAIL or SKIP (no supported type). One failure stops nothing else."""
    ship_package(work.sparkSession)

    def run(batches):
        import pandas as pd

        provider = make_provider()
        for b in batches:
            rows = []
            for r in b.itertuples():
                if not r.content_type:
                    rows.append((r.content_id, r.path, "SKIP", "unsupported file type", []))
                    continue
                try:
                    pages = [{"page_index": int(i), "markdown": m} for i, m in provider.ocr_file(r.path, r.content_type)]
                    rows.append((r.content_id, r.path, "OK", None, pages))
                except Exception as e:  # noqa: BLE001  the job's failure is its result
                    rows.append((r.content_id, r.path, "FAIL", str(e)[:200], []))
            yield pd.DataFrame(rows, columns=OCR_RESULT.names)

    return work.mapInPandas(run, OCR_RESULT)


def in_waves(work: DataFrame, folder: str, make_provider: Callable[[], Provider], keep: Callable[[DataFrame], object], tell: Callable[[str], None], stop: threading.Event, workers: int = 4, every: float = 20.0) -> DataFrame:
    """The results of all jobs that ended before `stop` was set. work(n, content_id, path, content_type) numbers them from 0.

    A wave runs `workers` files, one to a task, and each task's result is put in its folder when the task ends, whatever
    becomes of the wave (Spark's second commit algorithm). keep() gets what has come since it was last called: every so many
    seconds, at the end and on a stop, which cancels the tasks under way. So a stopped run has lost those calls alone, and
    contents that were kept are no longer pending for the next. tell() gets a line while files are read, and one of each."""
    spark, total = work.sparkSession, work.count()
    spark.createDataFrame([], OCR_RESULT).write.parquet(f"{folder}/none")
    done, fresh, kept, failed = 0, [], time.monotonic(), []

    def wave(first: int, group: str) -> None:
        spark.sparkContext.setJobGroup(group, "ocr", True)
        part = work.where(F.col("n").between(first, first + workers - 1)).repartitionByRange(workers, "n")
        try:
            ocr(part, make_provider).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{folder}/{first}")
        except Exception as e:  # noqa: BLE001  told apart below: a stop, or a fault of the whole wave
            failed.append(e)

    for first in range(0, total, workers):
        group = f"ocr-{uuid.uuid4().hex}"
        runner = threading.Thread(target=inheritable_thread_target(lambda f=first, g=group: wave(f, g)), daemon=True)
        runner.start()
        seen = -1
        while runner.is_alive():
            if stop.wait(0.05):
                spark.sparkContext.cancelJobGroup(group)
                runner.join(0.2)
                continue
            if (ended := _ended(spark, group)) != seen:
                seen = ended
                tell(f"{min(done + seen, total)}/{total} files read")
        found = _parts(spark, folder, [first])
        for r in found.select("path", "status", "error", F.size("pages").alias("pages")).toLocalIterator():
            done += 1
            tell(f"[{done}/{total}] {r.status}: {r.path.rsplit('/', 1)[-1]} ({r.error or f'{r.pages} pages'})")
        fresh.append(first)
        over = stop.is_set() or bool(failed) or first + workers >= total
        if over or time.monotonic() - kept >= every:
            keep(_parts(spark, folder, fresh))
            fresh, kept = [], time.monotonic()
        if over:
            break
    if failed and not stop.is_set():
        raise failed[0]
    return _parts(spark, folder, ["*"])


def _parts(spark, folder: str, waves: list) -> DataFrame:
    """The results of some waves; one that was stopped at once has left no folder."""
    return spark.read.schema(OCR_RESULT).parquet(folder + "/{none," + ",".join(map(str, waves)) + "}")


def _ended(spark, group: str) -> int:
    """Tasks of a job group that have ended in its widest stage."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
    return max((s.numCompletedTasks for s in stages if s), default=0)


def progress(results: DataFrame, total: int, elapsed: float) -> DataFrame:
    """One row: succeeded, failed, skipped, percent, eta in seconds (null before the first result)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = results.agg(n("OK").alias("succeeded"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"))
    done = F.col("succeeded") + F.col("failed")
    left = F.lit(total) - done - F.col("skipped")
    percent = F.when(F.lit(total) > 0, 100.0 * (done + F.col("skipped")) / total).otherwise(100.0)
    return out.withColumn("percent", percent).withColumn("eta", F.when(done > 0, F.lit(elapsed) / done * left))


def retrying(call: Callable[[], object], retryable: Callable[[Exception], float | None], attempts: int = 5, cap: float = 60.0, jitter: Callable[[], float] | None = None, sleep: Callable[[float], None] = time.sleep):
    """call(), up to `attempts` times. retryable gives None to give up, 0 for the usual back-off, or seconds to wait.

    The usual wait doubles from one second; every wait is jittered by 0.5 to 1.5 and capped."""
    import random

    shake = jitter or random.random
    wait = 1.0
    for k in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            after = retryable(e)
            if after is None or k + 1 == attempts:
                raise
            sleep(min((after or wait) * (0.5 + shake()), cap))
            wait = min(wait * 2, cap)
    return None
