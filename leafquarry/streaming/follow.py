"""A sweep that goes on: scan rows that arrive as a stream are applied batch by batch to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import sweep
from ..operators.catalog import Catalog
from ..state import Change, Store


def follow(scans: DataFrame, store: Store, checkpoint: str):
    """Starts a query over a stream of scan rows. Paths that a batch does not mention stay (a batch is no full scan); a
    batch that is delivered again changes nothing, since its files are then unchanged."""

    def apply(batch: DataFrame, _: int) -> None:
        def change(catalog: Catalog) -> Change | None:
            decided = store.write("batch", sweep.decide(catalog, batch, ["/dev/null/nowhere"]))
            return store.replaced(catalog, sweep.apply(catalog, decided, store.ids))

        store.commit(change)
        store.forget("batch")

    return scans.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
