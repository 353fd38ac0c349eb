"""Beyond the engine's own scope: an overlay that follows a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Manifest, Store
from ..operators.search import overlay


def follow(changes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of ``CORPUS`` rows into the overlay and publish a new snapshot.

    A batch that is run again after a failure gives the same overlay: rows replace those of their
    path.  Readers keep the snapshot they began with.
    """

    def merge(batch: DataFrame, _: int) -> None:
        now = store.manifest()
        new = batch.dropDuplicates(["path"])
        if now.overlay:
            old = store.read(Manifest(overlay=now.overlay))
            new = old.join(new.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)
        published = store.write(overlay(new), "overlay")
        store.publish(Manifest(committed=now.committed, overlay=published or now.overlay))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
