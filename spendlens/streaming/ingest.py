"""Incremental folder ingest.

``readStream.format("binaryFile")`` picks up new statement files; each
micro-batch runs the batch import plan (``plans.importer.import_files``).
The ledger anti-join (J1) makes a replayed batch idempotent: files already in
the ledger are rejected as duplicates instead of being imported twice.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from spendlens.plans.importer import Store, import_files
from spendlens.plans.scan import Score, import_and_scan
from spendlens.sources.snapshot import SnapshotStore

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def start_folder_ingest(spark: SparkSession, folder: str, store: Store | SnapshotStore, checkpoint: str,
                        model=None, default_user: str | None = None,
                        partition_schema: str = "", available_now: bool = True,
                        score: Score | None = None) -> StreamingQuery:
    """Import new files batch by batch; into a snapshot store with a ``score``,
    the users of each batch are scanned again."""
    schema = FILE_SCHEMA + (", " + partition_schema if partition_schema else "")
    stream = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def each_batch(batch, epoch_id):
        if isinstance(store, SnapshotStore):
            import_and_scan(batch.sparkSession, batch, store, model, default_user, score)
        else:
            import_files(batch.sparkSession, batch, store, model, default_user)

    w = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
