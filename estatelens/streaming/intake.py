"""Restartable intake of export files (ST1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from estatelens.operators.correlate import correlate

#: Keys seen so far live in RocksDB, on disk and not in the heap, and a batch checkpoints its changes alone.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stream_intake(spark: SparkSession, landing_dir: str, target: str, checkpoint: str, schema: StructType | str, objects: Callable[[], DataFrame], keys: tuple[str, ...] = ("dataset_id", "record_fingerprint"), fmt: str = "json") -> None:
    """Take in the files that have come to landing_dir since the last call, then return.

    Records are appended to `target`/records by key, once each, and the new ones' correlations to `target`/correlations.
    Keys that were seen are the stream's state, dealt over its partitions by key: what a batch costs follows the batch, not
    what came before, and a late duplicate finds its key there. A batch writes its own folder (batch_id=n) and replaces it if
    it runs again, with the state of the batch before it, so a restart neither loses nor repeats rows. target and checkpoint
    belong together. An empty landing folder adds nothing; null keys are keys.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        records = f"{target}/records/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(records)
        written = batch.sparkSession.read.schema(batch.schema).parquet(records)
        correlate(written, objects()).write.mode("overwrite").parquet(f"{target}/correlations/batch_id={batch_id}")

    with _settings(spark, STATE):
        fresh = spark.readStream.schema(schema).format(fmt).load(landing_dir).dropDuplicates(list(keys))
        query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
