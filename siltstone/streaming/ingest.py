"""Continuous loading: JSON Lines that arrive in a folder become commits of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.store import Store


def follow(store: Store, name: str, folder: str, schema: str, key: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A stream that upserts each micro-batch under one timestamp; of a key's rows in a batch one stays.

    A batch that is run again after a failure is committed once: the store keeps the number of the last
    one of each checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("record_id").orderBy(F.to_json(F.struct(*[F.col(c) for c in batch.columns])).desc())
        puts = batch.withColumn("record_id", F.col(key).cast("string")).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
        store.commit({name: (puts, None)}, (checkpoint, number))

    writer = store.spark.readStream.schema(schema).json(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
