"""Safe resending over a stream of rows: each micro-batch sends only keys that history lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bandwright.operators.burst import pending


def deliver(rows: DataFrame, key: str, history: str, checkpoint: str, send: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Sends each new key once. ``send`` returns (key, delivered); history is a Parquet table that grows by batch.

    A batch that runs again after a failure finds its delivered keys in history.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        keys = df.select(key).distinct()
        try:
            known = spark.read.parquet(history)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], keys.schema.add("delivered", "boolean"))
        send(pending(keys, known, key)).write.mode("append").parquet(history)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
