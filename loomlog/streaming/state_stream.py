"""The log as a stream: exactly-once writes with keyed state, and last values in micro-batches.

Rows of a key may share a micro-batch in any order; over micro-batches idx must not fall for a key, which a log in order gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "shard int, client_id long, idx long, seq long, op string, key string, val string, accepted boolean"


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("idx")
    flags = []
    for seq in rows["seq"].tolist():
        flags.append(seq > last)
        last = max(last, seq)
    state.update((last,))
    yield rows.assign(accepted=flags)[["shard", "client_id", "idx", "seq", "op", "key", "val", "accepted"]]


def accepted_stream(writes: DataFrame) -> DataFrame:
    """A streaming DataFrame of writes with the flag accepted; the state is the last number of each client in a shard."""
    cols = writes.select("shard", "client_id", "idx", "seq", "op", "key", "val")
    return cols.groupBy("shard", "client_id").applyInPandasWithState(_accept, OUT, "last long", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files: int = 1) -> None:
    """Takes all that is in source, a few files a micro-batch, and ends; a later call goes on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).where(F.col("op") != "GET")
    query = accepted_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
