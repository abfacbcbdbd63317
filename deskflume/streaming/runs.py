"""Incremental state by Structured Streaming: tables kept up to date by micro-batches, and folds per key."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Most finds, probes and opens of one run.
CAPS = {"find": 6, "probe": 8, "open": 3}


def keep_latest(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str):
    """Starts a query that appends each micro-batch's newest row of every key; ``latest`` reads them.

    Batches are written under their id, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        newest.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, folder: str, key: str, order: str) -> DataFrame:
    rows = spark.read.parquet(folder).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def ledger(stream: DataFrame) -> DataFrame:
    """(run, action, granted) of a stream (run, action): how many of each run's actions its caps allow;
    counts only ever grow and live in the stream's state."""

    def charge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = list(state.get) if state.exists else [0] * len(CAPS)
        for rows in batches:
            for i, a in enumerate(CAPS):
                used[i] = min(CAPS[a], used[i] + int((rows["action"] == a).sum()))
        state.update(tuple(used))
        yield pd.DataFrame({"run": [key[0]] * len(CAPS), "action": list(CAPS), "granted": used})

    kinds = ", ".join(f"{a} int" for a in CAPS)
    return stream.groupBy("run").applyInPandasWithState(charge, "run long, action string, granted int", kinds, "update", GroupStateTimeout.NoTimeout)
