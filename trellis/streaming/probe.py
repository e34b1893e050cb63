"""The observation state machine over a stream of scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "model_id string, confidence double, first_scan int, last_scan int, run int"
OUT = "edge_id string, model_id string, confidence double, first_scan int, last_scan int, run int"


def step(state: tuple | None, scan: int, model_id: str | None, confidence: float) -> tuple:
    """One observation: a new edge or model starts at 1, the next scan adds 1, a later one starts again, the same scan or an earlier one changes nothing."""
    if state is None:
        return (model_id, confidence, scan, scan, 1)
    model, conf, first, last, run = state
    if scan <= last:
        return state
    if model_id != model:
        return (model_id, confidence, first, scan, 1)
    return (model, conf, first, scan, run + 1 if scan == last + 1 else 1)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["scan", "confidence"], ascending=[True, False])
    for scan, model, conf in zip(rows["scan"], rows["model_id"], rows["confidence"]):
        now = step(now, int(scan), model, float(conf))
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["edge_id", "model_id", "confidence", "first_scan", "last_scan", "run"])


def observe(stream: DataFrame) -> DataFrame:
    """State per edge, updated with each micro-batch, from a stream of (edge_id, scan, model_id, confidence).

    Scans must come in order over the micro-batches; within one they are sorted. State is one small
    tuple per edge, spread by the edge's hash, so no edge is hot: an edge has one row a scan.
    """
    rows = stream.filter(F.col("edge_id").isNotNull() & F.col("scan").isNotNull()).select("edge_id", F.col("scan").cast("int").alias("scan"), "model_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return rows.groupBy("edge_id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Fold what is there and stop; each micro-batch is written under its own number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    observe(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark, path: str) -> DataFrame:
    """The last state of each edge over all micro-batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    cols = ("model_id", "confidence", "first_scan", "last_scan", "run")
    last = rows.groupBy("edge_id").agg(F.max_by(F.struct(*cols), "batch").alias("v"))
    return last.select("edge_id", *[F.col(f"v.{c}").alias(c) for c in cols])
