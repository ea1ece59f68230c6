"""Clamped reaction counters, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts(events: DataFrame, order: list[str], slices: int = 64) -> DataFrame:
    """id, unified, count after all deltas; a count that falls to 0 or below starts again from 0, rows of 0 are absent.

    With the running sum S the result is S_n - min(0, min S_k). A stretch of events is known by its sum and the least running sum in it, and
    two stretches that follow each other make one. So the time between the first and the last event is cut into `slices`, each
    key's events of a slice are summed up where they are, and what is put together in order is a row a slice.
    """
    first, rest = order[0], order[1:]
    number = F.col(first).cast("timestamp").cast("double") if events.schema[first].dataType.typeName() == "timestamp_ntz" else F.col(first).cast("double")
    span = events.agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    at = F.least(F.floor((number - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9)) * slices), F.lit(slices - 1))
    rows = events.join(F.broadcast(span)).withColumn("_slice", F.coalesce(at, F.lit(0)).cast("int"))  # one row
    inside = W.partitionBy("id", "unified", "_slice").orderBy(first, *rest).rowsBetween(W.unboundedPreceding, 0)
    part = rows.withColumn("_s", F.sum("delta").over(inside)).groupBy("id", "unified", "_slice").agg(F.sum("delta").alias("total"), F.min("_s").alias("low"))
    stretches = F.array_sort(F.collect_list(F.struct("_slice", "total", "low")))  # `slices` at most
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("low"))
    both = F.aggregate(stretches, zero, lambda a, x: F.struct((a["total"] + x["total"]).alias("total"), F.least(a["low"], a["total"] + x["low"]).alias("low")))
    got = part.groupBy("id", "unified").agg(both.alias("x"))
    return got.select("id", "unified", (F.col("x.total") - F.col("x.low")).cast("long").alias("count")).where("count > 0")


def toggles(clicks: DataFrame, order: list[str]) -> DataFrame:
    """Clicks of users -> deltas: every second click of a user on an emoji takes the first back."""
    w = W.partitionBy("user", "id", "unified").orderBy(*order)
    return clicks.withColumn("delta", F.when(F.row_number().over(w) % 2 == 1, 1).otherwise(-1))


def snapshot(table: DataFrame) -> DataFrame:
    """id -> map of emoji to count."""
    return table.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unified", "count")))).alias("counts"))


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    count = state.get[0] if state.exists else 0
    rows = pd.concat(list(parts))
    rows = rows.sort_values([c for c in rows.columns if c.startswith("pos")], kind="stable")
    for d in rows["delta"]:
        count = max(0, count + int(d))
    state.update((count,))
    yield pd.DataFrame({"id": [key[0]], "unified": [key[1]], "count": [count]})


def stream_counts(stream: DataFrame) -> DataFrame:
    """Streaming rows (id, unified, delta, and pos..., columns that order a micro-batch) -> updates of the counters, one row a key and micro-batch (0: gone)."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"id {kinds['id']}, unified {kinds['unified']}, count long"
    return stream.groupBy("id", "unified").applyInPandasWithState(_fold, out, "count long", "update", "NoTimeout")


def upsert(updates: DataFrame, table: str, checkpoint: str):
    """Write the counters of each micro-batch to a table (see latest); a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The counters that stand after all micro-batches; those of 0 are gone."""
    return table.groupBy("id", "unified").agg(F.max_by("count", "batch").alias("count")).where("count > 0")


def point_read(asked: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """The map of each id that is asked for, empty where there is none."""
    found = asked.join(snapshot(table), F.col(key) == F.col("id"), "left")
    return found.select(key, F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"))
