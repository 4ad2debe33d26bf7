"""Streams: calls under a rate limit, failures with a time of grace, keyed sinks that are safe to repeat."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

from lumenfold.operators.relational import latest_wins


class Pacer(StatefulProcessor):
    """Of each key the last starts, at most as many as the limit: a call starts when it arrives or one window after the start that is so many back.

    Calls of a batch go by arrival; one that arrives late starts behind those that already have their start."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._starts = handle.getListState("starts", StructType().add("start", LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = [s[0] for s in self._starts.get()] if self._starts.exists() else []
        calls = pd.concat(list(rows)).sort_values(["arrival", "id"])
        out = []
        for arrival in calls["arrival"]:
            free = starts[-self.most] + self.window if len(starts) >= self.most else arrival
            starts.append(int(max(arrival, free, starts[-1] if starts else arrival)))
            out.append(starts[-1])
            del starts[: -self.most]
        self._starts.put([(s,) for s in starts])
        yield pd.DataFrame({"key": key[0], "id": calls["id"].to_numpy(), "arrival": calls["arrival"].to_numpy(), "start": out})

    def close(self) -> None:
        pass


def paced_stream(calls: DataFrame, most: int, window: int) -> DataFrame:
    """A stream of key, id, arrival (long): each call once, with its start. Needs the RocksDB state store."""
    kind = calls.schema["key"].dataType.simpleString()
    return calls.groupBy("key").transformWithStateInPandas(Pacer(most, window), f"key {kind}, id long, arrival long, start long", "Append", "none")


def final_failures(failures: DataFrame, successes: DataFrame, key: str, time: str, grace: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Streams of (key, time, ...): the failures that no success of their key follows within the grace, each once, when the watermark has passed it.

    A left outer join of streams; both sides' state is bounded by grace and lateness. Successes at the failure's own moment count."""
    bad = failures.withWatermark(time, late)
    good = successes.select(F.col(key).alias("_key"), F.col(time).alias("_at")).withWatermark("_at", late)
    span = F.expr(f"INTERVAL {grace}")
    joined = bad.join(good, (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col(time)) & (F.col("_at") <= F.col(time) + span), "left_outer")
    return joined.where("_key is null").drop("_key", "_at")


class KeyedSink:
    """A ``foreachBatch`` target that holds one row a key; a batch that comes again, whole or after half a write, changes nothing.

    Each batch writes folders of its own number, over whatever an earlier attempt left: its changes, reduced to the last of each key, and a ``failed`` row for each
    row that can't be written (a null key, or ``valid`` not true), with the reason. ``current`` folds what is there; ``compact`` shortens it.
    With ``absent_only`` the first row of a key stays for ever (insert if absent); otherwise the last by ``order`` wins, ties by batch."""

    def __init__(self, path: str, key: Sequence[str], order: Sequence[str], valid: Column | None = None, absent_only: bool = False):
        self.path, self.key, self.order, self.valid, self.absent_only = path.rstrip("/"), list(key), list(order), valid, absent_only

    def __call__(self, batch: DataFrame, number: int) -> None:
        no_key = F.exists(F.array(*(F.col(k).isNull() for k in self.key)), lambda x: x)
        fault = F.when(no_key, "no key")
        if self.valid is not None:
            fault = fault.when(~F.coalesce(self.valid, F.lit(False)), "not valid")
        rows = batch.withColumn("_fault", fault)
        names = [c for c in batch.columns if c not in self.key]
        good = rows.where("_fault is null")
        reduced = latest_wins(good, self.key, self.order, names) if not self.absent_only else good.groupBy(*self.key).agg(F.min_by(F.struct(*names), F.struct(*self.order)).alias("_first")).select(*self.key, *(F.col("_first")[c].alias(c) for c in names))
        reduced.select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        failed = rows.where("_fault is not null").withColumnRenamed("_fault", "error").withColumn("status", F.lit("failed"))
        failed.write.mode("overwrite").parquet(f"{self.path}/failed/batch={number}")

    def failed(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/failed")

    def _state(self, spark: SparkSession) -> DataFrame:
        """Rows of the newest base and of the batches behind it, with their batch."""
        changes = spark.read.parquet(f"{self.path}/changes")
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/base")
        if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return changes
        base = spark.read.parquet(f"{self.path}/base")
        upto = base.agg(F.max("upto")).first()[0]
        return base.where(F.col("upto") == upto).drop("upto").unionByName(changes.where(F.col("batch") > upto))

    def current(self, spark: SparkSession) -> DataFrame:
        """One row a key, with the batch that it comes from."""
        rows = self._state(spark)
        names = [c for c in rows.columns if c not in self.key]
        if self.absent_only:
            first = rows.groupBy(*self.key).agg(F.min_by(F.struct(*names), F.struct("batch", *self.order)).alias("_first"))
            return first.select(*self.key, *(F.col("_first")[c].alias(c) for c in names))
        return latest_wins(rows, self.key, [*self.order, "batch"], names)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Writes what batches up to ``upto`` leave as a base, which ``current`` then begins with. Safe to repeat; later batches stay as they are."""
        rows = self._state(spark).where(F.col("batch") <= upto)
        held = KeyedSink(self.path, self.key, self.order, None, self.absent_only)
        held._state = lambda _: rows
        held.current(spark).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")


def written_with_counters(df: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Writes a frame and counts rows by conditions in the same pass: no second job, and nothing read again."""
    seen = Observation()
    df.observe(seen, *(F.count_if(condition).alias(name) for name, condition in counters.items())).write.mode("overwrite").parquet(path)
    return {name: int(seen.get[name]) for name in counters}
