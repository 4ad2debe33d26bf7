"""When things may start: calls under a rate limit, and failures that a later success forgives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.groups import written


def paced(calls: DataFrame, key: str, arrival: str, order: str, most: int, window: int) -> DataFrame:
    """Adds ``start``: the moment each call may start so that no key starts more than ``most`` in any ``window``, first come first served.

    ``arrival``, ``window`` and ``start`` are whole numbers of one unit; calls that arrive together go by ``order``, which is unique. A window is half open: a start is free again exactly ``window`` later. Null keys are
    a key of their own; null arrivals have a null start and take no place.

    start(i) = max(arrival(i), start(i - most) + window). The calls of a key whose places differ by multiples of ``most`` form a lane, in which the j-th starts at the largest of arrival(k) + (j - k) * window up to it: a
    running maximum. Places and maxima are counted inside ranges of calls and carried from range to range, so that a key of any size is many tasks' work."""
    if most < 1 or window < 1:
        raise ValueError("most and window are 1 or more")
    k, a = F.col(key), F.col(arrival)
    dealt = calls.where(a.isNotNull()).repartitionByRange(k, a, F.col(order)).withColumn("_range", F.spark_partition_id())
    kept = written(dealt, "ranges")
    inside = Window.partitionBy(key, "_range").orderBy(a, order)
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(k.alias("_k"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = kept.join(counts, k.eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    place = F.col("_first") + F.row_number().over(inside) - 1
    lanes = placed.withColumn("_place", place).withColumn("_lane", F.col("_place") % most).withColumn("_free", a - F.floor(F.col("_place") / most) * window)
    lanes = written(lanes.drop("_k", "_r", "_first"), "lanes")
    carried = lanes.groupBy(k.alias("_k"), F.col("_lane").alias("_l"), F.col("_range").alias("_r")).agg(F.max("_free").alias("_top"))
    carried = carried.withColumn("_carried", F.max("_top").over(Window.partitionBy("_k", "_l").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    met = lanes.join(carried, k.eqNullSafe(F.col("_k")) & (F.col("_lane") == F.col("_l")) & (F.col("_range") == F.col("_r")))
    running = F.max("_free").over(Window.partitionBy(key, "_range", "_lane").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    start = F.greatest(running, "_carried") + F.floor(F.col("_place") / most) * window
    done = met.withColumn("start", start.cast("long")).select(*calls.columns, "start")
    return done.unionByName(calls.where(a.isNull()).withColumn("start", F.lit(None).cast("long")))


def unforgiven(events: DataFrame, key: str, at: str, failed: Column, succeeded: Column, grace: int) -> DataFrame:
    """The failures that no success of the same key follows within ``grace`` (in the unit of ``at``, both ends included).

    One sort by key: a failure looks at the next success, so many events of a key don't meet each other. Null keys and times are never forgiven."""
    success = F.when(succeeded, F.col(at))
    onward = Window.partitionBy(key).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.withColumn("_next", F.when(F.col(key).isNotNull(), F.min(success).over(onward))).where(failed)
    return marked.where(F.col("_next").isNull() | F.col(at).isNull() | (F.col("_next") - F.col(at) > grace)).drop("_next")
