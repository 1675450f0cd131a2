"""Places within a key without sorting the key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.operators.matching import settled


def placed(df: DataFrame, keys: list[str], order: list, out: str = "place", weight: str | None = None) -> DataFrame:
    """Adds the 0-based place within the keys in `order`, or with `weight` the sum of that column over the rows before.

    Rows are dealt in ranges of keys and order, cut at sampled quantiles, and sorted within them; equal ones go by a hash of the whole row. A row's
    place within its range and one count for each key and range give its place, so ids that share a long beginning, and
    keys of any size, spread over tasks like any others.
    """
    by = [*keys, *order, F.xxhash64(*df.columns)]
    held = settled(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = held.withColumns({"_part": F.shiftright("_at", 33), "_w": F.col(weight) if weight else F.lit(1)})
    counts = rows.groupBy(*keys, "_part").agg(F.sum("_w").alias("_c"), F.min("_at").alias("_low"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", "_low", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    met = rows.join(starts, [*keys, "_part"])
    if weight:
        inside = F.coalesce(F.sum("_w").over(W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    else:
        inside = F.col("_at") - F.col("_low")
    return met.withColumn(out, F.col("_s") + inside).drop("_at", "_part", "_w", "_s", "_low")
