"""Samples and frames held as arrays: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def power(x: Column) -> Column:
    """Mean square of an array, null for an empty one."""
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x))


def rms(x: Column) -> Column:
    return F.sqrt(power(x))


def to_dbfs(level: Column) -> Column:
    """20 log10 of a level, not below 1e-12; null stays null."""
    return 20 * F.log10(F.when(level.isNotNull(), F.greatest(level, F.lit(1e-12))))


def dbfs(x: Column) -> Column:
    """20 log10 of the RMS, not below 1e-12 (SIG-1)."""
    return to_dbfs(F.coalesce(rms(x), F.lit(0.0)))


def snr_db(speech: Column, rest: Column) -> Column:
    """10 log10 of the ratio of mean powers, floor 1e-12; null if a side is empty (SIG-2)."""
    return 10 * F.log10(F.greatest(power(speech), F.lit(1e-12)) / F.greatest(power(rest), F.lit(1e-12)))


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once and not again inside every lambda of the body."""
    return F.transform(F.array(value), body)[0]


def mix_at_snr(speech: Column, noise: Column, db: Column) -> Column:
    """Speech plus noise at a signal-to-noise ratio, the noise tiled or cut; rescaled to a peak of 0.99 if above (SIG-3)."""

    def mixed(tiled: Column) -> Column:
        ps, pn = power(speech), power(tiled)
        scale = F.when((ps > 0) & (pn > 0), F.sqrt(ps / (pn * F.pow(F.lit(10.0), db / 10)))).otherwise(0.0)
        return bound(scale, lambda k: F.zip_with(speech, tiled, lambda a, b: a.cast("double") + b * k))

    def limited(x: Column) -> Column:
        return bound(F.array_max(F.transform(x, F.abs)), lambda peak: F.when(peak > 0.99, F.transform(x, lambda v: v * 0.99 / peak)).otherwise(x))

    tiled = bound(noise, lambda n: F.transform(speech, lambda v, i: F.element_at(n, (i % F.size(n) + 1).cast("int")).cast("double")))
    return bound(bound(tiled, mixed), limited)


def frame_energy(x: Column, size: int) -> Column:
    """Mean square of each full frame (SIG-4)."""
    n = F.floor(F.size(x) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: power(F.slice(x, (i - 1) * size + 1, F.lit(size))))).otherwise(F.array().cast("array<double>"))


def changed_fraction(a: Column, b: Column, least: float) -> Column:
    """Share of places that differ by more than `least` (SIG-5)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (F.abs(x - y) > least).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def shots(frames: DataFrame, changed: float = 0.002, least: int = 2, pixel: float = 40.0) -> DataFrame:
    """Runs of frames without a change of scene; shorter ones than `least` seconds are dropped (WIN-14)."""
    w = W.partitionBy("video_id").orderBy("second")
    cut = F.coalesce(changed_fraction(F.col("thumb"), F.lag("thumb").over(w), pixel) > changed, F.lit(True))
    marked = frames.withColumn("_cut", cut).select("video_id", "second", F.sum(F.col("_cut").cast("int")).over(w).alias("shot"))
    return marked.groupBy("video_id", "shot").agg(F.min("second").alias("first"), F.max("second").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)


def motion(frames: DataFrame, pixel: float = 40.0, soft: float = 10.0, periods: int = 20) -> DataFrame:
    """Per pixel the share of seconds in which it changed by more than `pixel` (SIG-6): changes are listed, not frames.

    Also the share of changes by more than `soft`, and in how many of `periods` equal periods there was a strong one.
    """
    w = W.partitionBy("video_id").orderBy("second")
    both = frames.withColumns({"_p": F.lag("thumb").over(w), "_i": F.row_number().over(w) - 2}).where("_p is not null")
    total = both.groupBy("video_id").agg(F.count("*").alias("_n"))
    delta = F.zip_with("thumb", "_p", lambda a, b: F.abs(a - b))
    listed = F.filter(F.transform(delta, lambda v, i: F.struct(F.when(v > soft, i).alias("pixel"), (v > pixel).alias("strong"))), lambda x: x["pixel"].isNotNull())
    moved = both.select("video_id", "_i", F.explode(listed).alias("m")).select("video_id", "_i", "m.*").join(total, "video_id")
    period = F.floor(F.col("_i") * F.least(F.lit(periods), "_n") / F.col("_n"))
    return moved.groupBy("video_id", "pixel").agg(
        (F.count_if("strong") / F.max("_n")).alias("rate"), (F.count("*") / F.max("_n")).alias("soft_rate"), F.count_distinct(F.when(F.col("strong"), period)).alias("periods"),
    )
