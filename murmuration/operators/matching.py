"""Sounds that are nearly alike, found by the segments that they have to share, and a choice of spans that don't overlap, made in rounds."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions import sounds


FEW = 32  # terms that each run of their length is compared with at once


def settled(df: DataFrame) -> DataFrame:
    """The frame written down, so that what follows doesn't work it out again: a checkpoint under spark.checkpoint.dir; where that is unset, a temporary folder
    in local mode and an error on a cluster."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="murmuration-"))
    return df.checkpoint()


def _every(name: str, low: Column, high: Column) -> Column:
    """A row for every number from low to high, none if there is none."""
    return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias(name)


def near_sounds(runs: DataFrame, terms: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Pairs of a run and a term of the same keys that sound alike: `sound_distance` at most `most` (below one half).

    `runs` holds the keys and g_s, `terms` the keys and t_s, other columns go along; both are best distinct. Where a term is cut into one segment more than edits are allowed, one segment stays
    whole, and it stands in the run where the edits before and after it leave room. So runs and terms meet by keys,
    length of the run, place and segment, and only what meets is compared. Where at most FEW terms fit the keys and a length, a run meets
    those without segments, which would be more rows than terms. Every pair is found. A null sound meets nothing.
    """
    bare = lambda c: F.replace(F.col(c), F.lit(" "))
    size = F.length("_t").cast("int")
    whole = lambda c: F.floor(c + 1e-9).cast("int")
    widest = int(1 / most) + 1  # a segment's length: that of the term over more edits than `most` of it
    t = terms.withColumn("_t", bare("t_s")).where(F.col("_t").isNotNull())
    t = t.select("*", _every("_n", F.ceil(size * (1 - most) - 1e-9).cast("int"), whole(size / (1 - most))))
    g = runs.withColumn("_g", bare("g_s")).where(F.col("_g").isNotNull()).withColumn("_n", F.length("_g").cast("int"))
    many = t.groupBy(*keys, "_n").agg(F.count("*").alias("_many")).where(F.col("_many") > FEW).drop("_many")
    direct = g.join(t.join(many, [*keys, "_n"], "left_anti"), [*keys, "_n"])
    t, g = (df.join(many, [*keys, "_n"], "left_semi") for df in (t, g))
    t = t.withColumn("_k", whole(F.greatest(size, F.col("_n")) * most)).select("*", _every("_i", F.lit(0), F.col("_k")))
    start, end = (whole((F.col("_i") + j) * size / (F.col("_k") + 1)) for j in (0, 1))
    t = t.withColumns({"_a": start, "_z": end})
    moved = F.col("_n") - size
    low, high = F.col("_a") + F.ceil((moved - F.col("_k")) / 2).cast("int"), F.col("_a") + F.floor((moved + F.col("_k")) / 2).cast("int")
    part = F.expr("substring(_t, _a + 1, _z - _a)")
    t = t.select("*", part.alias("_part"), _every("_at", F.greatest(F.lit(0), low), F.least(F.col("_n") - F.col("_z") + F.col("_a"), high)))
    t = t.drop("_i", "_k", "_a", "_z").distinct()
    places = g.select("*", _every("_at", F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)))).select("*", _every("_l", F.when(F.col("_n") > 0, 1).otherwise(0), F.least(F.lit(widest), F.col("_n") - F.col("_at"))))
    g = places.withColumn("_part", F.expr("substring(_g, _at + 1, _l)")).drop("_l")
    met = g.join(t, [*keys, "_n", "_at", "_part"]).drop("_at", "_part").unionByName(direct).drop("_n")
    near = lambda df: df.where(sounds.sound_distance(F.col("_g"), F.col("_t")) <= most)
    return near(met).distinct().withColumn("distance", sounds.sound_distance(F.col("_g"), F.col("_t"))).drop("_g", "_t")


def choose_apart(spans: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of spans (keys, start_idx, end_idx) those that a walk in `order` takes when it leaves out what overlaps with one already taken.

    In rounds: a span that comes before all that overlap with it is taken, and those go. Ties go by place. Spans meet at the places
    that they cover, so a file of any size is no group; a round is two aggregations. As many rounds
    as the longest chain of overlapping spans of which each comes before the next. Spans are short and distinct.
    """
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "start_idx", "end_idx")
    left = settled(spans.select(*keys, "start_idx", "end_idx", rank.alias("_r")))
    taken: list[DataFrame] = []
    covered = F.explode(F.sequence(F.col("start_idx"), F.col("end_idx") - 1)).alias("_p")
    while not left.isEmpty():
        at = left.select(*keys, "start_idx", "end_idx", "_r", covered)
        least = at.groupBy(*keys, "_p").agg(F.min("_r").alias("_m"))
        first = at.join(least, [*keys, "_p"]).groupBy(*keys, "start_idx", "end_idx", "_r").agg(F.bool_and(F.col("_m") == F.col("_r")).alias("_first"))
        round_ = settled(first)
        won = round_.where("_first").drop("_first")
        taken.append(won.select(*keys, "start_idx", "end_idx"))
        gone = won.select(*keys, covered)
        rest = round_.where("not _first").drop("_first")
        hit = rest.select(*keys, "start_idx", "end_idx", covered).join(gone, [*keys, "_p"], "left_semi").select(*keys, "start_idx", "end_idx").distinct()
        left = settled(rest.join(hit, [*keys, "start_idx", "end_idx"], "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else spans.select(*keys, "start_idx", "end_idx")
