"""Choosing utterances, items and answers for a corpus."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.functions import text as T
from murmuration.operators.ranks import placed


def select_items(items: DataFrame, split: str = "all", slices: list[str] | None = None) -> DataFrame:
    """Items of a split (`all`: any) and of the named slices (none: any) (PRJ-3)."""
    out = items if split == "all" else items.where(F.col("split") == split)
    return out if slices is None else out.where(F.col("slice").isin(*slices))


def time_window(utts: DataFrame, target: float, offset: float, least: int, from_first: bool = True) -> DataFrame:
    """Utterances of every group that lie wholly within `target` seconds from the window's start, of groups with at least `least` such (PRJ-6).

    The window starts `offset` after the group's first utterance, or at `offset` itself.
    """
    w = W.partitionBy("group_id")
    begin = (F.min("start").over(w) if from_first else F.lit(0.0)) + offset
    kept = utts.withColumn("_t", begin).where((F.col("start") >= F.col("_t")) & (F.col("end") <= F.col("_t") + target)).drop("_t")
    return kept.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least).drop("_n")


def talk_length(df: DataFrame, text: str = "text", least: int = 300, most: int = 1700, seconds: float = 600) -> DataFrame:
    """Talks of `least` to `most` words and at most `seconds` long (PRJ-16)."""
    return df.where(F.size(T.tokens(F.col(text))).between(least, most) & (F.col("duration") <= seconds))


def clamp_words(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Word times within their chunk, the end not before the start (PRJ-18)."""
    c = chunks.select("file_id", "chunk", F.col("start").alias("_c0"), F.col("end").alias("_c1"))
    within = lambda x: F.least(F.greatest(x, F.col("_c0")), F.col("_c1"))
    met = words.join(c, ["file_id", "chunk"]).withColumn("start", within(F.col("start")))
    return met.withColumn("end", F.greatest(within(F.col("end")), F.col("start"))).drop("_c0", "_c1")


def unmatched_smoke(smoke: DataFrame, items: DataFrame) -> DataFrame:
    """Smoke items that their slice's manifest lacks, where that slice exists (J-13)."""
    known = items.select("slice").distinct()
    return smoke.join(known, "slice", "left_semi").join(items.select("slice", "id"), ["slice", "id"], "left_anti")


def top_file(segments: DataFrame, *keys: str) -> DataFrame:
    """The file with the most segments, of equal ones the greatest id (TOP-6)."""
    n = segments.groupBy(*keys, "file_id").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by("file_id", F.struct("n", "file_id")).alias("file_id"), F.max("n").alias("n"))


def stride(n: int) -> int:
    """The first step of a third of n or more that has no divisor in common with n."""
    return next((s for s in range(max(1, n // 3), n + 1) if gcd(s, n) == 1), 1)


def spread_order(df: DataFrame, order: list, out: str = "visit") -> DataFrame:
    """The turn at which each row is visited when the i-th visit goes to row i * stride modulo the number of rows (TOP-10)."""
    n = df.count()
    back = pow(stride(n), -1, n) if n > 1 else 0
    return placed(df, [], order, "_p").withColumn(out, (F.col("_p") * back) % max(n, 1)).drop("_p")


def meeting_order() -> list[Column]:
    """Order of meetings by the last letter of their name, then the rest, so that families take turns (TOP-10)."""
    return [F.right("meeting", F.lit(1)), F.expr("substring(meeting, 1, length(meeting) - 1)")]


def first_per_category(rows: DataFrame, category: str, order: str, k: int = 4) -> DataFrame:
    """The first k rows of every category in order (TOP-11)."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(category).orderBy(order))).where(F.col("_r") <= k).drop("_r")


def batch_id_problems(asked: Column, got: Column) -> Column:
    """Ids of an answer that don't match those asked for: struct(missing, unexpected, duplicate), each a sorted array (SET-4)."""
    twice = F.filter(F.array_distinct(got), lambda x: F.size(F.filter(got, lambda y: y == x)) > 1)
    return F.struct(F.array_sort(F.array_except(asked, got)).alias("missing"), F.array_sort(F.array_except(got, asked)).alias("unexpected"), F.array_sort(twice).alias("duplicate"))


# ---------------------------------------------------------------- merged files and their health


def offset_segments(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Segment times moved by their chunk's offset; null times stay null, an offset of 0 or less changes nothing (WIN-2)."""
    met = segments.join(offsets.select("file_id", "chunk", "offset"), ["file_id", "chunk"], "left")
    by = F.when(F.col("offset") > 0, F.col("offset")).otherwise(F.lit(0))
    return met.withColumns({"start": F.col("start") + by, "end": F.col("end") + by}).drop("offset")


def merged_transcripts(results: DataFrame, segments: DataFrame) -> DataFrame:
    """One transcript a file from its chunks' results (AGG-19): texts that aren't blank parted by an empty line, else the segments' texts.

    The language is the first known by order of chunks; chunks are listed with their durations.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    in_order = lambda c, by: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*by, c.alias("t")))), lambda x: x["t"]), lambda t: t != ""), "\n\n")
    parts = results.groupBy("file_id").agg(
        in_order(text, ["chunk"]).alias("text"), F.min_by("language", F.when(F.col("language").isNotNull(), F.col("chunk"))).alias("language"),
        F.array_sort(F.collect_list(F.struct("chunk", "duration"))).alias("chunks"),
    )
    said = segments.groupBy("file_id").agg(in_order(text, ["chunk", "pos"]).alias("_said"))
    both = parts.join(said, "file_id", "left")
    return both.withColumn("text", F.when(F.col("text") != "", F.col("text")).otherwise(F.coalesce("_said", F.lit("")))).drop("_said")


def run_health(stages: DataFrame, trust: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per file, counts): stages that are neither ok nor off with their status, and the trust level; files by stage and level (AGG-25).

    `stages` holds (file_id, stage, status), `trust` (file_id, level).
    """
    bad = stages.where(~F.coalesce(F.col("status").isin("ok", "off"), F.lit(False)))
    listed = bad.groupBy("file_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "stage", "status"))).alias("notes"))
    per_file = trust.join(listed, "file_id", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    return per_file, bad.join(trust, "file_id", "left").groupBy("stage", "level").agg(F.count_distinct("file_id").alias("files"))


def collapse_builds(frames: DataFrame, ink_most: float = 0.5, grown: float = 1.05, kept: float = 0.95) -> DataFrame:
    """Slides that are built up step by step as one (WIN-15): a frame that only adds to the one just before it joins it.

    `frames` holds (video_id, pos, ink array of 0 and 1, start, end, repeats array). Both at most half ink, the earlier not empty, the
    later at least 1.05 times as much and with 0.95 of what was there. The last frame stands for the group, with all spans and repeats.
    """
    w = W.partitionBy("video_id").orderBy("pos")
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v.cast("int"))
    both = frames.withColumns({"_p": F.lag("ink").over(w), "_n": total(F.col("ink")).cast("double")})
    old = total(F.coalesce("_p", F.array().cast("array<int>")))
    still = total(F.zip_with("_p", "ink", lambda a, b: (a.cast("int") * b.cast("int"))))
    area = F.size("ink")
    adds = (old > 0) & (old <= ink_most * area) & (F.col("_n") <= ink_most * area) & (F.col("_n") > grown * old) & (still >= kept * old)
    marked = both.withColumn("_g", F.sum((~F.coalesce(adds, F.lit(False))).cast("int")).over(w))
    return marked.groupBy("video_id", "_g").agg(
        F.max("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.flatten(F.collect_list("repeats")).alias("repeats"), F.count("*").alias("steps")
    ).drop("_g")
