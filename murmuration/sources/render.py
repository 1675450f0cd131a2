"""Transcripts as text: one row of text per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.functions import text as T


def ordered(value: Column, by: str = "\n") -> Column:
    """Values of a group joined in order of pos."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("v")))), lambda x: x["v"]), by)


def txt(segments: DataFrame) -> DataFrame:
    """`[s.ss --> e.ee] Speaker X: text` lines, [N/A] where a time is missing (SRC-8)."""
    times = F.when(F.col("start").isNull() | F.col("end").isNull(), "[N/A]").otherwise(F.format_string("[%.2f --> %.2f]", "start", "end"))
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit(" Speaker "), "speaker", F.lit(":"))).otherwise("")
    return segments.groupBy("file_id").agg(F.concat(ordered(F.concat(times, who, F.lit(" "), "text")), F.lit("\n")).alias("txt"))


def srt(segments: DataFrame) -> DataFrame:
    """Numbered subtitles (SRC-9). A file with a missing time has a null text."""
    n = F.row_number().over(W.partitionBy("file_id").orderBy("pos"))
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("Speaker "), "speaker", F.lit(": "))).otherwise("")
    block = F.concat(n.cast("string"), F.lit("\n"), T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")), F.lit("\n"), who, "text", F.lit("\n"))
    bad = F.bool_or(F.col("start").isNull() | F.col("end").isNull())
    return segments.withColumn("_b", block).groupBy("file_id").agg(bad.alias("_bad"), ordered(F.col("_b")).alias("srt")).select("file_id", F.when(~F.col("_bad"), F.col("srt")).alias("srt"))


def documents(segments: DataFrame) -> DataFrame:
    """Text, speakers and length of every transcript; files without any text are left out (SRC-7, AGG-20)."""
    clean = T.squeeze(F.col("text"))
    rows = segments.withColumn("text", clean).where("text != ''")
    return rows.groupBy("file_id").agg(ordered(F.col("text"), " ").alias("text"), F.count_distinct("speaker").alias("n_speakers"), F.count("*").alias("n_segments"), F.max("end").alias("duration"))


def unclear_text(words: DataFrame) -> DataFrame:
    """Words with uncertain runs as [unclear: best | alt] (FN-19): an empty alternative is a dash, none leaves the bar out."""
    w = W.partitionBy("file_id").orderBy("pos")
    alt = F.col("alternative")
    new = F.coalesce(F.col("unclear") != F.lag("unclear").over(w), F.lit(True)) | (F.col("unclear") & alt.isNotNull())
    runs = words.withColumn("_r", F.sum(new.cast("int")).over(w))
    part = runs.groupBy("file_id", "_r").agg(F.min("pos").alias("pos"), F.bool_or("unclear").alias("u"), ordered(F.col("text"), " ").alias("t"), F.max("alternative").alias("alt"))
    shown = F.when(~F.col("u"), F.col("t")).otherwise(
        F.concat(F.lit("[unclear: "), "t", F.when(F.col("alt").isNull(), "").otherwise(F.concat(F.lit(" | "), F.when(F.col("alt") == "", "—").otherwise(F.col("alt")))), F.lit("]"))
    )
    return part.groupBy("file_id").agg(ordered(shown, " ").alias("text"))
