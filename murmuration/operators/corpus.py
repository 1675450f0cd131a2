"""Building and checking an evaluation corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.operators.ranks import placed


def pick_speakers(utts: DataFrame, n: int, seconds: float) -> DataFrame:
    """Evenly spread speakers in order of (length, name), the first utterances of each until its budget is crossed (TOP-3, TOP-4)."""
    names = utts.select("speaker").where("speaker is not null").distinct()
    ranked = placed(names, [], [F.length("speaker"), "speaker"], "_r")
    stride = F.greatest(F.lit(1), F.floor(F.lit(names.count() / n)))
    chosen = ranked.where((F.col("_r") % stride == 0) & (F.col("_r") / stride < n)).select("speaker")
    before = F.coalesce(F.sum("seconds").over(W.partitionBy("speaker").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return utts.join(chosen, "speaker", "left_semi").withColumn("_b", before).where(F.col("_b") < seconds).drop("_b")


def round_robin(utts: DataFrame, key: str, run: int = 3, offset: int = 0) -> DataFrame:
    """Place of each utterance when speakers take turns of `run` consecutive ones, beginning with the offset-th speaker (TOP-5)."""
    w = W.partitionBy(key, "speaker").orderBy("rn")
    turn = utts.withColumn("turn", F.floor((F.row_number().over(w) - 1) / run))
    who = "speaker"
    if offset:
        names = utts.select(key, "speaker").distinct()
        sizes = names.groupBy(key).agg(F.count("*").alias("_k"))
        seats = placed(names, [key], ["speaker"], "_p").join(sizes, key).select(key, "speaker", F.pmod(F.col("_p") - offset, "_k").alias("_seat"))
        turn, who = turn.join(seats, [key, "speaker"]), "_seat"
    return placed(turn, [key], ["turn", who, "rn"], "_p").withColumn("place", F.col("_p") + 1).drop("_p", "_seat")


def choose_smoke(items: DataFrame, per_kind: int = 2) -> DataFrame:
    """The shortest item of each slice by (duration, id); of items without speech the first of every kind by the hash of their id (TOP-2).

    `kind` is a column of the items without speech, if there is one.
    """
    chosen = items.where("slice != 'nospeech'").groupBy("slice").agg(F.min_by(F.struct("id", "duration"), F.struct("duration", "id")).alias("s")).select("slice", "s.id", "s.duration")
    if "kind" not in items.columns:
        return chosen
    first = F.row_number().over(W.partitionBy("kind").orderBy(F.sha2("id", 256)))
    silent = items.where("slice = 'nospeech'").withColumn("_r", first).where(F.col("_r") <= per_kind)
    return chosen.unionByName(silent.select("slice", "id", "duration"))


def derive_items(items: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """Noisy copies: the k-th item of a split gets the k-th combination, cyclically (J-11)."""
    spark = items.sparkSession
    combos = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(kinds)], "_c int, kind string, snr int")
    numbered = placed(items, ["slice", "split"], ["id"], "_k").withColumn("_c", (F.col("_k") % len(kinds)).cast("int"))
    return numbered.join(combos, "_c").select("slice", "split", F.concat_ws("-", "id", F.concat("kind", F.col("snr").cast("string"))).alias("id"), "kind", "snr", "duration")


def with_status(summaries: DataFrame, slices: DataFrame) -> DataFrame:
    """Summaries of every known slice, ok or MISSING where it has no items (AGG-11)."""
    met = slices.select("slice").join(summaries, "slice", "full_outer")
    return met.withColumn("status", F.when(F.coalesce("items", F.lit(0)) > 0, "ok").otherwise("MISSING")).na.fill(0)


def summary(items: DataFrame) -> DataFrame:
    """Items and minutes per slice and in total (AGG-11)."""
    return items.rollup("slice").agg(
        F.count("*").alias("items"), F.sum("duration").alias("seconds"),
        F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"),
    ).withColumn("slice", F.coalesce("slice", F.lit("TOTAL")))


def problems(items: DataFrame, longest: float = 600, least_items: int = 4) -> DataFrame:
    """Rows of (slice, id, problem) that make a manifest invalid (AGG-18)."""
    row = lambda df, what, name="id": df.select("slice", F.col(name).cast("string").alias("id"), F.lit(what).alias("problem"))
    twice = items.groupBy("slice", "id").count().where("count > 1")
    sides = items.groupBy("slice").agg(
        F.count("*").alias("n"), F.sum("duration").alias("all"), F.sum(F.when(F.col("split") == "dev", F.col("duration")).otherwise(0)).alias("dev"),
        F.count_if(F.col("split") == "dev").alias("n_dev"), F.count_if(F.col("split") == "test").alias("n_test"),
    )
    share = F.least(F.col("dev"), F.col("all") - F.col("dev")) / F.col("all")
    uneven = sides.where((F.col("n") >= least_items) & ((F.least("n_dev", "n_test") < 2) | (share < 0.35))).withColumn("id", F.lit(None).cast("string"))
    rows = row(twice, "duplicate")
    if "speakers" in items.columns:
        rows = rows.unionByName(row(items.where(F.exists("speakers", lambda t: (t["start"] < 0) | (t["end"] > F.col("duration") + 0.05))), "turns"))
    return (
        rows.unionByName(row(items.where(~F.col("split").isin("dev", "test")), "split"))
        .unionByName(row(items.where(F.col("duration") > longest), "long")).unionByName(row(items.where((F.col("slice") != "nospeech") & (F.trim(F.coalesce("reference", F.lit(""))) == "")), "empty"))
        .unionByName(row(uneven, "uneven"))
    )


def pending(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items without a fresh output of the system (J-12)."""
    return items.join(outputs.select("system", "id", "fingerprint"), ["system", "id", "fingerprint"], "left_anti")


def first_seen(terms: DataFrame, cap: int = 200) -> DataFrame:
    """First casing of each term regardless of case, in order of appearance, at most `cap` a file (TOP-7)."""
    first = terms.groupBy("file_id", F.lower("term").alias("_k")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("file_id").orderBy("pos"))).where(F.col("rank") <= cap).drop("_k")


def balanced_split(items: DataFrame) -> DataFrame:
    """Greedy halves (CMP-11): longest first to the side with fewer seconds so far; ties to dev.

    Items of one duration go to one side until the other has fewer, and then to both in turn. So the choice is made on
    counts of durations and comes out as how many go to which side first; items are numbered within their duration and look it up.
    """
    rows = items.select("slice", "id", "duration")
    counts = rows.groupBy("slice", "duration").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("duration", ascending=False)
        lead, first, side = 0.0, [], []  # how far dev is ahead
        for d, n in zip(pdf["duration"], pdf["n"]):
            to_dev = lead <= 0
            alone = n if d <= 0 else min(n, int(abs(lead) // d) + (1 if to_dev or abs(lead) % d else 0)) or 1
            lead += d * alone * (1 if to_dev else -1)
            for k in range((n - alone) % 2):  # pairs of turns cancel out
                lead += d if lead <= 0 else -d
            first.append(alone)
            side.append(to_dev)
        return pdf.assign(first=first, to_dev=side)[["slice", "duration", "first", "to_dev"]]

    plan = counts.groupBy("slice").applyInPandas(run, "slice string, duration double, first long, to_dev boolean")
    numbered = rows.withColumn("_r", F.row_number().over(W.partitionBy("slice", "duration").orderBy("id")) - 1)
    turn = F.when(F.col("_r") < F.col("first"), F.col("to_dev")).otherwise(F.col("to_dev") == ((F.col("_r") - F.col("first")) % 2 == 1))
    return numbered.join(plan, ["slice", "duration"]).select("slice", "id", "duration", F.when(turn, "dev").otherwise("test").alias("split"))
