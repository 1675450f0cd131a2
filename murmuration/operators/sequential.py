"""Diarization error, guarded rewrites and distinct shots."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.operators.islands import islands
from murmuration.operators.matching import settled

def best_mapping(overlap: np.ndarray) -> float:
    """Greatest total overlap of a one-to-one mapping of rows to columns, exact at every size.

    Rows are added one by one along the cheapest path of changes, with prices on rows and columns that keep every path's cost
    in view (the Hungarian method); the columns of a step are compared as one vector.
    """
    gain = overlap if overlap.shape[0] <= overlap.shape[1] else overlap.T
    rows, cols = gain.shape
    cost = gain.max(initial=0.0) - gain
    price_row, price_col = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for new in range(rows):
        reach, came = np.full(cols, np.inf), np.full(cols, -1)
        seen = np.zeros(cols, bool)
        row, last, spent = new, -1, 0.0
        while True:
            step = spent + cost[row] - price_row[row] - price_col
            better = ~seen & (step < reach)
            reach[better], came[better] = step[better], last
            last = int(np.where(seen, np.inf, reach).argmin())
            spent, seen[last] = reach[last], True
            if owner[last] < 0:
                break
            row = owner[last]
        price_row[new] += spent
        others = np.flatnonzero(seen & (owner >= 0))
        price_row[owner[others]] += spent - reach[others]
        price_col[seen] -= spent - reach[seen]
        while last >= 0:
            owner[last] = owner[came[last]] if came[last] >= 0 else new
            last = came[last]
    used = np.flatnonzero(owner >= 0)
    return float(gain[owner[used], used].sum())


def diarization_error(turns: DataFrame, collar: float = 0.25, width: float = 30.0) -> DataFrame:
    """(item, der): diarization error of every item (FN-10), `turns` being (item, side ref or hyp, start, end, speaker).

    A sweep over the boundaries of all turns, on a 10 ms grid: between two of them the sets of active speakers don't change. They are found by
    time bins, and the overlap of each pair of speakers is added up; the mapping is chosen on that small matrix. Reference time counts once for each speaker;
    time within the collar of a reference boundary isn't scored. Without scored reference speech: 0 if the hypothesis is silent too, else 1.
    """
    one = turns.select("item", "side", "speaker", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    w = W.partitionBy("item", "side", "speaker").orderBy("start", "end")
    runs = islands(one, ["item", "side", "speaker"], ["start", "end"], F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    grid = lambda c: F.rint(c * 100).cast("long")
    own = runs.groupBy("item", "side", "speaker", "island").agg(grid(F.min("start")).alias("s"), grid(F.max("end")).alias("e")).drop("island")
    half = round(collar * 100)
    shut = own.where("side = 'ref'").select("item", F.lit("shut").alias("side"), F.lit("").alias("speaker"), F.explode(F.array("s", "e")).alias("x")).select("item", "side", "speaker", F.greatest(F.lit(0), F.col("x") - half).alias("s"), (F.col("x") + half).alias("e"))
    active = settled(own.unionByName(shut).where("s < e"))
    bounds = active.select("item", F.explode(F.array("s", "e")).alias("t0")).distinct()
    steps = bounds.withColumn("t1", F.lead("t0").over(W.partitionBy("item").orderBy("t0"))).where("t1 is not null")
    bin_ = lambda c: F.floor(c / int(width * 100))
    spread = active.select("*", F.explode(F.sequence(bin_(F.col("s")), bin_(F.col("e")))).alias("b"))
    met = steps.withColumn("b", bin_(F.col("t0"))).join(spread, ["item", "b"]).where("s <= t0 and t1 <= e")
    set_of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("speaker")))
    sets = met.groupBy("item", "t0", "t1").agg(set_of("ref").alias("r"), set_of("hyp").alias("h"), F.bool_or(F.col("side") == "shut").alias("shut")).where(~F.col("shut"))
    sets = settled(sets.select("item", (F.col("t1") - F.col("t0")).alias("w"), "r", "h"))
    n_ref, n_hyp = F.size("r"), F.size("h")
    sums = sets.groupBy("item").agg(F.sum(n_ref * F.col("w")).alias("total"), F.sum(F.greatest(n_ref, n_hyp) * F.col("w")).alias("most"), F.sum(F.greatest(F.lit(0), n_hyp - n_ref) * F.col("w")).alias("extra"))
    pairs = sets.select("item", "w", F.explode("r").alias("r"), "h").select("item", "w", "r", F.explode("h").alias("h")).groupBy("item", "r", "h").agg(F.sum("w").alias("w"))
    listed = pairs.groupBy("item").agg(F.collect_list(F.struct("r", "h", "w")).alias("overlaps"))  # a row for each pair of speakers
    kind = turns.schema["item"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = []
            for overlaps in b.column("overlaps").to_pylist():
                rows, cols = ({k: i for i, k in enumerate(sorted({o[side] for o in overlaps}))} for side in "rh")
                matrix = np.zeros((len(rows), len(cols)))
                for o in overlaps:
                    matrix[rows[o["r"]], cols[o["h"]]] = o["w"]
                right.append(best_mapping(matrix))
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(right, pa.float64())], names=["item", "right"])

    known = turns.select("item").distinct().join(sums, "item", "left").join(listed.mapInArrow(mapped, f"item {kind}, right double"), "item", "left")
    wrong = (F.col("most") - F.coalesce("right", F.lit(0.0))) / F.col("total")
    return known.select("item", F.when(F.coalesce("total", F.lit(0)) > 0, wrong).when(F.coalesce("extra", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("der"))


def likeness(a: list[str] | str, b: list[str] | str) -> float:
    """Twice the matching blocks' length over both lengths; 1 for two empty sides."""
    both = len(a) + len(b)
    matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return 2 * matched / both if both else 1.0


def diverges(old: str, new: str, least_words: int = 4, words_alike: float = 0.5, chars_alike: float = 0.4) -> bool:
    """Whether a rewrite is too far from its original (FN-16): judged by words if that has `least_words` or more, else by the characters of the words."""
    said, now = (re.findall(r"\w+", x.lower()) for x in (old, new))
    short = len(said) < least_words
    return likeness(" ".join(said), " ".join(now)) < chars_alike if short else likeness(said, now) < words_alike


def apply_refined(segments: DataFrame, refined: DataFrame) -> DataFrame:
    """Segments with refined texts (CMP-7): an empty or diverging rewrite is not taken; adds changed and guarded."""
    met = segments.join(refined.select("file_id", "pos", F.col("text").alias("_new")), ["file_id", "pos"], "left")
    names = segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, new = b.column("text").to_pylist(), b.column("_new").to_pylist()
            far = [bool((n or "").strip()) and diverges(o or "", n) for o, n in zip(old, new)]
            text = [o if f or not (n or "").strip() else n for o, n, f in zip(old, new, far)]
            columns = [pa.array(text, b.column(c).type) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t != o for t, o in zip(text, old)]), pa.array(far, pa.bool_())], names=[*names, "changed", "guarded"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return met.mapInArrow(run, f"{ddl}, changed boolean, guarded boolean")


def distinct_shots(shots: DataFrame, same: float = 0.0003, pixel: float = 40.0) -> DataFrame:
    """(video_id, shot, slide): shots (video_id, shot, thumb) against those kept before (TOP-9): a shot joins the first kept one that it hardly differs from.

    Two shots are alike if at most a share `same` of the pixels is more than `pixel` apart. Of one block more than pixels may change, one is then alike throughout, and so are the means of
    its halves. Means are cut into cells of that width, so alike shots meet in one of nine cells of some block. Who keeps a
    slide is decided in rounds: a shot before all undecided ones that it meets is kept, and those alike to it are settled. Shots meet only kept
    ones in full, so a slide that is shown often makes no pairs with itself. Equal thumbs of a video are settled by the first of them, as what is kept after that is
    not alike to any. A null thumb is kept by itself.
    """
    keys = ["video_id", "_n", "_k", "_a", "_b"]
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(x), F.lit(1))
    # a thumb with a number that isn't finite differs from itself
    odd = F.exists(F.coalesce("t", F.array().cast("array<double>")), lambda x: F.coalesce(F.isnan(x - x), F.lit(False)))
    every = shots.select("video_id", F.col("shot").cast("long").alias("shot"), F.col("thumb").cast("array<double>").alias("t"))
    every = settled(every.withColumn("_own", F.when(odd | F.col("t").isNull(), F.array("shot")).otherwise(F.array().cast("array<long>"))))
    thumbs = settled(every.groupBy("video_id", "t", "_own").agg(F.min("shot").alias("shot")))
    n = F.size("t")
    blocks = F.floor(F.lit(same) * n + 1e-9).cast("int") + 1
    cut = lambda k: F.floor(F.col(k) * n / blocks).cast("int")
    parts = thumbs.where("t is not null").withColumn("_k", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"_next": F.col("_k") + 1})
    parts = parts.withColumns({"_s": cut("_k"), "_e": cut("_next")}).withColumn("_m", F.floor((F.col("_s") + F.col("_e")) / 2).cast("int"))
    cell = lambda lo, hi: F.floor(mean(F.expr(f"slice(t, {lo} + 1, {hi} - {lo})")) / pixel).cast("long")
    marks = settled(parts.select("video_id", "shot", n.alias("_n"), "_k", cell("_s", "_m").alias("_a"), cell("_m", "_e").alias("_b")))

    def probes(df: DataFrame) -> DataFrame:
        near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
        return df.withColumn("_i", near).withColumn("_j", near).withColumns({"_a": F.col("_a") + F.col("_i"), "_b": F.col("_b") + F.col("_j")}).drop("_i", "_j")

    def alike(later: DataFrame, kept: DataFrame) -> DataFrame:
        """(video_id, shot, slide) of shots that are alike to a kept one before them."""
        met = marks.join(later, ["video_id", "shot"], "left_semi").join(probes(marks.join(kept, ["video_id", "shot"], "left_semi")).withColumnRenamed("shot", "slide"), keys)
        pairs = met.where("slide < shot").select("video_id", "shot", "slide").distinct()
        both = pairs.join(thumbs, ["video_id", "shot"]).join(thumbs.select("video_id", F.col("shot").alias("slide"), F.col("t").alias("y")), ["video_id", "slide"])
        far = F.size(F.filter(F.zip_with("t", "y", lambda x, y: F.abs(x - y)), lambda d: d > pixel))
        return both.where(far / F.greatest(F.size("t"), F.lit(1)) <= same).select("video_id", "shot", "slide")

    open_ = settled(marks.select("video_id", "shot").distinct())
    kept = thumbs.where("t is null").select("video_id", "shot")
    while not open_.isEmpty():
        own = marks.join(open_, ["video_id", "shot"], "left_semi")
        first = own.groupBy(*keys).agg(F.min("shot").alias("_f"))
        new = settled(probes(own).join(first, keys).groupBy("video_id", "shot").agg(F.min("_f").alias("_f")).where("_f = shot").select("video_id", "shot"))
        rest = open_.join(new, ["video_id", "shot"], "left_anti")
        open_ = settled(rest.join(alike(rest, new), ["video_id", "shot"], "left_anti"))
        kept = kept.unionByName(new)
    kept = settled(kept)
    homes = alike(thumbs.select("video_id", "shot").join(kept, ["video_id", "shot"], "left_anti"), kept).groupBy("video_id", "shot").agg(F.min("slide").alias("slide"))
    found = kept.select("video_id", "shot", F.col("shot").alias("slide")).unionByName(homes).join(thumbs, ["video_id", "shot"])
    return every.where("t is not null").join(found.drop("shot"), ["video_id", "t", "_own"]).select("video_id", "shot", "slide").unionByName(every.where("t is null").select("video_id", "shot", F.col("shot").alias("slide")))
