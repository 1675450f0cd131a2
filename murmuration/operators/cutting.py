"""Long spans cut at their quietest frames (WIN-4) and words cut into segments (WIN-8), without walking from cut to cut.

Where a piece begins decides where the next one does. That is worked out for every place at once, and links are doubled from the first.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.operators.islands import islands, joined
from murmuration.operators.matching import settled

SPAN = ["file_id", "s", "e"]


def reached(starts: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """All (keys, at) that links (keys, at, to) lead to from the starts, these included. Each place has one link at most.

    Links are doubled: after k rounds one leads 2**k steps ahead, so a chain takes as many rounds as its length has binary digits.
    """
    seen, ahead = settled(starts.select(*keys, "at").distinct()), settled(links.where("to is not null").select(*keys, "at", "to"))
    while not ahead.isEmpty():
        seen = settled(seen.unionByName(seen.join(ahead, [*keys, "at"]).select(*keys, F.col("to").alias("at"))).distinct())
        ahead = settled(ahead.alias("x").join(ahead.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far")), [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")))
    return seen


def split_long(spans: DataFrame, energy: DataFrame, longest: float = 30.0, search: float = 10.0, frame: float = 0.1, least: float = 0.001) -> DataFrame:
    """(file_id, span_start, part, start, end): chunks of at most `longest` seconds. A longer span is cut at the middle of the quietest frame of the
    window's last `search` seconds, the first of equal ones, and goes on from there; without a frame in them, at the window's end. A rest under `least` is left out.

    Where a cut in the middle of a frame would be followed by the next is found for all frames at once, over blocks of frames that
    overlap by a window. Only frames that follow some other can be cuts, and links between these few are doubled from each span's first cut.
    Spans meet frames by blocks. `energy` holds (file_id, frame, energy).
    """
    low, high = ceil(0.5 + (longest - search) / frame - 1e-6), floor(longest / frame - 0.5 + 1e-6)
    block = 20 * (high + 1)
    of = lambda c: F.floor(c / block)
    s = spans.select("file_id", F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    wide = s.where(F.col("e") - F.col("s") > longest)
    blocks = F.explode(F.sequence(of(F.col("s") / frame), of(F.col("e") / frame))).alias("b")
    frames = energy.select("file_id", F.col("frame").cast("long").alias("at"), F.struct(F.col("energy").cast("double").alias("loud"), F.col("frame").cast("long").alias("to")).alias("v"))
    inside = (F.col("at") * frame >= F.col("s") - 1e-9) & ((F.col("at") + 1) * frame <= F.col("e") + 1e-9)
    held = settled(frames.withColumn("b", of(F.col("at"))).join(wide.select(*SPAN, blocks), ["file_id", "b"]).where(inside))

    # Every frame also lies in the block before its own where it is within a window of that block's last frame.
    shown = held.select(*SPAN, "at", "v", F.explode(F.array(F.struct(F.col("b"), F.lit(True).alias("own")), F.struct((F.col("b") - 1).alias("b"), F.lit(False).alias("own")))).alias("x")).select(*SPAN, "at", "v", "x.*")
    shown = shown.where(F.col("own") | (F.pmod("at", F.lit(block)) <= high))
    ahead = F.min("v").over(W.partitionBy(*SPAN, "b").orderBy("at").rangeBetween(low, high))
    middle = lambda f: (f + 0.5) * frame
    goes_on = F.col("e") - middle(F.col("at")) > longest
    follows = settled(shown.withColumn("to", ahead["to"]).where(F.col("own") & goes_on).select(*SPAN, "at", "to"))
    cuts = follows.select(*SPAN, F.col("to").alias("at")).where("at is not null").distinct()

    def stepped(front: DataFrame) -> DataFrame:
        """The frame at which each of (span, from) is cut next, null if its window has none."""
        a, z = F.ceil((F.col("from") + longest - search - 1e-9) / frame), F.floor((F.col("from") + longest + 1e-9) / frame) - 1
        near = front.withColumns({"_a": a, "_z": z}).select("*", F.explode(F.sequence(of(F.col("_a")), F.greatest(of(F.col("_a")), of(F.col("_z"))))).alias("b"))
        met = near.join(held.select(*SPAN, "b", "at", "v"), [*SPAN, "b"]).where(F.col("at").between(F.col("_a"), F.col("_z")))
        return front.join(met.groupBy(*SPAN, "from").agg(F.min("v")["to"].alias("at")), [*SPAN, "from"], "left")

    front, found = settled(wide.withColumn("from", F.col("s"))), []
    while not front.isEmpty():
        begun = settled(stepped(front))
        # links from the first cuts too, which the other frames need not lead to
        nodes = cuts.unionByName(begun.where("at is not null").select(*SPAN, "at")).distinct()
        chain = settled(reached(begun.where("at is not null"), follows.join(nodes, [*SPAN, "at"], "left_semi"), SPAN))
        jumped = begun.where("at is null").select(*SPAN, (F.col("from") + longest).alias("cut"))
        found += [chain.select(*SPAN, middle(F.col("at")).alias("cut")), jumped]
        # where no frame follows, the walk goes on from the window's end
        stuck = chain.join(follows.where("to is null"), [*SPAN, "at"], "left_semi").select(*SPAN, middle(F.col("at")).alias("from"))
        front = settled(stuck.unionByName(jumped.where(F.col("e") - F.col("cut") > longest).select(*SPAN, F.col("cut").alias("from"))))
    return _chunks(s, reduce(DataFrame.unionByName, found) if found else s.select(*SPAN, F.col("s").alias("cut")).limit(0), F.lit(least))


def _chunks(spans: DataFrame, cuts: DataFrame, least: Column) -> DataFrame:
    edges = spans.select(*SPAN, F.explode(F.array("s", "e")).alias("cut")).unionByName(cuts.distinct())
    w = W.partitionBy(*SPAN).orderBy("cut")
    rows = edges.select(*SPAN, F.col("cut").alias("start"), F.lead("cut").over(w).alias("end"), (F.row_number().over(w) - 1).cast("long").alias("part"), F.lead("cut", 2).over(w).isNull().alias("last"))
    return rows.where(F.col("end").isNotNull() & (~F.col("last") | (F.col("end") - F.col("start") > least))).select("file_id", F.col("s").alias("span_start"), "part", "start", "end")


# ---------------------------------------------------------------- segments

SENTENCE_END = "[.?!…][\"')\\]»”’]*\\z"  # with closing quotes and brackets


def following(asked: DataFrame, events: DataFrame, keys: list[str], width: float = 600.0) -> DataFrame:
    """(keys, pos, to): of the events (keys, t, at) the first after each (keys, pos, q, tie), by t and then at: later than q, or at q with `at` above tie.

    Looked up within time bins; where a bin has none left, the next bin that has one is asked, of which there is one row each.
    """
    rows = asked.select(*keys, F.col("q").alias("t"), "tie", "pos", F.lit(None).cast("long").alias("at")).unionByName(events.select(*keys, "t", F.col("at").alias("tie"), F.lit(None).cast("long").alias("pos"), "at"))
    rows = rows.withColumn("bin", F.floor(F.col("t") / width))
    back = W.partitionBy(*keys, "bin").orderBy(F.desc("t"), F.desc("tie"), F.desc_nulls_first("at")).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.last("at", True).over(back)).where("pos is not null").select(*keys, "bin", "pos", "near")
    firsts = rows.groupBy(*keys, "bin").agg(F.min(F.when(F.col("at").isNotNull(), F.struct("t", "at")))["at"].alias("first"))
    later = firsts.select(*keys, "bin", F.last("first", True).over(W.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)).alias("later"))
    return inside.join(later, [*keys, "bin"]).select(*keys, "pos", F.coalesce("near", "later").alias("to"))


def build_segments(words: DataFrame, longest: float = 12.0, pause: float = 0.8, sentence: float = 3.0) -> DataFrame:
    """(file_id, stretch, part, start, end, speaker, text, n): segments of words (WIN-8), broken by another speaker, a pause, a sentence end after `sentence` seconds, or length.

    Never between two unclear words of which the second has no alternatives, as they share a marker. Speakers and pauses break whatever
    the segment holds, so they begin stretches. Within one, the word that begins a segment decides which begins the next: the first
    that would make it too long, or that follows a sentence end far enough from its start. Starts and ends never fall along a file.
    """
    w = W.partitionBy("file_id").orderBy("pos")
    inside = F.coalesce(F.col("unclear") & F.lag("unclear").over(w) & (F.coalesce(F.size("alternatives"), F.lit(0)) <= 0), F.lit(False))
    hard = (~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) | (F.col("start") - F.lag("end").over(w) >= pause)) & ~inside
    marked = islands(words.withColumn("_in", inside), ["file_id"], ["pos"], hard, "stretch")
    keys = ["file_id", "stretch"]
    own = W.partitionBy(*keys).orderBy("pos")
    base = settled(marked.select(*keys, F.col("pos").cast("long").alias("pos"), "start", "end", "speaker", "text", "_in", F.lag("end").over(own).alias("_end"), F.lag("text").over(own).alias("_text")))
    free = base.where(~F.col("_in"))
    too_long = free.select(*keys, F.col("end").alias("t"), F.col("pos").alias("at"))
    after_end = free.where(F.col("_text").rlike(SENTENCE_END)).select(*keys, F.col("_end").alias("t"), F.col("pos").alias("at"))
    none, far = F.lit((1 << 62)), F.col("start") + longest
    ask = lambda q, tie: base.select(*keys, "pos", F.greatest(q, F.col("end")).alias("q"), tie.cast("long").alias("tie"))
    by_length = following(ask(far, F.when(far >= F.col("end"), none).otherwise(F.col("pos"))), too_long, keys)
    by_sentence = following(ask(F.col("start") + sentence, F.col("pos")), after_end, keys)
    links = by_length.unionByName(by_sentence).groupBy(*keys, F.col("pos").alias("at")).agg(F.min("to").alias("to"))
    begins = reached(base.groupBy(*keys).agg(F.min("pos").alias("at")), links, keys)
    cut = base.join(begins.select(*keys, F.col("at").alias("pos"), F.lit(1).alias("_new")), [*keys, "pos"], "left")
    cut = cut.withColumn("part", F.count("_new").over(own) - 1)
    return cut.groupBy(*keys, "part").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.min_by("speaker", "pos").alias("speaker"), joined("text").alias("text"), F.count("*").alias("n"))
