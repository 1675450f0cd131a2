"""Gaps and islands over ordered words, slots, labels and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, out: str = "island") -> DataFrame:
    """Numbers runs: a row where `new` holds (or the first) begins the next run, from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", (first | F.coalesce(new, F.lit(False))).cast("int")).withColumn(out, F.sum("_new").over(w) - 1).drop("_new")


def joined(value: str, order: str = "pos", by: str = " ") -> Column:
    """Values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), by)


def collapse_runs(df: DataFrame, keys: list[str], order: list[str], label: str, at: str) -> DataFrame:
    """Runs of one label: first and last place, size (WIN-5)."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = islands(df, keys, order, F.col(label) != F.lag(label).over(w), "run")
    return marked.groupBy(*keys, "run", label).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def collapse_labels(frames: DataFrame, vocab: DataFrame, repeat: int, blank: int = -1, seconds: float = 0.02) -> DataFrame:
    """Words of frame labels (WIN-5): a word for each run of one label, from its first frame to where the label changes, scored by the mean margin.

    Blank runs give none. The repeat label says the last word again, or nothing if there was none. `frames` holds (file_id, frame,
    label, margin), `vocab` (label, text).
    """
    w = W.partitionBy("file_id").orderBy("frame")
    marked = islands(frames, ["file_id"], ["frame"], F.col("label") != F.lag("label").over(w), "run")
    runs = marked.groupBy("file_id", "run", "label").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("z"), F.avg("margin").alias("score"))
    named = runs.join(vocab.select("label", "text"), "label", "left")  # a fixed vocabulary of some thousand words
    said = F.when((F.col("label") != repeat) & (F.col("label") != blank), F.col("text"))
    last = F.last(said, ignorenulls=True).over(W.partitionBy("file_id").orderBy("run"))
    out = named.withColumn("text", F.when(F.col("label") == repeat, last).otherwise(said)).where(F.col("text").isNotNull())
    return out.select("file_id", "run", "text", (F.col("a") * seconds).alias("start"), (F.col("z") * seconds).alias("end"), "score")


def unclear_runs(words: DataFrame) -> DataFrame:
    """Maximal runs of unclear words as (start_idx, end_idx exclusive) (WIN-12)."""
    runs = collapse_runs(words, ["file_id"], ["pos"], "unclear", "pos").where("unclear")
    return runs.select("file_id", F.col("first").alias("start_idx"), (F.col("last") + 1).alias("end_idx"))


def mark_spans(slots: DataFrame, least: float = 0.5, forced: bool = False) -> DataFrame:
    """Slots with the span that they are in and its tier (WIN-9): every solid slot alone, neighbours that aren't solid together.

    Solid: both engines agree and no known probability is under `least`; a blank always. Tier disputed with any substitute
    or unsure agreement, or `forced` (one engine, WIN-11), else missing. Ids count over the file by (chunk, pos).
    """
    low = F.least(F.coalesce("pa", F.lit(1.0)), F.coalesce("pb", F.lit(1.0))) < least
    if "blank" in slots.columns:
        low = low & ~F.col("blank")
    s = slots.withColumn("solid", (F.col("kind") == "agree") & ~low).withColumn("disputed", (F.col("kind") == "substitute") | ((F.col("kind") == "agree") & low) | F.lit(forced))
    w = W.partitionBy("file_id").orderBy("chunk", "pos")
    new = F.col("solid") | F.lag("solid").over(w) | (F.col("chunk") != F.lag("chunk").over(w))
    marked = islands(s, ["file_id"], ["chunk", "pos"], new, "span_id")
    own = W.partitionBy("file_id", "span_id")
    tier = F.when(F.bool_or("solid").over(own), "solid").when(F.bool_or("disputed").over(own), "disputed").otherwise("missing")
    return marked.withColumn("tier", tier).drop("solid", "disputed")


def group_spans(slots: DataFrame, least: float = 0.5, forced: bool = False) -> DataFrame:
    """Spans of slots, with their chunk, places and tier (WIN-9, WIN-11)."""
    return mark_spans(slots, least, forced).groupBy("file_id", "span_id").agg(F.min("chunk").alias("chunk"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("tier").alias("tier"))


def context(words: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """Up to k words before and after each, within the keys (WIN-10)."""
    w = W.partitionBy(*keys).orderBy("pos")
    around = lambda a, b: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), " ")
    return words.withColumns({"left_context": around(-k, -1), "right_context": around(1, k)})


def span_contexts(marked: DataFrame, k: int = 8) -> DataFrame:
    """Contexts of every span within its chunk: up to k words each side, where the first timed one begins and the last ends (WIN-10)."""
    word = F.struct(F.coalesce("a", "b").alias("t"), F.coalesce("a_start", "b_start").alias("s"), F.coalesce("a_end", "b_end").alias("e"))
    w = W.partitionBy("file_id", "chunk").orderBy("pos")
    near = marked.withColumns({"_l": F.collect_list(word).over(w.rowsBetween(-k, -1)), "_r": F.collect_list(word).over(w.rowsBetween(1, k))})
    ends = near.groupBy("file_id", "span_id").agg(F.min_by("_l", "pos").alias("l"), F.max_by("_r", "pos").alias("r"))
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), " ")
    timed = lambda c, f: F.filter(F.transform(c, lambda x: x[f]), lambda x: x.isNotNull())
    return ends.select("file_id", "span_id", texts("l").alias("left_context"), texts("r").alias("right_context"), F.try_element_at(timed("l", "s"), F.lit(1)).alias("left_start"), F.try_element_at(timed("r", "e"), F.lit(-1)).alias("right_end"))


def words_to_segments(words: DataFrame, most: int = 14, gap: float = 1.0, tail: float = 0.5) -> DataFrame:
    """Segments of words (WIN-7): broken by a pause between starts, after . or ?, and at `most` words.

    The count starts anew at every other break, so it is a division of the place within the island.
    A segment ends at the next word's start but at most `gap + tail` after its last word's, or `tail` after the last word of all.
    """
    w = W.partitionBy("file_id").orderBy("pos")
    pause = (F.col("start") - F.lag("start").over(w) > gap) | F.lag("text").over(w).rlike(r"[.?]$")
    marked = islands(words.withColumn("_next", F.lead("start").over(w)), ["file_id"], ["pos"], pause)
    inside = W.partitionBy("file_id", "island").orderBy("pos")
    marked = marked.withColumn("part", F.floor((F.row_number().over(inside) - 1) / most))
    seg = marked.groupBy("file_id", "island", "part").agg(
        F.min("start").alias("start"), F.max_by(F.struct("start", "_next"), "pos").alias("_last"), joined("text").alias("text"), F.count("*").alias("n_words")
    )
    ends = F.when(F.col("_last._next").isNotNull(), F.least("_last._next", F.col("_last.start") + gap + tail)).otherwise(F.col("_last.start") + tail)
    return seg.select("file_id", "island", "part", F.bround("start", 3).alias("start"), F.bround(F.greatest(ends, F.col("_last.start") + 0.04), 3).alias("end"), "text", "n_words")


def words_from_tokens(tokens: DataFrame) -> DataFrame:
    """Words of sub-word tokens (WIN-21): a leading space or the first token starts a word; probability is the least known."""
    starts = islands(tokens, ["file_id", "chunk"], ["pos"], F.col("text").startswith(" "), "word")
    out = starts.groupBy("file_id", "chunk", "word").agg(
        F.trim(joined("text", by="")).alias("text"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("confidence").alias("prob")
    )
    return out.where("text != ''")


def batches(segments: DataFrame, size: int = 60, before: int = 5) -> DataFrame:
    """Batches of segments with the texts just before each (WIN-13)."""
    w = W.partitionBy("file_id").orderBy("pos")
    lead = F.array_join(F.collect_list("text").over(w.rowsBetween(-before, -1)), " | ")
    numbered = segments.withColumns({"_rn": F.row_number().over(w) - 1, "_lead": lead}).withColumn("batch", F.floor(F.col("_rn") / size))
    return numbered.groupBy("file_id", "batch").agg(F.count("*").alias("n"), F.min_by("_lead", "pos").alias("context"))


def window_places(samples: DataFrame, size: float = 20.0, step: float = 18.0, trim: float = 1.0) -> DataFrame:
    """The window that keeps each place (WIN-6): windows start at multiples of step; inner ones drop `trim` at both ends.

    `n` is the file's length. A place in two windows' overlap belongs to the one whose kept zone has it, so each is kept once.
    """
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / step))
    guess = F.floor((F.col("at") - trim) / step)
    return samples.withColumn("window", F.greatest(F.lit(0), F.least(guess, count - 1)).cast("long")).withColumn("window_start", F.col("window") * step)


def renumber_speakers(turns: DataFrame) -> DataFrame:
    """Speakers as 1, 2, ... by first appearance (WIN-20)."""
    first = turns.groupBy("file_id", "speaker").agg(F.min("pos").alias("_first"))
    named = first.withColumn("number", F.row_number().over(W.partitionBy("file_id").orderBy("_first", "speaker")).cast("string")).drop("_first")
    return turns.join(named, ["file_id", "speaker"])


def spread_words(segments: DataFrame) -> DataFrame:
    """Word times in proportion to characters; contiguous, the last ends with the segment (WIN-19)."""
    words = segments.select("file_id", "pos", "start", "end", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "word"))
    w = W.partitionBy("file_id", "pos").orderBy("i")
    size = words.withColumns({"_c": F.sum(F.length("word")).over(w), "_t": F.sum(F.length("word")).over(W.partitionBy("file_id", "pos"))})
    at = lambda c: F.col("start") + (F.col("end") - F.col("start")) * c / F.col("_t")
    return size.select("file_id", "pos", "i", "word", at(F.col("_c") - F.length("word")).alias("start"), at(F.col("_c")).alias("end"))


def longform(utterances: DataFrame, target: float, gap: float = 0.6) -> DataFrame:
    """Utterances placed one after another with gaps until the target is crossed (WIN-16, TOP-4)."""
    w = W.partitionBy("group_id").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    placed = utterances.withColumn("start", F.coalesce(F.sum(F.col("seconds") + gap).over(w), F.lit(0.0)))
    return placed.where(F.col("start") < target).withColumn("end", F.col("start") + F.col("seconds"))


def longform_references(placed: DataFrame) -> DataFrame:
    """(group_id, reference, duration) of placed utterances: their texts without doubled spaces, in order (WIN-16)."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    listed = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"] != ""), lambda x: x["t"])
    return placed.groupBy("group_id").agg(F.array_join(listed, " ").alias("reference"), F.bround(F.max("end"), 3).alias("duration"))


def conversation_blocks(utts: DataFrame, target: float | None = None) -> DataFrame:
    """Runs of one conversation and the seconds from each utterance to its run's end (WIN-18).

    Without `block_key` the first nine characters of the speaker name the conversation; without `seconds` they are
    estimated from the text, none for marked rows. With `target` a row is a valid start if 1.3 times it lies ahead.
    """
    if "block_key" not in utts.columns:
        utts = utts.withColumn("block_key", F.substring("speaker", 1, 9))
    if "seconds" not in utts.columns:
        utts = utts.withColumn("seconds", F.when(F.instr("text", "IGNORE_TIME_SEGMENT") > 0, 0.0).otherwise(F.length("text") / 14 + 0.4))
    w = W.partitionBy("corpus").orderBy("rn")
    marked = islands(utts, ["corpus"], ["rn"], F.col("block_key") != F.lag("block_key").over(w), "block")
    ahead = W.partitionBy("corpus", "block").orderBy(F.desc("rn")).rowsBetween(W.unboundedPreceding, 0)
    out = marked.withColumn("ahead", F.sum("seconds").over(ahead))
    return out if target is None else out.withColumn("valid_start", F.col("ahead") >= 1.3 * target)


def ghosts_at_end(words: DataFrame, least: float = 0.15) -> DataFrame:
    """Words after the last one that is inside speech and likely enough (FN-15)."""
    w = W.partitionBy("file_id", "chunk")
    real = F.max(F.when(F.col("inside") & (F.coalesce("prob", F.lit(1.0)) >= least), F.col("pos"))).over(w)
    return words.withColumn("_real", real).where(F.col("_real").isNull() | (F.col("pos") > F.col("_real"))).drop("_real")
