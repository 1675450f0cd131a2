"""Two engines' words: alignment, spans, decisions and the fused words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.functions import edits, rules
from murmuration.functions import text as T
from murmuration.functions.normal import norm_token
from murmuration.operators import islands

KINDS = ("agree", "substitute", "a_only", "b_only")
WORD = ("text", "start", "end", "prob")
SLOTS = "pos long, kind string, a string, b string, pa double, pb double, a_start double, a_end double, b_start double, b_end double, blank boolean"


def slots_of(a: list[str | None], b: list[str | None], lang: str | None) -> list[tuple[int, int | None, int | None, bool]]:
    """(kind, place in a, place in b, blank) of one chunk's words (CMP-1).

    Words are compared by their normalized form. Words without letters or digits stay out of it: one of a comes back as
    an agreeing slot before the word that it preceded, with the blank of b in the same place; others of b go.
    """
    ka, kb = ([norm_token(w, lang) for w in side] for side in (a, b))
    real = [[i for i, k in enumerate(keys) if k] for keys in (ka, kb)]
    kinds, i, j = edits.align([ka[x] for x in real[0]], [kb[x] for x in real[1]])
    blanks: tuple[dict, dict] = (defaultdict(list), defaultdict(list))  # by the slot before which they stand
    for side, (keys, own, skip) in enumerate(((ka, i, edits.ONLY_B), (kb, j, edits.ONLY_A))):
        if len(real[side]) == len(keys):
            continue
        slot_of = {int(word): slot for slot, (word, k) in enumerate(zip(own, kinds)) if k != skip}
        before = 0
        for place, key in enumerate(keys):
            if key:
                before += 1
            else:
                blanks[side][slot_of.get(before, len(kinds))].append(place)
    out = []
    for slot, (k, x, y) in enumerate(zip([*kinds.tolist(), -1], [*i.tolist(), 0], [*j.tolist(), 0])):
        with_b = blanks[1].get(slot, [])
        for n, place in enumerate(blanks[0].get(slot, [])):
            out.append((edits.EQUAL, place, with_b[n] if n < len(with_b) else None, True))
        if k >= 0:
            out.append((k, None if k == edits.ONLY_B else real[0][x], None if k == edits.ONLY_A else real[1][y], False))
    return out


def align_engines(words: DataFrame, lang: str = "lang") -> DataFrame:
    """Slots of the two engines' words of each chunk, with texts, probabilities and times (CMP-1, J-9).

    A chunk that one engine lacks has one-sided slots. Words are listed per chunk by built-in aggregation; a chunk is
    some seconds of one file. Some thousand words are aligned at a time, and only their texts become Python objects. `lang` is a column, or absent for English.
    """
    fields = [F.col("pos"), *[F.col(c).cast("string" if c == "text" else "double").alias(c) if c in words.columns else F.lit(None).cast("double").alias(c) for c in WORD]]
    said = F.max(lang) if lang in words.columns else F.lit("en")
    side = lambda e: F.array_sort(F.collect_list(F.when(F.col("engine") == e, F.struct(*fields))))
    chunks = words.groupBy("file_id", "chunk").agg(said.alias("lang"), side("a").alias("a"), side("b").alias("b"))
    key = {c: words.schema[c].dataType for c in ("file_id", "chunk")}
    names = ["file_id", "chunk", *(x.split()[0] for x in SLOTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in edits.pieces(whole, "a", "b"):
                columns = [dict(zip(("pos", *WORD), b.column(x).flatten().flatten())) for x in "ab"]
                texts = [c["text"].to_pylist() for c in columns]
                sizes = [pc.list_value_length(b.column(x)).to_pylist() for x in "ab"]
                row, n, kind, at, blank = [], [], [], ([], []), []  # type: ignore[var-annotated]
                first = [0, 0]
                for r, la in enumerate(b.column("lang").to_pylist()):
                    ends = [first[x] + sizes[x][r] for x in (0, 1)]
                    slots = slots_of(texts[0][first[0] : ends[0]], texts[1][first[1] : ends[1]], la)
                    row += [r] * len(slots)
                    n += range(len(slots))
                    for k, x, y, empty in slots:
                        kind.append(k)
                        at[0].append(None if x is None else first[0] + x)
                        at[1].append(None if y is None else first[1] + y)
                        blank.append(empty)
                    first = ends
                rows, place = pa.array(row, pa.int64()), [pa.array(x, pa.int64()) for x in at]
                of = lambda x, c: columns[x][c].take(place[x])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    b.column("file_id").take(rows), b.column("chunk").take(rows), pa.array(n, pa.int64()), pa.array(KINDS).take(pa.array(kind, pa.int64())), of(0, "text"), of(1, "text"), of(0, "prob"), of(1, "prob"),
                    of(0, "start"), of(0, "end"), of(1, "start"), of(1, "end"), pa.array(blank, pa.bool_()),
                ], names=names)

    return chunks.mapInArrow(run, f"file_id {key['file_id'].simpleString()}, chunk {key['chunk'].simpleString()}, {SLOTS}")


def single_engine_slots(words: DataFrame, least: float = 0.5) -> DataFrame:
    """Slots of one engine (WIN-11): words under `least` are one-sided, others agree with nobody; group them with `forced`."""
    blank = ~F.col("text").rlike(r"[\p{L}\p{N}]")
    low = F.coalesce(F.col("prob") < least, F.lit(False)) & ~blank
    return words.select(
        "file_id", "chunk", "pos", F.when(low, "a_only").otherwise("agree").alias("kind"), F.col("text").alias("a"), F.lit(None).cast("string").alias("b"), F.col("prob").alias("pa"),
        F.lit(None).cast("double").alias("pb"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), *[F.lit(None).cast("double").alias(c) for c in ("b_start", "b_end")], blank.alias("blank"),
    )


def collapse_repetition(df: DataFrame, words: str = "words") -> DataFrame:
    """Arrays of words without loops (FN-13)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array([None if x is None else [x[i] for i in edits.collapse_loops(x)] for x in b.column(words).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([done if c == words else b.column(c) for c in names], names=names)

    return df.mapInArrow(run, df.schema)


def phrase_match(chunks: DataFrame, phrases: DataFrame, courtesy: DataFrame) -> DataFrame:
    """Chunks that are a known phrase, or one of 3 words or more with a courtesy word at either end (J-14)."""
    key = lambda c: F.array_join(F.filter(F.transform(F.split(F.lower(c), r"\s+"), T.strip_edges), lambda x: x != ""), " ")
    p = phrases.select(key(F.col("phrase")).alias("key"))
    long_ = p.where(F.size(F.split("key", " ")) >= 3).crossJoin(courtesy.select(F.lower("word").alias("w")))  # two fixed lists of tens of rows
    variants = p.unionByName(long_.select(F.concat_ws(" ", "w", "key").alias("key"))).unionByName(long_.select(F.concat_ws(" ", "key", "w").alias("key"))).distinct()
    return chunks.withColumn("key", key(F.col("text"))).join(variants, "key", "left_semi").drop("key")


def resolve(spans: DataFrame, picks: DataFrame, scores: DataFrame, margin: Column) -> DataFrame:
    """The decision of every span from its pick and its scores, which may be missing (CMP-3)."""
    met = spans.join(picks, ["file_id", "span_id"], "left").join(scores, ["file_id", "span_id"], "left")
    return met.withColumn("d", rules.decide(F.col("choice"), F.col("sa"), F.col("sb"), margin, F.lit("a"), F.col("guarded"))).select(*spans.columns, "d.*")


def span_texts(marked: DataFrame) -> DataFrame:
    """Tier, both sides' texts and the guarded empty side of every span of slots that carry span_id and tier."""
    side = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("t")))), lambda x: x["t"].isNotNull()), lambda x: x["t"]), " ")
    s = marked.groupBy("file_id", "span_id").agg(F.max("tier").alias("tier"), side("a").alias("text_a"), side("b").alias("text_b"))
    empty = F.when(F.col("text_a") == "", "a").when(F.col("text_b") == "", "b")
    return s.withColumn("guarded", F.when(F.col("tier") == "disputed", empty))


def fused_words(marked: DataFrame, picks: DataFrame, scores: DataFrame, margin: Column) -> DataFrame:
    """Words of the decided spans, in order (CMP-3).

    `marked` holds slots with span_id and tier (`islands.mark_spans`). Solid slots give the word of a, else of b. Of
    other spans the decided side's words are given; a span with nothing on either side, or an empty side that won, gives
    none. The other text is an alternative of the first word where the decision is unsure on scores.
    """
    texts = span_texts(marked)
    open_ = texts.where("tier != 'solid' and not (text_a = '' and text_b = '')")
    decided = resolve(open_, picks, scores, margin).join(scores.select("file_id", "span_id", (F.col("sa").isNotNull() & F.col("sb").isNotNull()).alias("scored")), ["file_id", "span_id"], "left")
    other = F.when(F.col("side") == "a", F.col("text_b")).otherwise(F.col("text_a"))
    choice = decided.select("file_id", "span_id", "side", "source", "unclear", "confidence", F.when(F.col("unclear") & F.coalesce("scored", F.lit(False)), F.array(other)).otherwise(F.array().cast("array<string>")).alias("alternatives"))
    met = marked.join(choice, ["file_id", "span_id"], "left")
    solid = F.col("tier") == "solid"
    side = F.when(solid, F.when(F.col("a").isNotNull(), "a").otherwise("b")).otherwise(F.col("side"))
    of = lambda name: F.when(F.col("side") == "a", F.col(f"a{name}")).when(F.col("side") == "b", F.col(f"b{name}"))
    words = met.withColumn("side", side).withColumns({"text": of(""), "start": of("_start"), "end": of("_end")}).where("text is not null")
    first = F.row_number().over(W.partitionBy("file_id", "span_id").orderBy("pos")) == 1
    no_text = F.array().cast("array<string>")
    out = words.select(
        "file_id", "chunk", "pos", "text", "start", "end", F.when(solid, "solid").when(F.col("unclear"), "unclear").otherwise("resolved").alias("tier"),
        F.when(solid, rules.word_confidence(F.col("kind"), F.col("pa"), F.col("pb"))).otherwise(F.col("confidence")).alias("confidence"), F.when(solid, "agree").otherwise(F.col("source")).alias("source"),
        F.when(~solid & first, F.coalesce("alternatives", no_text)).otherwise(no_text).alias("alternatives"), F.coalesce("unclear", F.lit(False)).alias("unclear"),
    )
    return out.withColumn("pos", F.row_number().over(W.partitionBy("file_id").orderBy("chunk", "pos")) - 1).drop("chunk")


def candidates(marked: DataFrame, lang: Column | None = None, batch: int = 15) -> DataFrame:
    """Spans to be picked (CMP-4): those whose sides read the same are `a` without asking; others are numbered in batches.

    `flipped` says that the sides are shown in the other order, by parity of a hash of the span.
    """
    key = lambda c: F.array_join(F.filter(F.transform(F.split(c, r"\s+"), lambda w: T.letters(w)), lambda w: w != ""), " ")
    s = span_texts(marked).where("tier != 'solid'").withColumn("choice", F.when(key("text_a") == key("text_b"), "a"))
    asked = W.partitionBy("file_id", F.col("choice").isNull()).orderBy("span_id")
    flip = F.pmod(F.xxhash64("file_id", "span_id"), F.lit(2)) == 1
    return s.withColumns({"batch": F.when(F.col("choice").isNull(), F.floor((F.row_number().over(asked) - 1) / batch)), "flipped": flip}).select(
        "file_id", "span_id", "choice", "batch", "flipped", F.when(flip, F.col("text_b")).otherwise(F.col("text_a")).alias("first"), F.when(flip, F.col("text_a")).otherwise(F.col("text_b")).alias("second")
    )


def picked(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers 1 and 2 as sides again; anything else, or no answer, is unclear (CMP-4)."""
    met = asked.join(answers.select("file_id", "span_id", "answer"), ["file_id", "span_id"], "left")
    one = F.when(F.col("flipped"), "b").otherwise("a")
    two = F.when(F.col("flipped"), "a").otherwise("b")
    return met.select("file_id", "span_id", F.coalesce("choice", F.when(F.col("answer") == "1", one).when(F.col("answer") == "2", two).otherwise("unclear")).alias("choice"))


def timing_agreement(slots: DataFrame, *keys: str) -> DataFrame:
    """Start differences of the words that both engines agree on: median, 90th percentile and count (AGG-22)."""
    gap = F.abs(F.col("a_start") - F.col("b_start"))
    both = slots.where((F.col("kind") == "agree") & ~F.col("blank") & gap.isNotNull())
    ends = F.percentile(gap, F.array(F.lit(0.5), F.lit(0.9)))
    return both.groupBy(*keys).agg(ends.alias("p"), F.count("*").alias("matched")).select(*keys, F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"), "matched")


def compose(records: DataFrame, keys: DataFrame, ladder: DataFrame) -> DataFrame:
    """Each item's record of the system that its profile key selects (J-15)."""
    chosen = keys.join(ladder, "key").select("id", "system")  # a row for each profile key
    return records.join(chosen, ["id", "system"])


def trust_features(words: DataFrame, flags: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """Agreement, share of unclear words and mean confidence of every file, 0 without words (AGG-13).

    With `flags` (file_id, engine, chunk, flagged) the share of flagged pairs; with `stages` (file_id, status) how many were skipped.
    """
    out = words.groupBy("file_id").agg(F.avg((F.col("source") == "agree").cast("double")).alias("agreement"), F.avg(F.col("unclear").cast("double")).alias("unclear_rate"), F.avg("confidence").alias("confidence"))
    if flags is not None:
        out = out.join(flags.groupBy("file_id").agg(F.avg(F.col("flagged").cast("double")).alias("flag_rate")), "file_id", "full_outer")
    if stages is not None:
        out = out.join(stages.groupBy("file_id").agg(F.count_if(F.col("status").startswith("skipped")).alias("skipped_stages")), "file_id", "full_outer")
    return out.na.fill(0)
