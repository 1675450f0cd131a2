"""Doubtful words of a transcript: finding them, gating proposed rewrites, applying those that pass."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.functions import sounds
from murmuration.functions import text as T
from murmuration.operators import islands, matching
from murmuration.operators.signal import bound

#: Fillers that a rewrite may not drop and pronouns that it may not put in.
FILLERS = {"en": ("um", "uh", "like", "you know", "so", "right", "i mean"), "es": ("eh", "este", "o sea", "pues", "bueno", "¿no?")}
PRONOUNS = {"en": frozenset("it they them this that he she".split()), "es": frozenset("lo la eso esto él ella ellos".split())}
NEAR, FAR, LOW, LONGEST, CONTEXT = 0.35, 0.4, 0.5, 3, 8
MARGIN, TERM_MARGIN, ACCEPTED = 0.05, -0.10, 0.6


def plain(text: Column) -> Column:
    """Lower-cased words without punctuation, by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)([\w']+)"), F.lit(1)), " ")


def filler_counts(text: Column, lang: str) -> list[Column]:
    """How often each filler of the language stands alone; words of one may be parted by commas and stops (FN-27)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = lambda f: r"(?U)(?<!\w)¿?no\?" if f == "¿no?" else r"(?U)(?<![\w'])" + r"[\s,.]+".join(map(re.escape, f.split())) + r"(?![\w'])"
    return [F.regexp_count(low, F.lit(pattern(f))) for f in FILLERS.get(lang, ())]


# ---------------------------------------------------------------- targets


def grams(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Runs of 1 to `longest` words of each file: (file_id, start_idx, end_idx, gram, touched), touched if any is unclear."""
    w = W.partitionBy("file_id").orderBy("pos")
    base = words.select("file_id", "pos", plain(F.col("text")).alias("t"), "unclear")
    ahead = [F.struct(F.lead("t", k).over(w).alias("t"), F.lead("unclear", k).over(w).alias("u")) for k in range(1, longest)]
    near = base.select("file_id", "pos", F.array(F.struct("t", F.col("unclear").alias("u")), *ahead).alias("x"))
    runs = near.select("file_id", F.col("pos").alias("start_idx"), "x", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.element_at("x", F.col("n"))["t"].isNotNull())
    own = F.slice("x", 1, F.col("n"))
    return runs.select(
        "file_id", "start_idx", (F.col("start_idx") + F.col("n")).alias("end_idx"),
        F.array_join(F.transform(own, lambda x: x["t"]), " ").alias("gram"), F.exists(own, lambda x: x["u"]).alias("touched"),
    )


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, " ", ""))


def _near_among_few(words: DataFrame, terms: DataFrame, lang: str) -> DataFrame:
    """(file_id, start_idx, end_idx, distance) of runs near a term that no run equal to one touches, in files with few terms (file_id, term, t_n, t_s).

    A run's sound is that of its words. Runs meet the list of their file's terms, by file as the windows over words are, so that only
    what is near or equal leaves a task.
    """
    w = W.partitionBy("file_id").orderBy("pos")
    size = F.length("t_s")
    listed = terms.groupBy("file_id").agg(F.collect_list(F.struct("t_n", "t_s", size.alias("l"))).alias("_terms"), F.collect_list("term").alias("_names"), F.min(size).alias("_shortest"), F.max(size).alias("_longest"))
    base = words.select("file_id", "pos", plain(F.col("text")).alias("t"), F.col("unclear").alias("u"))
    base = base.withColumns({"n": letters(F.col("t")), "s": F.replace(sounds.phonemes(F.col("t"), F.lit(lang)), F.lit(" "))})
    word = F.struct("t", "u", "n", "s")
    met = base.select("file_id", "pos", word.alias("x0"), *[F.lead(word, k).over(w).alias(f"x{k}") for k in range(1, LONGEST)]).join(listed, "file_id")
    sizes = range(1, LONGEST + 1)
    own = {k: [F.col(f"x{i}") for i in range(k)] for k in sizes}
    met = met.withColumns({f"n{k}": reduce(Column.__add__, [x["n"] for x in own[k]]) for k in sizes} | {f"s{k}": F.concat(*[x["s"] for x in own[k]]) for k in sizes})
    met = met.withColumns({f"l{k}": F.length(f"s{k}") for k in sizes})

    def distance(k: int) -> Column:
        n, size = F.col(f"n{k}"), F.col(f"l{k}")
        fits = lambda t: (F.least(n, t["t_n"]) >= 0.4 * F.greatest(n, t["t_n"])) & (F.abs(size - t["l"]) <= NEAR * F.greatest(size, t["l"]) + 1e-9)
        least = F.array_min(F.transform(F.filter("_terms", fits), lambda t: sounds.sound_distance(F.col(f"s{k}"), t["t_s"])))
        clear = ~reduce(Column.__or__, [x["u"] for x in own[k]])
        return F.when(clear & (n >= 3) & size.between(F.col("_shortest") * (1 - NEAR) - 1e-6, F.col("_longest") / (1 - NEAR) + 1e-6), least)

    exact = [F.when(F.col(f"x{k - 1}").isNotNull() & F.array_contains("_names", F.concat_ws(" ", *[x["t"] for x in own[k]])), k) for k in reversed(sizes)]
    told = met.select("file_id", "pos", F.coalesce(*exact).alias("exact"), F.array(*[F.struct(F.lit(k).alias("k"), distance(k).alias("distance")) for k in sizes]).alias("near"))
    hits = told.withColumn("near", F.filter("near", lambda r: r["distance"] <= NEAR)).where((F.size("near") > 0) | F.col("exact").isNotNull())
    before = F.max(F.col("pos") + F.col("exact")).over(w.rangeBetween(1 - LONGEST, 0))
    after = F.min(F.when(F.col("exact").isNotNull(), F.col("pos"))).over(w.rangeBetween(1, LONGEST - 1))
    free = hits.withColumns({"_b": before, "_a": after}).where(F.col("_b").isNull() | (F.col("_b") <= F.col("pos"))).select("file_id", F.col("pos").alias("start_idx"), "_a", F.explode("near").alias("r"))
    far = free.select("file_id", "start_idx", (F.col("start_idx") + F.col("r.k")).alias("end_idx"), F.col("r.distance").alias("distance"), "_a")
    return far.where(F.col("_a").isNull() | (F.col("_a") >= F.col("end_idx"))).drop("_a")


def _near_among_many(words: DataFrame, terms: DataFrame, lang: str) -> DataFrame:
    """The same where files have any number of terms: distinct sounds of a file's runs meet those of its terms by shared segments."""
    g = grams(words)
    exact = g.join(terms.select("file_id", F.col("term").alias("gram")), ["file_id", "gram"], "left_semi").select("file_id", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("pos")).distinct()
    free = g.where(~F.col("touched") & (letters(F.col("gram")) >= 3)).select("file_id", "start_idx", "end_idx", "gram")
    covered = free.select("file_id", "start_idx", "end_idx", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("pos")).join(exact, ["file_id", "pos"], "left_semi")
    free = free.join(covered.select("file_id", "start_idx", "end_idx").distinct(), ["file_id", "start_idx", "end_idx"], "left_anti")
    heard = free.withColumns({"g_n": letters(F.col("gram")), "g_s": sounds.phonemes(F.col("gram"), F.lit(lang))})
    met = matching.near_sounds(heard.select("file_id", "g_n", "g_s").distinct(), terms.select("file_id", "t_n", "t_s").distinct(), ["file_id"], NEAR)
    near = met.where(F.least("g_n", "t_n") >= 0.4 * F.greatest("g_n", "t_n")).groupBy("file_id", "g_n", "g_s").agg(F.min("distance").alias("distance"))
    return heard.join(near, ["file_id", "g_n", "g_s"]).select("file_id", "start_idx", "end_idx", "distance")


def term_near(words: DataFrame, terms: DataFrame, lang: str) -> DataFrame:
    """Runs of words that sound like a term of their file (J-10), best first, without overlaps: (file_id, start_idx, end_idx).

    Runs with an unclear word, or within a term as it is written, are left out; both sides have three letters or more
    and the shorter at least 0.4 of the longer's. Runs meet a file's terms at once where those are at most FEW, else by segments of their sounds;
    candidates are chosen in order of (distance, longer first, place).
    """
    t = terms.select("file_id", plain(F.col("term")).alias("term")).where(letters(F.col("term")) >= 3).distinct()
    t = matching.settled(t.withColumns({"t_n": letters(F.col("term")), "t_s": F.replace(sounds.phonemes(F.col("term"), F.lit(lang)), F.lit(" "))}))
    many = t.groupBy("file_id").agg(F.count("*").alias("_n")).where(F.col("_n") > matching.FEW).select("file_id")
    if many.isEmpty():
        far = _near_among_few(words, t, lang)
    else:
        far = _near_among_few(words, t.join(many, "file_id", "left_anti"), lang).unionByName(_near_among_many(words.join(many, "file_id", "left_semi"), t.join(many, "file_id", "left_semi"), lang))
    return matching.choose_apart(far, ["file_id"], [F.col("distance"), F.col("start_idx") - F.col("end_idx")])


def in_spans(words: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """Words with start_idx, end_idx and what is to be kept of the span that they are in, else nulls. Spans of a file don't overlap.

    Words and spans are united and swept by file in order of place: words move once, and no row is made for each place of a span.
    """
    held = ["start_idx", "end_idx", *keep]
    marks = spans.select("file_id", F.col("start_idx").alias("pos"), F.lit(0).alias("_kind"), F.struct(*held).alias("_span"))
    both = words.withColumns({"_kind": F.lit(1), "_span": F.lit(None).cast(marks.schema["_span"].dataType)}).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy("file_id").orderBy("pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    swept = both.withColumn("_held", F.last("_span", ignorenulls=True).over(w)).where("_kind = 1")
    return swept.select(*words.columns, *[F.when(F.col("pos") < F.col("_held.end_idx"), F.col("_held")[c]).alias(c) for c in held])


def refine_targets(words: DataFrame, terms: DataFrame, lang: str) -> DataFrame:
    """Doubtful spans in order of place, numbered from 0 (CMP-5): unclear runs, runs near a term, agreed words of low confidence.

    Each with its text, the first unclear word's alternatives, and up to eight words of the file on either side.
    """
    no_text = F.array().cast("array<string>")
    unclear = islands.unclear_runs(words).withColumn("reason", F.lit("unclear"))
    near = term_near(words, terms, lang).withColumn("reason", F.lit("term_near"))
    w = W.partitionBy("file_id").orderBy("pos")
    around = in_spans(words, unclear.unionByName(near), ["reason"]).withColumns({
        "alternatives": F.coalesce("alternatives", no_text),
        "left": F.array_join(F.collect_list("text").over(w.rowsBetween(-CONTEXT, -1)), " "), "left_start": F.first("start").over(w.rowsBetween(-CONTEXT, 0)),
        "right": F.array_join(F.collect_list("text").over(w.rowsBetween(1, CONTEXT)), " "), "right_end": F.last("end").over(w.rowsBetween(0, CONTEXT)),
    })
    low = F.col("reason").isNull() & (F.col("source") == "agree") & (F.col("confidence") < LOW)
    inside = around.withColumns({
        "start_idx": F.when(low, F.col("pos")).otherwise(F.col("start_idx")), "end_idx": F.when(low, F.col("pos") + 1).otherwise(F.col("end_idx")), "reason": F.when(low, "low_conf_agree").otherwise(F.col("reason")),
    }).where("reason is not null")
    rows = inside.groupBy("file_id", "start_idx", "end_idx", "reason").agg(
        islands.joined("text").alias("text"), F.min_by("alternatives", "pos").alias("alternatives"), F.min_by("left", "pos").alias("left"), F.max_by("right", "pos").alias("right"),
        F.min_by("left_start", "pos").alias("left_start"), F.max_by("right_end", "pos").alias("right_end"), F.min("start").alias("start"), F.max("end").alias("end"),
    )
    rows = rows.withColumn("alternatives", F.when(F.col("reason") == "unclear", F.col("alternatives")).otherwise(no_text))
    return rows.withColumn("target_id", F.row_number().over(W.partitionBy("file_id").orderBy("start_idx")) - 1)


# ---------------------------------------------------------------- gates


def near_any(runs: Column, term: Column) -> Column:
    """Whether one of the runs (text, sound) is the term or sounds like it."""
    return F.exists(runs, lambda g: (g["t"] == term["t"]) | (sounds.sound_distance(g["s"], term["s"]) <= NEAR))


def heard_as(texts: Column, lang: str) -> Column:
    """Texts with their sounds: structs t, s."""
    return F.transform(texts, lambda x: F.struct(x.alias("t"), sounds.phonemes(x, F.lit(lang)).alias("s")))


def known_terms(terms: Column, lang: str) -> Column:
    """Terms by plain words, with their sounds; those without words go."""
    return F.filter(heard_as(F.transform(terms, plain), lang), lambda t: t["t"] != "")


def term_match(text: Column, alternatives: Column, replacement: Column, known: Column, lang: str) -> Column:
    """Whether a rewrite turns what sounds like a term (of `known_terms`) into it: the term is near a run that is new, and near one of the original or its
    alternatives. The original's sounds are found out only for terms that are near what is new."""
    runs = lambda c: F.filter(T.ngrams(F.split(plain(c), " "), LONGEST), lambda x: x != "")
    old = runs(text)
    heard = F.flatten(F.transform(F.coalesce(alternatives, F.array().cast("array<string>")), lambda x: runs(x)))
    some = lambda c, body: F.when(F.size(c) == 0, F.lit(False)).otherwise(body)
    return some(known, bound(old, lambda o: bound(F.array_except(runs(replacement), o), lambda fresh: some(fresh, bound(heard_as(fresh, lang), lambda new: bound(
        F.filter(known, lambda t: near_any(new, t)), lambda k: some(k, bound(heard_as(F.array_union(o, heard), lang), lambda source: F.exists(k, lambda t: near_any(source, t))))))))))


def swaps_in_pronoun(old: str, new: str, lang: str) -> bool:
    """Whether words that aren't pronouns give way to a pronoun."""
    known = PRONOUNS.get(lang, frozenset())
    a, b = (re.findall(r"[\w']+", x.lower()) for x in (old, new))
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    ends = [(0, 0), *((m.a + m.size, m.b + m.size) for m in blocks)]
    return any(known.intersection(b[y : m.b]) and not known.issuperset(a[x : m.a]) for (x, y), m in zip(ends, blocks))


def gate_edits(edits: DataFrame, lang: str) -> DataFrame:
    """Adds term_match and gate, the first gate that an edit fails, else null (FN-17).

    `edits` holds text, alternatives, replacement, reason and terms (an array), and may hold `known`, what `known_terms` makes of them. In order: empty, length (more than a fifth of
    the words, at least one), phonetic (sounds like neither the text nor an alternative), filler_removed, pronoun_swap, locked.
    """
    if "known" not in edits.columns:
        edits = edits.withColumn("known", known_terms(F.col("terms"), lang))
    names = edits.columns

    def pronouns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [swaps_in_pronoun(o or "", n or "", lang) for o, n in zip(b.column("text").to_pylist(), b.column("replacement").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, pa.bool_())], names=[*names, "_swap"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edits.schema)
    rows = edits.mapInArrow(pronouns, f"{ddl}, _swap boolean")
    old, new = F.coalesce("text", F.lit("")), T.squeeze(F.col("replacement"))
    n_old, n_new = F.size(T.tokens(old)), F.size(T.tokens(new))
    sound = lambda c: sounds.phonemes(plain(c), F.lit(lang))
    said = F.concat(F.array(old), F.filter(F.coalesce("alternatives", F.array().cast("array<string>")), lambda x: x != ""))
    rows = rows.withColumn("term_match", F.coalesce(term_match(old, F.col("alternatives"), new, F.col("known"), lang), F.lit(False)))
    far = bound(sound(new), lambda now: F.forall(said, lambda x: sounds.sound_distance(now, sound(x)) > FAR))
    fewer = F.lit(False)
    for a, b in zip(filler_counts(old, lang), filler_counts(new, lang)):
        fewer = fewer | (a > b)
    gate = (
        F.when(new == "", "empty").when(F.abs(n_new - n_old) > F.greatest(F.lit(1), F.floor(0.2 * n_old + 1e-9)), "length").when(~F.col("term_match") & far, "phonetic")
        .when(fewer, "filler_removed").when(F.col("_swap"), "pronoun_swap").when((F.col("reason") == "low_conf_agree") & ~F.col("term_match"), "locked")
    )
    return rows.withColumn("gate", gate).drop("_swap", "known")


def judged(targets: DataFrame, proposals: DataFrame, terms: DataFrame, lang: str, scores: DataFrame | None = None) -> DataFrame:
    """The first proposal of every target, and its verdict: accepted, gate:<name>, audio, unverifiable or no_audio_check (CMP-6).

    `proposals` holds (file_id, target_id, n, replacement), the first by n counts; one that changes nothing is left out.
    `scores` holds (file_id, target_id, original, replaced): a rewrite has to score 0.05 more, one to a term 0.10 less at
    most. Without scores only rewrites to a term pass.
    """
    keys = ["file_id", "target_id"]
    first = proposals.groupBy(*keys).agg(T.squeeze(F.min_by("replacement", "n")).alias("replacement"))
    met = targets.join(first, keys).where(F.col("replacement") != T.squeeze(F.col("text")))
    if scores is not None:
        met = met.join(scores.select(*keys, "original", "replaced"), keys, "left")  # by the same keys, so before the terms
    listed = terms.groupBy("file_id").agg(F.collect_set("term").alias("terms"))
    listed = listed.withColumn("known", known_terms(F.col("terms"), lang))  # once for a file, not for each of its targets
    none = {c: F.coalesce(c, F.array().cast(listed.schema[c].dataType)) for c in ("terms", "known")}
    gated = gate_edits(met.join(listed, "file_id", "left").withColumns(none), lang)
    failed = F.when(F.col("gate").isNotNull(), F.concat(F.lit("gate:"), "gate"))
    if scores is None:
        return gated.withColumn("verdict", failed.when(F.col("term_match"), "accepted").otherwise("no_audio_check"))
    sure = F.col("original").isNotNull() & F.col("replaced").isNotNull() & ~F.isnan("original") & ~F.isnan("replaced")
    margin = F.when(F.col("term_match"), TERM_MARGIN).otherwise(MARGIN)
    return gated.withColumn("verdict", failed.when(~sure, "unverifiable").when(F.col("replaced") >= F.col("original") + margin, "accepted").otherwise("audio"))


def apply_edits(words: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Words with the accepted rewrites in place (CMP-6): their times are spread by characters over the span; numbered anew."""
    done = verdicts.where("verdict = 'accepted'").select("file_id", "start_idx", "end_idx", "replacement")
    held = in_spans(words, done, ["replacement"])
    spans = held.where("start_idx is not null").groupBy("file_id", "start_idx", "replacement").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.min_by("speaker", "pos").alias("speaker"))
    new = islands.spread_words(spans.select("file_id", F.col("start_idx").alias("pos"), "start", "end", F.col("replacement").alias("text")))
    new = new.join(spans.select("file_id", F.col("start_idx").alias("pos"), "speaker"), ["file_id", "pos"])
    no_text = F.array().cast("array<string>")
    added = new.select("file_id", "pos", "i", F.col("word").alias("text"), "start", "end", F.lit("resolved").alias("tier"), F.lit(ACCEPTED).alias("confidence"), F.lit("refine").alias("source"), no_text.alias("alternatives"), F.lit(False).alias("unclear"), "speaker")
    kept = held.where("start_idx is null").withColumn("i", F.lit(0)).select(added.columns)
    return kept.unionByName(added).withColumn("pos", F.row_number().over(W.partitionBy("file_id").orderBy("pos", "i")) - 1).drop("i")
