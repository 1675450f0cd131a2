"""Grading, guarding and refining transcripts, deciding profiles, choosing what goes into a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import edits, parsing, sounds
from murmuration.functions import text as T
from murmuration.jobs.domain import SEGMENTS, WORDS, duck_table, spark_table
from murmuration.jobs.evaluation import hypotheses, rounded
from murmuration.jobs.fusion import engines
from murmuration.operators import corpus, fusion, guards, intervals, islands, matching, metrics, profiles, refining, scoring, selection

S, Wd = duck_table(SEGMENTS), duck_table(WORDS)


def segments(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, SEGMENTS)


def words(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, WORDS)


# ---------------------------------------------------------------- records


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an item and two systems' outputs, every sixth word flagged; one system doesn't speak French and is asked for none."""
    h = hypotheses(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("slice"), "lang", F.col("text").alias("ref"))
    items = docs.withColumns({"duration": F.length("ref") / 14, "split": T.assign_split(F.col("id"))})
    systems = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "one").otherwise("two").alias("system"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("en"), F.lit("es"), F.lit("de"))).alias("langs"))
    said = F.transform(T.tokens(F.col("hyp")), lambda x, i: F.struct(x.alias("text"), (i % 6 == 0).alias("unclear")))
    outputs = h.select("system", F.col("id").cast("string").alias("id"), F.col("hyp").alias("text"), said.alias("words"), F.lit(None).cast("string").alias("error"))
    return scoring.score_items(scoring.with_language_support(items, systems).where("skipped is null"), outputs)


def score_items(spark: SparkSession, d: str) -> DataFrame:
    sums = ["sub", "del", "ins", "hits", "words", "char_errors", "chars", "entities", "missed", "flagged", "flagged_errors", "errors", "hyp_words"]
    r = graded(spark, d)
    return r.groupBy("lang", "system").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], F.round(F.avg("wer"), 6).alias("mean_wer"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.avg("ins_per_min"), 6).alias("ins_per_min"))


def skipped_languages(spark: SparkSession, d: str) -> DataFrame:
    """How many items of each language every system is asked for and skips (PRJ-4)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang")
    systems = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("system"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("en"), F.lit("es"))).alias("langs"))
    return scoring.with_language_support(docs, systems).groupBy("system", "lang").agg(F.count("*").alias("items"), F.count("skipped").alias("skipped"))


def stage_changes(spark: SparkSession, d: str) -> DataFrame:
    """What each stage of an item changed against the one before; five turns of a conversation are an item's stages (CMP-9)."""
    stage = F.element_at(F.array(*map(F.lit, ("pick", "refine", "fused", "verify", "other"))), (F.col("pos") % 5 + 1).cast("int"))
    item = F.concat_ws("-", F.col("file_id").cast("string"), F.floor(F.col("pos") / 5).cast("string"))
    rows = segments(spark, d).select(F.lit("s").alias("system"), item.alias("id"), stage.alias("stage"), "text")
    return scoring.stage_edits(rows).select("id", "stage", F.length("before").alias("before"), F.length("after").alias("after"))


STAGES_SQL = f"""
WITH s AS (SELECT concat(file_id, '-', pos // 5) AS id, (['pick', 'refine', 'fused', 'verify', 'other'])[pos % 5 + 1] AS stage, ([2, 4, 1, 3, 0])[pos % 5 + 1] AS n, length(text) AS size FROM {S})
SELECT id, stage, lag(size) OVER (PARTITION BY id ORDER BY n) AS before, size AS after FROM s WHERE n > 0 QUALIFY before IS NOT NULL
"""


def ladder(spark: SparkSession, d: str) -> DataFrame:
    """Line items as records of six systems over parts, those of a seventh line as another system that no profile uses; a part in ten says nothing and counts for all keys."""
    system = F.element_at(F.array(*map(F.lit, (*profiles.SINGLES, *profiles.CHAIN, "other"))), F.col("l_linenumber"))
    silent = F.col("l_partkey") % 10 == 0
    l = spark.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    key = F.when(silent, "*").when(F.col("l_partkey") % 3 == 0, "en").when(F.col("l_partkey") % 3 == 1, "es").otherwise("other")
    q = F.col("l_quantity").cast("double")
    rows = l.select(key.alias("key"), F.col("l_partkey").cast("string").alias("id"), system.alias("system"), silent.alias("empty_ref"), F.when(~silent, (q - F.col("l_linenumber") * 2) / 500).alias("wer"), (q % 7).alias("ins"), (q + 5).alias("duration"), (q % 5).cast("long").alias("q"))
    return rows.groupBy("key", "id", "system").agg(F.max("empty_ref").alias("empty_ref"), F.avg("wer").alias("wer"), F.sum("ins").alias("ins"), F.sum("duration").alias("duration"), F.sum("q").alias("help"), (F.max("q") == 4).cast("long").alias("harm"), F.count("*").alias("neutral"))


def decided(spark: SparkSession, d: str) -> DataFrame:
    r = matching.settled(ladder(spark, d))  # read some ten times
    return profiles.decide_profiles(r.drop("help", "harm", "neutral"), r.where("key != '*'").select("key", "id", "system", "help", "harm", "neutral"))


def chain_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of the ladder's rungs on the parts that all of them have (J-7, SET-2)."""
    spoken = ladder(spark, d).where("wer is not null")
    return profiles.comparable(spoken, profiles.chain_of(spoken)).groupBy("key", "system").agg(F.count("*").alias("n"), F.round(F.avg("wer"), 6).alias("mean"))


CHAIN_SQL = """
WITH l AS (SELECT l_partkey AS id, l_linenumber - 2 AS rank, CASE l_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'other' END AS key, avg((CAST(l_quantity AS DOUBLE) - l_linenumber * 2) / 500) AS wer FROM lineitem WHERE l_linenumber BETWEEN 3 AND 6 AND l_partkey % 10 != 0 GROUP BY ALL),
k AS (SELECT key, id FROM l GROUP BY 1, 2 HAVING count(*) = 4)
SELECT key, (['fused', '+pick', '+verify', '+refine'])[rank] AS system, count(*) AS n, round(avg(wer), 6) AS mean FROM l SEMI JOIN k USING (key, id) GROUP BY 1, 2
"""

# ---------------------------------------------------------------- guards and rewrites


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks: some are stock phrases, some end in a credit or in a loop."""
    n, text = F.col("pos"), F.regexp_replace(F.trim(F.col("text")), r"\s+", " ")
    said = (
        F.when(n % 7 == 3, "Thanks for watching everyone!").when(n % 7 == 5, F.concat(text, F.lit(" Subtítulos realizados por la comunidad de Amara.org")))
        .when(n % 7 == 6, F.concat(text, F.lit(" loopword"), F.repeat(F.lit(" loopword"), 11))).otherwise(text)
    )
    s = segments(spark, d).select("file_id", F.col("pos").alias("chunk"), said.alias("text"), "start", "end")
    return s.select("file_id", "chunk", F.posexplode(F.split("text", " ")).alias("pos", "text"), "start", "end").withColumn("prob", F.lit(0.9))


def guard_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words that stay in every chunk, and the flags (CMP-2). Every eleventh chunk is silent."""
    chunks = segments(spark, d).select("file_id", F.col("pos").alias("chunk"), "start", "end", F.when(F.col("pos") % 11 == 4, 0.0001).otherwise(0.1).alias("rms"))
    kept, flags = guards.apply_guards(chunk_words(spark, d), chunks)
    n = kept.groupBy("file_id", "chunk").agg(F.count("*").alias("kept"))
    f = flags.groupBy("file_id", "chunk").agg(F.array_join(F.array_sort(F.collect_list("flag")), ",").alias("flags"))
    both = chunks.select("file_id", "chunk").join(n, ["file_id", "chunk"], "left").join(f, ["file_id", "chunk"], "left")
    return both.select("file_id", "chunk", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("flags", F.lit("")).alias("flags"))


GUARDS_SQL = f"""
WITH s AS (SELECT file_id, pos AS chunk, len(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')) AS n FROM {S})
SELECT file_id, chunk, CASE WHEN chunk % 11 = 4 OR chunk % 7 = 3 THEN 0 WHEN chunk % 7 = 6 THEN n + 1 ELSE n END AS kept,
  CASE WHEN chunk % 11 = 4 THEN 'low-energy' WHEN chunk % 7 = 3 THEN 'known-phrase' WHEN chunk % 7 = 5 THEN 'known-phrase-trailing' WHEN chunk % 7 = 6 THEN 'repetition' ELSE '' END AS flags
FROM s
"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    """Both engines' conversations aligned, decided by picks of every third span, and fused (CMP-1, CMP-3)."""
    timed = engines(spark, d).withColumns({"start": F.col("chunk") * 100.0 + F.col("pos"), "end": F.col("chunk") * 100.0 + F.col("pos") + 0.9})
    marked = matching.settled(islands.mark_spans(fusion.align_engines(timed)).drop("blank"))  # read four times
    spans = marked.select("file_id", "span_id").distinct()
    picks = spans.where("span_id % 3 = 0").withColumn("choice", F.when(F.col("span_id") % 2 == 0, "b").otherwise("a"))
    scores = spans.where("span_id % 4 != 1").select("file_id", "span_id", (-F.col("span_id") % 7).cast("double").alias("sa"), (-F.col("span_id") % 5).cast("double").alias("sb"))
    got = fusion.fused_words(marked, picks, scores, F.lit(0.5))
    return got.groupBy("tier", "source").agg(F.count("*").alias("words"), F.count_if("unclear").alias("unclear"), F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("seconds"))


def single_engine(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one engine's events, unsure ones disputed (WIN-11)."""
    w = words(spark, d).select("file_id", F.floor(F.col("start") / 86400).alias("chunk"), "pos", "text", "prob", "start", (F.col("start") + 1).alias("end"))
    return islands.group_spans(fusion.single_engine_slots(w), forced=True)


SINGLE_SQL = f"""
WITH s AS (SELECT file_id, CAST(floor(start / 86400) AS BIGINT) AS chunk, pos, prob < 0.5 AS low FROM {Wd}),
f AS (SELECT *, CASE WHEN low AND lag(low) OVER w AND chunk = lag(chunk) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY file_id ORDER BY chunk, pos)),
i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_id ORDER BY chunk, pos) - 1 AS BIGINT) AS span_id FROM f)
SELECT file_id, span_id, min(chunk) AS chunk, min(pos) AS first, max(pos) AS last, CASE WHEN bool_or(low) THEN 'disputed' ELSE 'solid' END AS tier FROM i GROUP BY 1, 2
"""


def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as one engine's fused words: every ninth word unclear, every tenth agreed but unsure."""
    said = F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ")
    s = edits.spread(segments(spark, d).select("file_id", "speaker", "start", "end", F.col("pos").alias("seg"), "text"), "file_id")  # words are many times a turn's size
    before = F.sum(F.size("said")).over(islands.W.partitionBy("file_id").orderBy("seg").rowsBetween(islands.W.unboundedPreceding, 0)) - F.size("said")
    w = s.withColumn("said", said).withColumn("before", before).select("file_id", "speaker", "start", "end", "before", F.posexplode("said").alias("i", "text"))
    n = (F.col("before") + F.col("i")).cast("int")
    return w.withColumn("pos", n).select(
        "file_id", "pos", "text", "start", "end", F.lit("solid").alias("tier"), F.when(F.col("pos") % 10 == 7, 0.4).otherwise(0.9).alias("confidence"), F.lit("agree").alias("source"),
        F.when(F.col("pos") % 9 == 0, F.array(F.reverse("text"))).otherwise(F.array().cast("array<string>")).alias("alternatives"), (F.col("pos") % 9 == 0).alias("unclear"), "speaker",
    )


def terms(spark: SparkSession, d: str) -> DataFrame:
    """The longest capitalised words of every conversation, up to five."""
    t = transcript(spark, d).where(F.col("text").rlike("^[A-Z][a-z]{5,}$")).groupBy("file_id", F.col("text").alias("term")).agg(F.min("pos").alias("pos"))
    return t.withColumn("r", F.row_number().over(islands.W.partitionBy("file_id").orderBy(F.desc(F.length("term")), "pos"))).where("r <= 5").select("file_id", "term")


def targets(spark: SparkSession, d: str) -> DataFrame:
    """Doubtful spans by reason (CMP-5, J-10)."""
    return refining.refine_targets(transcript(spark, d), terms(spark, d), "en").groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.col("end_idx") - F.col("start_idx")).alias("words"), F.sum(F.size("alternatives")).alias("alternatives"))


def rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over rewrites of every doubtful span, and how many words the accepted ones leave (FN-17, CMP-6)."""
    w, t = transcript(spark, d), terms(spark, d)
    found = matching.settled(refining.refine_targets(w, t, "en").select("file_id", "target_id", "start_idx", "end_idx", "reason", "text", "alternatives"))  # read three times
    k = F.col("target_id") % 4
    text = F.when(k == 0, F.regexp_replace("text", "e", "ee")).when(k == 1, F.concat("text", F.lit(" it is so"))).when(k == 2, F.lit("")).otherwise(F.reverse("text"))
    proposals = found.select("file_id", "target_id", F.lit(0).alias("n"), text.alias("replacement"))
    scores = found.where("target_id % 8 != 4").select("file_id", "target_id", F.lit(-1.0).alias("original"), (-F.col("target_id") % 3).cast("double").alias("replaced"))
    judged = matching.settled(refining.judged(found, proposals, t, "en", scores).select("file_id", "start_idx", "end_idx", "replacement", "verdict"))  # read twice
    left = refining.apply_edits(w, judged)
    return judged.groupBy("verdict").agg(F.count("*").alias("n")).unionByName(left.agg(F.lit("words left").alias("verdict"), F.count("*").alias("n")))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """A model's answer for every conversation, read back (FN-25): turns are ids, some of them strings, and their parity the choice."""
    choice = F.when(F.col("pos") % 3 == 2, "maybe").otherwise((F.col("pos") % 3 + 1).cast("string"))
    entry = F.when(F.col("pos") % 2 == 0, F.format_string('{"id": %d, "choice": "%s"}', "pos", choice)).otherwise(F.format_string('{"id": "%d", "choice": "%s"}', "pos", choice))
    text = segments(spark, d).groupBy("file_id").agg(F.concat(F.lit('Sure {x}: {"choices": ['), F.array_join(F.sort_array(F.collect_list(entry)), ", "), F.lit("]} done")).alias("text"))
    return parsing.parse_choices(text)


def found_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every document as prose, the most frequent kinds by source (FN-20, TOP-7)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("part"), "text", F.lit(False).alias("title"))
    return corpus.first_seen(parsing.extract_terms(docs)).groupBy(F.size(F.split("term", " ")).alias("words")).agg(F.count("*").alias("terms"), F.count_distinct("term").alias("kinds"))


def heard(spark: SparkSession, d: str) -> DataFrame:
    """How far names and types of parts are apart in English, German and Spanish (FN-12)."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", *[F.round(sounds.phonetic_distance(F.col("p_name"), F.col("p_type"), F.lit(x)), 6).alias(x) for x in ("en", "de", "es")])


# ---------------------------------------------------------------- files and their health


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Conversations from their turns' results: user turns have texts, of the others the segments speak (AGG-19)."""
    s = segments(spark, d)
    results = s.select("file_id", F.col("pos").alias("chunk"), F.when(F.col("file_id") % 3 != 0, F.concat(F.lit(" "), "text")).alias("text"), F.when(F.col("pos") > 0, F.concat(F.lit("l"), F.col("pos").cast("string"))).alias("language"), F.lit(1.0).alias("duration"))
    out = selection.merged_transcripts(results, s.select("file_id", F.lit(0).alias("chunk"), "pos", "text"))
    return out.select("file_id", "text", "language", F.size("chunks").alias("chunks"))


MERGED_SQL = f"SELECT file_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY pos) FILTER (WHERE trim(text) != '') AS text, min_by(concat('l', pos), pos) FILTER (WHERE pos > 0) AS language, CAST(count(*) AS INTEGER) AS chunks FROM {S} GROUP BY 1"


def health(spark: SparkSession, d: str) -> DataFrame:
    """Users by stage that went wrong and level of trust; events are stages (AGG-25)."""
    w = words(spark, d)
    status = F.when(F.col("event_id") % 4 == 0, "ok").when(F.col("event_id") % 4 == 1, "off").when(F.col("event_id") % 4 == 2, "skipped: no model").otherwise("partial")
    trust = w.select("file_id").distinct().withColumn("level", F.when(F.col("file_id") % 2 == 0, "high").otherwise("low"))
    return selection.run_health(w.select("file_id", F.col("label").alias("stage"), status.alias("status")), trust)[1]


def moved(spark: SparkSession, d: str) -> DataFrame:
    """Segments moved by the offset of their chunk; some times are unknown (WIN-2)."""
    s = segments(spark, d).select("file_id", F.col("pos").alias("chunk"), F.when(F.col("pos") % 5 != 0, F.col("start")).alias("start"), "end")
    offsets = s.select("file_id", "chunk", ((F.col("chunk") - 2) * 10.0).alias("offset"))
    return rounded(selection.offset_segments(s, offsets), "start", "end")


# ---------------------------------------------------------------- choices


def windows_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user within two days from the third day on, of users with eight or more (PRJ-6)."""
    w = words(spark, d).select(F.col("file_id").alias("group_id"), "pos", "start", (F.col("start") + 60).alias("end"))
    return selection.time_window(w, 172800.0, 172800.0, 8).groupBy("group_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


WINDOW_SQL = f"""
WITH w AS (SELECT file_id AS group_id, pos, start, min(start) OVER (PARTITION BY file_id) + 172800 AS t FROM {Wd}), k AS (SELECT * FROM w WHERE start >= t AND start + 60 <= t + 172800)
SELECT group_id, count(*) AS n, min(pos) AS first FROM k GROUP BY 1 HAVING count(*) >= 8
"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    """The order in which customers are visited so that neighbours come far apart (TOP-10)."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return selection.spread_order(c, ["c_custkey"]).select("c_custkey", F.col("visit").cast("long"))


VISITS_SQL = """
WITH n AS (SELECT count(*) AS n FROM customer), s AS (SELECT min(k) AS k FROM n, LATERAL (SELECT unnest(range(greatest(1, n // 3), n + 1)) AS k) WHERE gcd(k, n) = 1), p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer),
v AS (SELECT i, i * k % n AS p FROM n, s, LATERAL (SELECT unnest(range(0, n)) AS i)) SELECT c_custkey, CAST(i AS BIGINT) AS visit FROM p JOIN v USING (p)
"""


def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that an answer for a conversation's turns lacks, adds or repeats (SET-4)."""
    ids = segments(spark, d).groupBy("file_id").agg(F.collect_list("pos").alias("asked"))
    got = F.concat(F.filter("asked", lambda x: x % 4 != 1), F.array((F.size("asked") + 5).cast("long")), F.filter("asked", lambda x: x == 0))
    return ids.select("file_id", selection.batch_id_problems(F.col("asked"), got).alias("p")).select("file_id", *[F.array_join(F.transform(F.col("p")[c], lambda x: x.cast("string")), ",").alias(c) for c in ("missing", "unexpected", "duplicate")])


BATCH_SQL = f"SELECT file_id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos % 4 = 1), '') AS missing, CAST(count(*) + 5 AS VARCHAR) AS unexpected, CASE WHEN bool_or(pos = 0) THEN '0' ELSE '' END AS duplicate FROM {S} GROUP BY 1"


def talks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a talk's length (PRJ-16), by language, of one split (PRJ-3)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", "text", F.lit("s").alias("slice"), F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("test").alias("split"), (F.length("text") / 14).alias("duration"))
    return selection.talk_length(selection.select_items(docs, "dev")).groupBy("lang").agg(F.count("*").alias("n"))


def on_slides(spark: SparkSession, d: str) -> DataFrame:
    """What was said on each slide; every third turn of a conversation shows the next one, the first slide late (J-3)."""
    s = segments(spark, d)
    spans = s.where("pos % 3 = 1").select("file_id", F.col("pos").alias("slide"), (F.col("start") + 0.3).alias("start"))
    return intervals.slide_texts(s, spans).select("file_id", "slide", F.size("texts").alias("n"), F.array_join("texts", "|").alias("said"))


SLIDES_SQL = f"""
WITH s AS (SELECT *, (start + "end") / 2 AS mid FROM {S} WHERE trim(text) != ''), p AS (SELECT file_id, pos AS slide, start + 0.3 AS t FROM {S} WHERE pos % 3 = 1), f AS (SELECT file_id, min(slide) AS first FROM p GROUP BY 1),
a AS (SELECT s.file_id, s.pos, s.text, max(slide) AS slide FROM s LEFT JOIN p ON p.file_id = s.file_id AND p.t <= s.mid GROUP BY ALL)
SELECT a.file_id, coalesce(slide, first) AS slide, CAST(count(*) AS INTEGER) AS n, string_agg(trim(text), '|' ORDER BY pos) AS said FROM a JOIN f ON f.file_id = a.file_id GROUP BY 1, 2
"""


def frame_words(spark: SparkSession, d: str) -> DataFrame:
    """Events as label frames of a user: labels in turn, a blank and a repeat label among them (WIN-5)."""
    w = words(spark, d)
    label = F.when(F.col("event_id") % 7 == 0, -1).when(F.col("event_id") % 11 == 0, 99).otherwise((F.col("event_id") % 2).cast("int"))
    frames = w.select("file_id", F.col("pos").cast("long").alias("frame"), label.alias("label"), F.col("prob").alias("margin"))
    vocab = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey < 2").select(F.col("r_regionkey").cast("int").alias("label"), F.col("r_name").alias("text"))
    return rounded(islands.collapse_labels(frames, vocab, 99), "start", "end", "score")


FRAMES_SQL = f"""
WITH f AS (SELECT file_id, pos AS frame, CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 11 = 0 THEN 99 ELSE event_id % 2 END AS label, prob FROM {Wd}),
g AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY file_id ORDER BY frame) THEN 0 ELSE 1 END AS fresh FROM f), r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_id ORDER BY frame) - 1 AS BIGINT) AS run FROM g),
k AS (SELECT file_id, run, label, min(frame) AS a, max(frame) + 1 AS z, avg(prob) AS score FROM r GROUP BY 1, 2, 3), n AS (SELECT k.*, r_name FROM k LEFT JOIN region ON r_regionkey = label AND label IN (0, 1)),
t AS (SELECT *, CASE WHEN label = 99 THEN last_value(r_name IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY run) ELSE r_name END AS text FROM n)
SELECT file_id, run, text, round(a * 0.02::DOUBLE, 6) AS start, round(z * 0.02::DOUBLE, 6) AS "end", round(score, 6) AS score FROM t WHERE text IS NOT NULL
"""


def unusable(spark: SparkSession, d: str) -> DataFrame:
    """Why references of each language can't be used, and how many can (PRJ-2)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" <noise>"))).when(F.col("doc_id") % 9 == 1, F.concat("text", F.lit(" IGNORE_TIME_SEGMENT"))).when(F.col("doc_id") % 9 == 2, " ").otherwise(F.col("text")).alias("text"))
    return docs.groupBy("lang", T.unusable(F.col("text")).alias("dropped")).agg(F.count("*").alias("n"))


UNUSABLE_SQL = r"SELECT lang, CASE WHEN doc_id % 9 = 0 OR (doc_id % 9 != 2 AND regexp_matches(text, '<[^<>\s][^<>]*>')) THEN 'markup' WHEN doc_id % 9 = 1 THEN 'ignored' WHEN doc_id % 9 = 2 OR trim(coalesce(text, '')) = '' THEN 'empty' END AS dropped, count(*) AS n FROM documents GROUP BY 1, 2"


JOBS = {
    "slide_texts": (on_slides, SLIDES_SQL),
    "frame_words": (frame_words, FRAMES_SQL),
    "unusable_references": (unusable, UNUSABLE_SQL),
    "score_items": (score_items, None),
    "skipped_languages": (skipped_languages, "SELECT r_name AS system, lang, count(*) AS items, count(*) FILTER (WHERE r_regionkey % 2 = 0 AND lang NOT IN ('en', 'es')) AS skipped FROM documents, region GROUP BY 1, 2"),
    "stage_changes": (stage_changes, STAGES_SQL),
    "decide_profiles": (decided, None),
    "chain_means": (chain_means, CHAIN_SQL),
    "guards": (guard_counts, GUARDS_SQL),
    "fused_words": (fused, None),
    "single_engine_spans": (single_engine, SINGLE_SQL),
    "refine_targets": (targets, None),
    "rewrites": (rewrites, None),
    "parse_choices": (answers, f"SELECT file_id, CAST(pos AS BIGINT) AS span_id, CASE pos % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'unclear' END AS answer FROM {S}"),
    "found_terms": (found_terms, None),
    "phonetic_distance": (heard, None),
    "merged_transcripts": (merged, MERGED_SQL),
    "run_health": (health, f"SELECT label AS stage, CASE WHEN file_id % 2 = 0 THEN 'high' ELSE 'low' END AS level, count(DISTINCT file_id) AS files FROM {Wd} WHERE event_id % 4 >= 2 GROUP BY 1, 2"),
    "offset_segments": (moved, f'SELECT file_id, pos AS chunk, round(CASE WHEN pos % 5 != 0 THEN start + greatest(0, (pos - 2) * 10) END, 6) AS start, round("end" + greatest(0, (pos - 2) * 10), 6) AS "end" FROM {S}'),
    "time_window": (windows_of_groups, WINDOW_SQL),
    "top_file": (lambda s, d: selection.top_file(segments(s, d).withColumn("role", F.col("speaker")), "role"), f"WITH n AS (SELECT speaker AS role, file_id, count(*) AS n FROM {S} GROUP BY 1, 2) SELECT role, file_id, n FROM n QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, file_id DESC) = 1"),
    "spread_order": (visits, VISITS_SQL),
    "first_per_category": (lambda s, d: selection.first_per_category(words(s, d).select("label", "event_id"), "label", "event_id"), f"SELECT label, event_id FROM {Wd} QUALIFY row_number() OVER (PARTITION BY label ORDER BY event_id) <= 4"),
    "batch_ids": (batch_ids, BATCH_SQL),
    "talk_length": (talks, "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 3 = 0 AND len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) BETWEEN 300 AND 1700 AND length(text) / 14 <= 600 GROUP BY 1"),
    "first_majority": (lambda s, d: metrics.first_majority(words(s, d), "file_id", "label", "pos"), f"WITH n AS (SELECT file_id, label, count(*) AS n, min(pos) AS p FROM {Wd} GROUP BY 1, 2) SELECT file_id, label AS winner FROM n QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, p) = 1"),
    "item_wers": (
        lambda s, d: scoring.item_wers(ladder(s, d), "key", "system").select("key", "system", "id", F.round("wer", 6).alias("wer")),
        "SELECT CASE l_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'other' END AS key, (['single-a', 'single-b', 'fused', '+pick', '+verify', '+refine', 'other'])[l_linenumber] AS system, CAST(l_partkey AS VARCHAR) AS id, round(avg((CAST(l_quantity AS DOUBLE) - l_linenumber * 2) / 500), 6) AS wer FROM lineitem WHERE l_partkey % 10 != 0 GROUP BY 1, 2, 3",
    ),
}
