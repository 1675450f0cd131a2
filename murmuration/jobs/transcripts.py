"""Segments, words, speakers and renderings of transcripts, and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import rules, sounds
from murmuration.functions import text as T
from murmuration.jobs.domain import SEGMENTS, WORDS, duck_table, spark_table
from murmuration.operators import corpus, intervals, islands, metrics
from murmuration.sources import render

S, Wd = duck_table(SEGMENTS), duck_table(WORDS)


def segments(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, SEGMENTS)


def words(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, WORDS)


def r3(*names: str) -> dict:
    return {n: F.round(n, 3) for n in names}


def event_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a user begins a segment, six hours long."""
    return words(spark, d).select("file_id", "pos", "start", (F.col("start") + 21600).alias("end"), "label")


SPANS = f"(SELECT file_id, pos, start, start + 21600 AS \"end\", label FROM {Wd})"


def word_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every event half an hour later, and the segment that has begun by then."""
    w = words(spark, d).select("file_id", "pos", (F.col("start") + 1800).alias("start"))
    return intervals.last_before(w, event_spans(spark, d), F.col("start") + intervals.SLACK, ["pos", "label"]).select("file_id", "pos", "span_pos", "span_label")


def speakers(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).select("file_id", "pos", "start", (F.col("start") + 600).alias("end"))
    turns = words(spark, d).where("pos % 7 = 3").select("file_id", "start", (F.col("start") + 7200).alias("end"), F.col("label").alias("speaker"), "pos")
    return intervals.assign_speakers(w, turns, width=7200.0).select("file_id", "pos", "speaker")


SPEAKERS_SQL = f"""
WITH w AS (SELECT file_id, pos, start AS s, start + 600 AS e FROM {Wd}), t AS (SELECT file_id, pos AS turn, start AS s, start + 7200 AS e, label FROM {Wd} WHERE pos % 7 = 3),
x AS (SELECT w.file_id, w.pos, t.label, t.turn, least(w.e, t.e) - greatest(w.s, t.s) AS shared, greatest(0, greatest(w.s - t.e, t.s - w.e)) AS gap FROM w LEFT JOIN t USING (file_id))
SELECT file_id, pos, coalesce(label, '1') AS speaker FROM x QUALIFY row_number() OVER (PARTITION BY file_id, pos ORDER BY CASE WHEN shared > 0 THEN 0 ELSE 1 END, CASE WHEN shared > 0 THEN -shared ELSE gap END, turn) = 1
"""


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return s.select("file_id", F.col("pos").alias("chunk"), F.when(F.col("pos") % 3 == 0, 0).otherwise(F.length("text")).alias("duration"), F.when(F.col("pos") % 2 == 0, F.length("text") + 1).otherwise(0).alias("result_duration"))


def speech(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where("label in ('click', 'view')").select("file_id", "start", (F.col("start") + 3600).alias("end"))


SPEECH = f"(SELECT file_id, start, start + 3600 AS \"end\" FROM {Wd} WHERE label IN ('click', 'view'))"
MERGED = f"""(SELECT file_id, island, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY start, "end") AS island FROM
(SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY file_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {{gap}} THEN 0 ELSE 1 END AS fresh FROM {SPEECH})) GROUP BY 1, 2)"""


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where("label = 'purchase'").select("file_id", F.col("pos").alias("chunk"), "start", (F.col("start") + 1800).alias("end"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where("label not in ('click', 'view')").select("file_id", "pos", "start", (F.col("start") + 60).alias("end"))


def long_segments(spark: SparkSession, d: str) -> DataFrame:
    return islands.words_to_segments(words(spark, d), gap=7200.0, tail=0.5).groupBy("file_id").agg(F.count("*").alias("segments"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


SEGMENT_SQL = f"""
WITH a AS (SELECT *, CASE WHEN start - lag(start) OVER w > 7200 OR regexp_matches(lag(text) OVER w, '[.?]$') THEN 1 ELSE 0 END AS fresh, lead(start) OVER w AS next FROM {Wd} WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY pos) AS island FROM a), c AS (SELECT *, (row_number() OVER (PARTITION BY file_id, island ORDER BY pos) - 1) // 14 AS part FROM b),
g AS (SELECT file_id, island, part, min(start) AS s, max(start) AS l, arg_max(coalesce(next, -1), pos) AS next, count(*) AS n FROM c GROUP BY 1, 2, 3),
e AS (SELECT *, greatest(l + 0.04, CASE WHEN next >= 0 THEN least(next, l + 7200.5) ELSE l + 0.5 END) AS e FROM g)
SELECT file_id, count(*) AS segments, CAST(sum(n) AS BIGINT) AS words, max(n) AS longest, round(sum(round_even(e, 3) - round_even(s, 3)), 3) AS seconds FROM e GROUP BY file_id
"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


#: Beginnings of links, and what they are: platform and whether a video id follows.
LINKS = (
    ("https://www.youtube.com/watch?x=1&v=", "youtube", True), ("https://youtu.be/", "youtube", True), ("https://m.youtube.com/shorts/", "youtube", True), ("https://x.com/i/status/", "x", False),
    ("http://mobile.twitter.com/i/status/", "x", False), ("https://www.instagram.com/p/", "instagram", False), ("https://instagr.am/p/", "instagram", False), ("https://player.vimeo.com/video/", None, False), ("http://notyoutube.com/go/", None, False),
)


def urls(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses turned into links of every platform and some of none."""
    shape = F.element_at(F.array(*[F.lit(x) for x, _, _ in LINKS]), (F.col("page_id") % len(LINKS) + 1).cast("int"))
    link = F.concat(shape, F.lit("id"), F.col("page_id").cast("string"))
    return pages(spark, d).select(
        "page_id", T.host(F.col("url")).alias("host"), T.platform(link).alias("platform"), T.video_id(link).alias("video_id"), T.slug(F.col("url")).alias("slug"), T.unescape_url(F.concat(link, F.lit("\\?a\\=b"))).alias("plain"),
        T.watch_url(link, F.col("page_id") + 0.7).alias("watch"),
    )


URLS_SQL = r"""
WITH k(n, head, platform, has_id) AS (VALUES {links}), l AS (SELECT page_id, url, concat(head, 'id', page_id) AS link, platform, has_id FROM pages JOIN k ON n = page_id % {count})
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, platform, CASE WHEN has_id THEN concat('id', page_id) END AS video_id,
  regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS slug, concat(link, '?a=b') AS plain,
  CASE WHEN has_id THEN concat('https://www.youtube.com/watch?v=id', page_id, '&t=', page_id, 's') END AS watch
FROM l
""".replace("{links}", ", ".join(f"({i}, '{a}', {'NULL' if b is None else repr(b)}, {str(c).lower()})" for i, (a, b, c) in enumerate(LINKS))).replace("{count}", str(len(LINKS)))


def term_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First casing of every capitalised word of a conversation, 200 a file (TOP-7)."""
    w = segments(spark, d).select("file_id", "pos", F.posexplode(F.split("text", " ")).alias("i", "term")).where(F.col("term").rlike("^[A-Z][a-z]+$"))
    return corpus.first_seen(w.select("file_id", (F.col("pos") * 1000000 + F.col("i")).alias("pos"), "term")).select("file_id", "term", "rank")


def gram_counts(spark: SparkSession, d: str) -> DataFrame:
    g = segments(spark, d).select(F.col("speaker").alias("role"), F.explode(T.ngrams(F.split("text", " "))).alias("gram"))
    return g.groupBy("role", F.size(F.split("gram", " ")).alias("n")).agg(F.count("*").alias("grams"), F.count_distinct("gram").alias("kinds"))


def phonetic(spark: SparkSession, d: str) -> DataFrame:
    """Names and types of parts by Spanish sound, and how far they are apart."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", sounds.spanish(F.col("p_name")).alias("sound"), sounds.spanish(F.col("p_type")).alias("other"))
    return p.withColumn("distance", F.round(sounds.sound_distance(F.col("sound"), F.col("other")), 6)).select("p_partkey", "sound", "distance")


def _sound(c: str) -> str:
    """The same in SQL without lookahead: a soft c or g is marked first."""
    out = f"regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g')"
    for a, b in (("ch", "C"), ("qu", "K"), ("q", "K")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, 'c([ei])', 'S\\1', 'g'), 'gu([ei])', 'G\\1', 'g'), 'g([ei])', 'X\\1', 'g')"
    for a, b in (("c", "k"), ("j", "X"), ("ll", "y"), ("rr", "r"), ("z", "s"), ("v", "b"), ("x", "ks"), ("h", "")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, 'KSGX', 'ksgx')"


def hints(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).select("file_id", F.floor(F.col("pos") / 10).alias("segment"), "start", "text", "score")
    return metrics.uncertain_hints(w)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Events as utterances: the user is the speaker."""
    return words(spark, d).select(F.col("file_id").cast("string").alias("speaker"), F.col("event_id").alias("rn"), F.lit(2.0).alias("seconds"), "label")


def votes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.majority(words(spark, d).withColumn("prob", F.col("prob").cast("decimal(10,2)")), "file_id", "label", "prob")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Chunking, confidence, and verification windows for every event, by decision table (PRJ-11, FN-11, FN-24)."""
    w = words(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("agree", "substitute", "a_only"))), (F.col("event_id") % 3 + 1).cast("int"))
    pb = F.when(F.col("event_id") % 4 != 0, F.col("prob") / 2)
    lo, hi = rules.window_bounds(F.col("score"), F.col("score") + F.col("event_id") % 50 - 5, F.lit(100.0))
    return w.select(
        "event_id", rules.should_chunk(F.when(F.col("event_id") % 10 == 0, "off").otherwise("auto"), F.when(F.col("event_id") % 6 == 0, "eg2").otherwise("openai"), F.col("score") * 20, F.col("score")).alias("chunked"),
        F.round(rules.word_confidence(kind, F.col("prob"), pb), 6).alias("confidence"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"),
        T.mmss(F.col("score")).alias("clock"),
    )


DECISIONS_SQL = f"""
WITH w AS (SELECT *, CASE WHEN event_id % 4 != 0 THEN prob / 2 END AS pb, score AS a, score + event_id % 50 - 5 AS b, greatest(0, score - 0.3) AS l, least(100, score + event_id % 50 - 5 + 0.3) AS h FROM {Wd})
SELECT event_id, CASE WHEN event_id % 10 = 0 OR event_id % 6 = 0 THEN false ELSE score * 20 >= 1200 OR score >= 24 END AS chunked,
  round(CASE event_id % 3 WHEN 0 THEN coalesce((prob + pb) / 2, prob) WHEN 1 THEN 0.3 * greatest(prob, coalesce(pb, prob)) ELSE 0.2 END, 6) AS confidence,
  round(CASE WHEN h > l AND b >= a THEN CASE WHEN h - l > 30 THEN (l + h) / 2 - 15 ELSE l END END, 6) AS lo, round(CASE WHEN h > l AND b >= a THEN CASE WHEN h - l > 30 THEN (l + h) / 2 + 15 ELSE h END END, 6) AS hi,
  concat(lpad(CAST(CAST(floor(score) AS BIGINT) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(floor(score) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS clock
FROM w
"""
CENTS = "printf('%d.%02d', (CAST(round({0} * 1000) AS BIGINT) + 5) // 1000, (CAST(round({0} * 1000) AS BIGINT) + 5) // 10 % 100)"
TIME = "printf('%02d:%02d:%02d,%03d', CAST({0} AS BIGINT) // 3600000, CAST({0} AS BIGINT) // 60000 % 60, CAST({0} AS BIGINT) // 1000 % 60, CAST({0} AS BIGINT) % 1000)"

JOBS = {
    "chunk_offsets": (
        lambda s, d: intervals.chunk_offsets(chunk_table(s, d)).select("file_id", "chunk", "length", "offset"),
        'WITH c AS (SELECT conv_id AS file_id, turn AS chunk, CASE WHEN turn % 3 != 0 AND length(text) > 0 THEN length(text) WHEN turn % 2 = 0 THEN length(text) + 1 ELSE 0 END AS length FROM conversations) SELECT file_id, chunk, length, CAST(coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c',
    ),
    "merge_intervals": (lambda s, d: intervals.merge_intervals(speech(s, d), ["file_id"], 60.0).withColumns(r3("start", "end")), f'SELECT file_id, round(start, 3) AS start, round("end", 3) AS "end" FROM {MERGED.format(gap=60)}'),
    "speech_coverage": (
        lambda s, d: intervals.coverage(speech(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("file_id"), F.lit(2000000.0).alias("duration"))).withColumns({"speech": F.round("speech", 3), "ratio": F.round("ratio", 6)}),
        f"""WITH c AS (SELECT file_id, greatest(0, start) AS start, least(2000000.0, "end") AS "end" FROM {SPEECH}), k AS (SELECT * FROM c WHERE "end" > start),
        m AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY file_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0 THEN 0 ELSE 1 END AS fresh FROM k), i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY start, "end") AS island FROM m),
        t AS (SELECT file_id, sum(e - s) AS speech FROM (SELECT file_id, island, min(start) AS s, max("end") AS e FROM i GROUP BY 1, 2) GROUP BY 1) SELECT c_custkey AS file_id, round(coalesce(speech, 0), 3) AS speech, round(coalesce(speech, 0) / 2000000.0, 6) AS ratio FROM customer LEFT JOIN t ON t.file_id = c_custkey""",
    ),
    "word_to_segment_asof": (word_asof, f"SELECT w.file_id, w.pos, t.pos AS span_pos, t.label AS span_label FROM {Wd} w ASOF JOIN {SPANS} t ON w.file_id = t.file_id AND w.start + 1800 + 1e-6 >= t.start"),
    "speaker_assign": (speakers, SPEAKERS_SQL),
    "chunk_speech": (lambda s, d: intervals.overlap_flags(chunks_of(s, d), speech(s, d), 7200.0).select("file_id", "chunk", "speech"), f"SELECT file_id, pos AS chunk, EXISTS (SELECT 1 FROM {SPEECH} s WHERE s.file_id = w.file_id AND s.\"end\" > w.start AND s.start < w.start + 1800) AS speech FROM {Wd} w WHERE label = 'purchase'"),
    "outside_speech": (lambda s, d: intervals.outside_speech(points(s, d), speech(s, d), width=7200.0).select("file_id", "pos"), f"SELECT file_id, pos FROM {Wd} w WHERE label NOT IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM {SPEECH} s WHERE s.file_id = w.file_id AND s.\"end\" + 0.25 > w.start AND s.start - 0.25 < w.start + 60)"),
    "timeline": (
        lambda s, d: intervals.timeline(event_spans(s, d), 3600.0).select("file_id", "pos", F.round("new_start", 3).alias("new_start")),
        f'WITH a AS (SELECT *, greatest(0, start - coalesce(max("end") OVER (PARTITION BY file_id ORDER BY start, "end", pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 3600) AS cut FROM {SPANS}) SELECT file_id, pos, round(start - sum(cut) OVER (PARTITION BY file_id ORDER BY start, "end", pos), 3) AS new_start FROM a',
    ),
    "run_collapse": (
        lambda s, d: islands.collapse_runs(words(s, d), ["file_id"], ["pos"], "label", "pos"),
        f"WITH a AS (SELECT *, CASE WHEN label != lag(label) OVER (PARTITION BY file_id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM {Wd}), b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS run FROM a) SELECT file_id, run, label, min(pos) AS first, max(pos) AS last, count(*) AS n FROM b GROUP BY 1, 2, 3",
    ),
    "unclear_runs": (
        lambda s, d: islands.unclear_runs(words(s, d)),
        f"WITH a AS (SELECT file_id, pos, pos - row_number() OVER (PARTITION BY file_id ORDER BY pos) AS g FROM {Wd} WHERE unclear) SELECT file_id, min(pos) AS start_idx, max(pos) + 1 AS end_idx FROM a GROUP BY file_id, g",
    ),
    "word_segments": (long_segments, SEGMENT_SQL),
    "context": (
        lambda s, d: islands.context(words(s, d), ["file_id"]).select("file_id", "pos", "left_context", "right_context"),
        f"SELECT file_id, pos, coalesce(string_agg(text, ' ' ORDER BY pos) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS left_context, coalesce(string_agg(text, ' ') OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), '') AS right_context FROM {Wd}".replace("string_agg(text, ' ' ORDER BY pos)", "string_agg(text, ' ')"),
    ),
    "batches": (
        lambda s, d: islands.batches(words(s, d)).select("file_id", "batch", "n"),
        f"SELECT file_id, pos // 60 AS batch, count(*) AS n FROM {Wd} GROUP BY 1, 2",
    ),
    "window_assign": (
        lambda s, d: islands.window_places(words(s, d).select("file_id", (F.col("pos") * 1.0).alias("at"), F.count("*").over(islands.W.partitionBy("file_id")).alias("n"))).groupBy("file_id", "window").agg(F.count("*").alias("n")),
        f"WITH a AS (SELECT file_id, pos AS place, count(*) OVER (PARTITION BY file_id) AS n FROM {Wd}), b AS (SELECT file_id, greatest(0, least(floor((place - 1.0) / 18), CASE WHEN n <= 20 THEN 0 ELSE ceil((n - 20) / 18.0) END)) AS w FROM a) SELECT file_id, CAST(w AS BIGINT) AS \"window\", count(*) AS n FROM b GROUP BY 1, 2",
    ),
    "renumber_speakers": (
        lambda s, d: islands.renumber_speakers(segments(s, d).select("file_id", "pos", "speaker")),
        f"WITH f AS (SELECT file_id, speaker, min(pos) AS p FROM {S} GROUP BY 1, 2), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY p, speaker) AS VARCHAR) AS number FROM f) SELECT file_id, pos, speaker, number FROM {S} JOIN n USING (file_id, speaker)",
    ),
    "spread_words": (
        lambda s, d: islands.spread_words(segments(s, d).withColumn("text", F.regexp_replace("text", r"\s+", " "))).select("file_id", "pos", "i", *[F.floor(F.col(c) * 1000 + 1e-6).alias(f"{c}_ms") for c in ("start", "end")]),
        f"""WITH w AS (SELECT file_id, pos, start, "end", unnest(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x != '')) AS word, generate_subscripts(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x != ''), 1) - 1 AS i FROM {S}),
        c AS (SELECT *, sum(length(word)) OVER (PARTITION BY file_id, pos ORDER BY i) AS c, sum(length(word)) OVER (PARTITION BY file_id, pos) AS t FROM w)
        SELECT file_id, pos, CAST(i AS INTEGER) AS i, CAST(floor((start + ("end" - start) * (c - length(word)) / t) * 1000 + 1e-6) AS BIGINT) AS start_ms, CAST(floor((start + ("end" - start) * c / t) * 1000 + 1e-6) AS BIGINT) AS end_ms FROM c""",
    ),
    "longform": (
        lambda s, d: islands.longform(pool(s, d).withColumnRenamed("speaker", "group_id"), 60.0).groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.max("end"), 3).alias("seconds")),
        f"WITH a AS (SELECT CAST(file_id AS VARCHAR) AS group_id, (row_number() OVER (PARTITION BY file_id ORDER BY event_id) - 1) * 2.6 AS start FROM {Wd}) SELECT group_id, count(*) AS n, round(max(start) + 2.0, 3) AS seconds FROM a WHERE start < 60 GROUP BY 1",
    ),
    "pick_speakers": (
        lambda s, d: corpus.pick_speakers(pool(s, d), 12, 30.0).groupBy("speaker").agg(F.count("*").alias("n"), F.max("rn").alias("last")),
        f"""WITH p AS (SELECT CAST(file_id AS VARCHAR) AS speaker, event_id AS rn FROM {Wd}), n AS (SELECT speaker, row_number() OVER (ORDER BY length(speaker), speaker) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT speaker FROM p)),
        k AS (SELECT speaker FROM n WHERE r % greatest(1, c // 12) = 0 AND r // greatest(1, c // 12) < 12), b AS (SELECT *, (row_number() OVER (PARTITION BY speaker ORDER BY rn) - 1) * 2.0 AS before FROM p WHERE speaker IN (FROM k)) SELECT speaker, count(*) AS n, max(rn) AS last FROM b WHERE before < 30 GROUP BY 1""",
    ),
    "round_robin": (
        lambda s, d: corpus.round_robin(pool(s, d), "label").select("label", "rn", F.col("place").cast("long")),
        f"WITH p AS (SELECT label, CAST(file_id AS VARCHAR) AS speaker, event_id AS rn FROM {Wd}), t AS (SELECT *, (row_number() OVER (PARTITION BY label, speaker ORDER BY rn) - 1) // 3 AS turn FROM p) SELECT label, rn, row_number() OVER (PARTITION BY label ORDER BY turn, speaker, rn) AS place FROM t",
    ),
    "top_uncertain": (
        hints,
        f"""WITH a AS (SELECT file_id, pos // 10 AS segment, start, text, score, row_number() OVER (PARTITION BY file_id ORDER BY score) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM {Wd}), q AS (SELECT file_id, score AS threshold FROM a WHERE r = floor(0.1 * (n - 1)) + 1),
        l AS (SELECT a.*, row_number() OVER (PARTITION BY a.file_id, segment ORDER BY score, start, text) AS k FROM a JOIN q ON a.file_id = q.file_id AND score <= threshold) SELECT file_id, segment, string_agg(regexp_replace(text, '[.]$', ''), ',' ORDER BY start, text) AS hints FROM l WHERE k <= 3 GROUP BY 1, 2""",
    ),
    "majority_language": (
        votes,
        f"WITH v AS (SELECT file_id, label, count(*) AS n, sum(CAST(prob AS DECIMAL(10, 2))) AS w, count(*) FILTER (WHERE CAST(prob AS DECIMAL(10, 2)) > 0.6) AS sure FROM {Wd} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, w DESC, label DESC) AS k FROM v) SELECT file_id, max(label) FILTER (WHERE k = 1) AS winner, CAST(sum(sure) FILTER (WHERE k > 1) AS BIGINT) AS dissent, sum(sure) FILTER (WHERE k > 1) >= 2 AS switching FROM r GROUP BY 1",
    ),
    "decision_tables": (decisions, DECISIONS_SQL),
    "urls": (urls, URLS_SQL),
    "markup_counts": (
        lambda s, d: pages(s, d).groupBy(T.host(F.col("url")).alias("host")).agg(F.count_if(T.has_markup(F.col("html"))).alias("dropped"), F.count_if(T.has_markup(F.regexp_replace("html", "<([a-z])", "< $1"))).alias("spaced_marked"), F.sum(F.length(T.squeeze(F.col("url")))).alias("chars")),
        "SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) FILTER (WHERE regexp_matches(html, '<[^<>\\s][^<>]*>')) AS dropped, count(*) FILTER (WHERE regexp_matches(regexp_replace(html, '<([a-z])', '< \\1', 'g'), '<[^<>\\s][^<>]*>')) AS spaced_marked, CAST(sum(length(trim(regexp_replace(url, '\\s+', ' ', 'g')))) AS BIGINT) AS chars FROM pages GROUP BY 1",
    ),
    "render_srt": (
        lambda s, d: render.srt(segments(s, d)),
        f"SELECT file_id, string_agg(concat(n, chr(10), {TIME.format('round(start * 1000)')}, ' --> ', {TIME.format('round(e * 1000)')}, chr(10), 'Speaker ', speaker, ': ', text, chr(10)), chr(10) ORDER BY pos) AS srt FROM (SELECT *, \"end\" AS e, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n FROM {S}) GROUP BY 1",
    ),
    "render_txt": (
        lambda s, d: render.txt(segments(s, d)),
        f"SELECT file_id, concat(string_agg(concat('[', {CENTS.format('start')}, ' --> ', {CENTS.format('e')}, '] Speaker ', speaker, ': ', text), chr(10) ORDER BY pos), chr(10)) AS txt FROM (SELECT *, \"end\" AS e FROM {S}) GROUP BY 1",
    ),
    "transcript_documents": (
        lambda s, d: render.documents(segments(s, d)).withColumns(r3("duration")),
        f"SELECT file_id, string_agg(t, ' ' ORDER BY pos) AS text, count(DISTINCT speaker) AS n_speakers, count(*) AS n_segments, round(max(\"end\"), 3) AS duration FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM {S}) WHERE t != '' GROUP BY 1",
    ),
    "term_dedupe": (
        term_dedupe,
        f"WITH w AS (SELECT file_id, pos, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) AS i FROM {S}), f AS (SELECT file_id, arg_min(term, pos * 1000000 + i) AS term, min(pos * 1000000 + i) AS p FROM w WHERE regexp_matches(term, '^[A-Z][a-z]+$') GROUP BY file_id, lower(term)) SELECT file_id, term, CAST(row_number() OVER (PARTITION BY file_id ORDER BY p) AS INTEGER) AS rank FROM f QUALIFY rank <= 200",
    ),
    "ngrams": (
        gram_counts,
        f"WITH a AS (SELECT speaker AS role, string_split(text, ' ') AS w FROM {S}), g AS (SELECT role, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM a, (VALUES (1), (2), (3)) k(n)) SELECT role, n, count(*) AS grams, count(DISTINCT gram) AS kinds FROM g GROUP BY 1, 2",
    ),
    "phonetic_es": (phonetic, f"WITH s AS (SELECT p_partkey, {_sound('p_name')} AS sound, replace({_sound('p_name')}, ' ', '') AS a, replace({_sound('p_type')}, ' ', '') AS b FROM part) SELECT p_partkey, sound, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) AS distance FROM s"),
}
