"""Cutting, placing and rendering transcripts, sources read back, and what is decided about single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import parsing, rules, sounds, tables
from murmuration.jobs.domain import SEGMENTS, WORDS, duck_table, spark_table
from murmuration.jobs.evaluation import rounded
from murmuration.jobs.grading import terms, transcript
from murmuration.operators import cutting, fusion, islands, matching, selection, sequential
from murmuration.sources import manifests, render
from murmuration.streaming.run import shared_folder

S, Wd = duck_table(SEGMENTS), duck_table(WORDS)
DAY = 86400


def segments(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, SEGMENTS)


def words(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, WORDS)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- cutting


def built(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as words of a minute: segments of six days, broken by two days of pause, another speaker, or a sentence end after a day (WIN-8)."""
    w = words(spark, d).select(
        "file_id", "pos", "start", (F.col("start") + 60).alias("end"), F.when(F.col("event_id") % 40 < 30, "A").otherwise("B").alias("speaker"), "text", "unclear",
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("x"))).alias("alternatives"),
    )
    return cutting.build_segments(w, 6.0 * DAY, 2.0 * DAY, 1.0 * DAY).select("file_id", "start", "end", "speaker", "text", "n")


BUILT_SQL = f"""
WITH RECURSIVE w AS (SELECT file_id, pos, start, start + 60 AS z, text, CASE WHEN event_id % 40 < 30 THEN 'A' ELSE 'B' END AS speaker, unclear, event_id % 3 = 0 AS alt FROM {Wd}),
k AS (SELECT *, lag(z) OVER f AS pz, lag(text) OVER f AS pt, lag(speaker) OVER f AS ps, unclear AND lag(unclear) OVER f AND NOT alt AS tied FROM w WINDOW f AS (PARTITION BY file_id ORDER BY pos)),
walk AS (
  SELECT file_id, pos, pos AS first, start AS begin FROM k WHERE pos = 0
  UNION ALL
  SELECT k.file_id, k.pos, CASE WHEN cut THEN k.pos ELSE first END, CASE WHEN cut THEN k.start ELSE begin END FROM (
    SELECT k.*, walk.first, walk.begin, NOT coalesce(tied, false) AND (k.speaker != ps OR k.start - pz >= 2 * {DAY} OR k.z - walk.begin > 6 * {DAY} OR (pz - walk.begin >= {DAY} AND ends_with(pt, '.'))) AS cut
    FROM walk JOIN k ON k.file_id = walk.file_id AND k.pos = walk.pos + 1) k)
SELECT file_id, min(start) AS start, max(z) AS "end", min_by(speaker, pos) AS speaker, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n FROM walk JOIN k USING (file_id, pos) GROUP BY file_id, first
"""


def split(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as frames of a second, cut into chunks of 30 s at the least value of their last ten (WIN-4)."""
    w = words(spark, d)
    spans = w.groupBy("file_id").agg(F.lit(0.0).alias("start"), F.count("*").cast("double").alias("end"))
    return cutting.split_long(spans, w.select("file_id", F.col("pos").alias("frame"), F.col("score").alias("energy")), frame=1.0).select("file_id", "part", "start", "end")


SPLIT_SQL = f"""
WITH RECURSIVE f AS (SELECT file_id, pos AS frame, score AS energy FROM {Wd}), s AS (SELECT file_id, CAST(count(*) AS DOUBLE) AS e FROM f GROUP BY 1),
walk AS (
  SELECT file_id, CAST(0 AS BIGINT) AS part, CAST(0 AS DOUBLE) AS a, e FROM s
  UNION ALL
  SELECT w.file_id, w.part + 1, min(struct_pack(v := f.energy, at := f.frame)).at + 0.5, w.e FROM walk w JOIN f ON f.file_id = w.file_id AND f.frame >= w.a + 20 AND f.frame + 1 <= w.a + 30 WHERE w.e - w.a > 30 GROUP BY w.file_id, w.part, w.a, w.e)
SELECT file_id, part, a AS start, coalesce(lead(a) OVER (PARTITION BY file_id ORDER BY part), e) AS "end" FROM walk QUALIFY "end" - start > 0.001
"""


def turns_apart(spark: SparkSession, d: str) -> DataFrame:
    """Diarization error of a labelling that is late on two turns in three and takes every seventh turn for a third speaker (FN-10)."""
    s = segments(spark, d)
    late = 0.3 * (F.col("pos") % 3)
    heard = F.when(F.col("pos") % 7 == 3, "s2").otherwise(F.concat(F.lit("s"), (F.col("pos") % 2).cast("string")))
    ref = s.select(F.col("file_id").alias("item"), F.lit("ref").alias("side"), "start", "end", "speaker")
    hyp = s.select(F.col("file_id").alias("item"), F.lit("hyp").alias("side"), (F.col("start") + late).alias("start"), (F.col("end") + late).alias("end"), heard.alias("speaker"))
    return rounded(sequential.diarization_error(ref.unionByName(hyp)), "der")


TURNS_SQL = f"""
WITH t AS (SELECT file_id AS item, 'ref' AS side, speaker AS who, CAST(round_even(start * 100, 0) AS BIGINT) AS s, CAST(round_even("end" * 100, 0) AS BIGINT) AS e FROM {S}
  UNION ALL SELECT file_id, 'hyp', CASE WHEN pos % 7 = 3 THEN 's2' ELSE concat('s', pos % 2) END, CAST(round_even((start + 0.3::DOUBLE * (pos % 3)) * 100, 0) AS BIGINT), CAST(round_even(("end" + 0.3::DOUBLE * (pos % 3)) * 100, 0) AS BIGINT) FROM {S}),
o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY item, side, who ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM t WHERE s < e),
m AS (SELECT item, side, who, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY item, side, who ORDER BY s, e) AS g FROM o) GROUP BY item, side, who, g),
shut AS (SELECT DISTINCT item, unnest(range(greatest(0, x - 25), x + 25)) AS f FROM (SELECT item, unnest([s, e]) AS x FROM m WHERE side = 'ref')),
frames AS (SELECT DISTINCT item, side, who, unnest(range(s, e)) AS f FROM m), open AS (SELECT * FROM frames ANTI JOIN shut USING (item, f)),
n AS (SELECT item, f, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'hyp') AS h FROM open GROUP BY 1, 2),
sums AS (SELECT item, sum(r) AS total, sum(greatest(r, h)) AS most, sum(greatest(0, h - r)) AS extra FROM n GROUP BY 1),
pairs AS (SELECT a.item, a.who AS r, b.who AS h, count(*) AS w FROM open a JOIN open b ON a.item = b.item AND a.f = b.f AND a.side = 'ref' AND b.side = 'hyp' GROUP BY 1, 2, 3),
chosen AS (SELECT item, max(w) AS w FROM (SELECT item, w FROM pairs UNION ALL SELECT a.item, a.w + b.w FROM pairs a JOIN pairs b ON a.item = b.item AND a.r < b.r AND a.h != b.h
  UNION ALL SELECT a.item, a.w + b.w + c.w FROM pairs a JOIN pairs b ON a.item = b.item AND a.r < b.r AND a.h != b.h JOIN pairs c ON a.item = c.item AND b.r < c.r AND c.h NOT IN (a.h, b.h)) GROUP BY 1)
SELECT i.item, round(CASE WHEN total > 0 THEN (most - coalesce(w, 0)) / total WHEN extra > 0 THEN 1.0 ELSE 0.0 END, 6) AS der FROM (SELECT DISTINCT item FROM t) i LEFT JOIN sums USING (item) LEFT JOIN chosen USING (item)
"""


def near_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of every conversation that sound like one of its terms, by letters without accents (J-10)."""
    runs = transcript(spark, d).select("file_id", sounds.plain(F.col("text")).alias("g_s")).distinct()
    known = terms(spark, d).select("file_id", sounds.plain(F.col("term")).alias("t_s")).distinct()
    return rounded(matching.near_sounds(runs, known, ["file_id"], 0.35), "distance")


NEAR_SQL = f"""
WITH w AS (SELECT file_id, pos AS seg, unnest(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')) AS word, generate_subscripts(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), 1) AS i FROM {S}),
p AS (SELECT file_id, word, row_number() OVER (PARTITION BY file_id ORDER BY seg, i) - 1 AS pos FROM w),
k AS (SELECT file_id, word, min(pos) AS pos FROM p WHERE regexp_matches(word, '^[A-Z][a-z]{{5,}}$') GROUP BY 1, 2),
t AS (SELECT DISTINCT file_id, lower(word) AS t_s FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(word) DESC, pos) <= 5)),
g AS (SELECT DISTINCT file_id, regexp_replace(strip_accents(lower(word)), '[^a-z0-9]', '', 'g') AS g_s FROM p)
SELECT file_id, g_s, t_s, round(levenshtein(g_s, t_s) / greatest(length(g_s), length(t_s)), 6) AS distance FROM g JOIN t USING (file_id) WHERE levenshtein(g_s, t_s) <= 0.35 * greatest(length(g_s), length(t_s)) + 1e-9
"""


# ---------------------------------------------------------------- rendering and timing


def marked_text(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as words, some uncertain, of which every other has an alternative (FN-19)."""
    w = words(spark, d).select("file_id", "pos", "text", "unclear", F.when(F.col("event_id") % 14 == 0, F.when(F.col("event_id") % 5 == 0, "").otherwise(F.reverse("label"))).alias("alternative"))
    return render.unclear_text(w)


MARKED_SQL = f"""
WITH w AS (SELECT file_id, pos, text, unclear, CASE WHEN event_id % 14 = 0 THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE reverse(label) END END AS alt FROM {Wd}),
f AS (SELECT *, CASE WHEN unclear IS DISTINCT FROM lag(unclear) OVER o OR (unclear AND alt IS NOT NULL) THEN 1 ELSE 0 END AS fresh FROM w WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY pos) AS run FROM f),
p AS (SELECT file_id, run, bool_or(unclear) AS u, string_agg(text, ' ' ORDER BY pos) AS t, max(alt) AS alt FROM r GROUP BY 1, 2)
SELECT file_id, string_agg(CASE WHEN NOT u THEN t ELSE concat('[unclear: ', t, CASE WHEN alt IS NULL THEN '' WHEN alt = '' THEN ' | —' ELSE concat(' | ', alt) END, ']') END, ' ' ORDER BY run) AS text FROM p GROUP BY 1
"""


def agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far two engines' starts are apart on the words that both have, by label (AGG-22)."""
    w = words(spark, d)
    slots = w.select("label", F.when(F.col("event_id") % 3 == 0, "substitute").otherwise("agree").alias("kind"), (F.col("event_id") % 13 == 0).alias("blank"), F.col("start").alias("a_start"), F.when(F.col("event_id") % 17 != 0, F.col("start") + F.col("event_id") % 10).alias("b_start"))
    return rounded(fusion.timing_agreement(slots, "label"), "median", "p90")


def clamped(spark: SparkSession, d: str) -> DataFrame:
    """Segments within chunks that are too short for them (PRJ-18)."""
    s = segments(spark, d).select("file_id", F.col("pos").alias("chunk"), "start", "end")
    chunks = s.select("file_id", "chunk", (F.col("start") + 1).alias("start"), F.greatest(F.col("start") + 1, F.col("end") - 2).alias("end"))
    return rounded(selection.clamp_words(s, chunks), "start", "end")


def unlike(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites of turns, some of them of other words, and how many are taken and held back (CMP-7, FN-16)."""
    s = segments(spark, d).select("file_id", "pos", "text", "speaker")
    k = F.col("pos") % 4
    new = s.select("file_id", "pos", F.when(k == 0, F.concat("text", F.lit("!"))).when(k == 1, F.reverse("text")).when(k == 2, " ").otherwise(F.initcap("text")).alias("text"))
    return sequential.apply_refined(s, new).groupBy("speaker", k.alias("kind")).agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.count_if("guarded").alias("guarded"))


def kept_shots(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as shots of eight pixels, and how many slides each user has (TOP-9)."""
    thumb = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("event_id") * (i + 3) % 7 * 30 + F.col("event_id") % 11).cast("double"))
    shots = words(spark, d).select(F.col("file_id").alias("video_id"), F.col("pos").alias("shot"), thumb.alias("thumb"))
    return sequential.distinct_shots(shots).groupBy("video_id").agg(F.count("*").alias("shots"), F.count_distinct("slide").alias("slides"))


# ---------------------------------------------------------------- runs


def built_up(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of 20 cells of which so many are inked, those that only add joined (WIN-15)."""
    n = (F.col("event_id") % 21).cast("int")
    ink = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (i < n).cast("int"))
    frames = words(spark, d).select(F.col("file_id").alias("video_id"), "pos", ink.alias("ink"), "start", (F.col("start") + 1).alias("end"), F.array("event_id").alias("repeats"))
    return selection.collapse_builds(frames).select("video_id", "pos", "steps", F.size("spans").alias("spans"), F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x).alias("repeats"))


BUILT_UP_SQL = f"""
WITH f AS (SELECT file_id AS video_id, pos, event_id, event_id % 21 AS n, lag(event_id % 21) OVER (PARTITION BY file_id ORDER BY pos) AS p FROM {Wd}),
g AS (SELECT *, sum(CASE WHEN p > 0 AND p <= 10 AND n <= 10 AND n > 1.05 * p THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos) AS g FROM f)
SELECT video_id, max(pos) AS pos, count(*) AS steps, CAST(count(*) AS INTEGER) AS spans, CAST(sum(event_id) AS BIGINT) AS repeats FROM g GROUP BY video_id, g
"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as utterances of a language's corpus: runs of one source, and what lies ahead in each (WIN-18)."""
    u = table(spark, d, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("rn"), F.col("source").alias("block_key"), (F.length("text") / 14).alias("seconds"))
    return rounded(islands.conversation_blocks(u, 600.0).select("corpus", "rn", "block", "ahead", "valid_start"), "ahead")


BLOCKS_SQL = """
WITH u AS (SELECT lang AS corpus, doc_id AS rn, source AS k, length(text) / 14 AS s FROM documents),
f AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY corpus ORDER BY rn) THEN 0 ELSE 1 END AS fresh FROM u), b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY corpus ORDER BY rn) - 1 AS BIGINT) AS block FROM f),
a AS (SELECT corpus, rn, block, sum(s) OVER (PARTITION BY corpus, block ORDER BY rn DESC) AS ahead FROM b)
SELECT corpus, rn, block, round(ahead, 6) AS ahead, ahead >= 1.3 * 600 AS valid_start FROM a
"""


def last_ghosts(spark: SparkSession, d: str) -> DataFrame:
    """Words after the last real one of every day of a user (FN-15)."""
    w = words(spark, d).select("file_id", F.floor(F.col("start") / DAY).alias("chunk"), "pos", F.when(F.col("event_id") % 10 != 0, F.col("prob")).alias("prob"), (F.col("event_id") % 3 != 0).alias("inside"))
    return islands.ghosts_at_end(w).select("file_id", "chunk", "pos")


GHOSTS_SQL = f"""
WITH w AS (SELECT file_id, CAST(floor(start / {DAY}) AS BIGINT) AS chunk, pos, event_id % 3 != 0 AND (event_id % 10 = 0 OR prob >= 0.15) AS good FROM {Wd})
SELECT file_id, chunk, pos FROM w QUALIFY pos > coalesce(max(pos) FILTER (WHERE good) OVER (PARTITION BY file_id, chunk), -1)
"""


# ---------------------------------------------------------------- single rows


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Pages as media with titles and descriptions: what a refiner is shown of each, and as one text with hotwords (PRJ-14, PRJ-15)."""
    p = table(spark, d, "pages")
    site = F.when(F.col("page_id") % 3 == 0, "youtube").when(F.col("page_id") % 3 == 1, "x")
    meta = F.create_map(F.lit("youtube_title"), F.concat(F.lit(" "), "url"), F.lit("youtube_description"), "html", F.lit("x_channel"), F.col("page_id").cast("string"))
    c = parsing.refine_context(site, meta, F.lit("given "), F.when(F.col("page_id") % 2 == 0, "en"), F.lit(" "))
    hot = F.concat(F.col("page_id").cast("string"), F.lit(", ,"), F.lit("x"))
    return p.select("page_id", c.alias("c"), parsing.context_info(F.col("url"), hot).alias("info")).select("page_id", *[F.try_element_at("c", F.lit(k)).alias(k) for k in ("title", "channel", "description", "language", "notes")], "info")


CONTEXTS_SQL = """
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN nullif(trim(html), '') END AS h FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(url) ELSE 'given' END AS title, CASE WHEN page_id % 3 = 1 THEN CAST(page_id AS VARCHAR) END AS channel,
  CASE WHEN length(h) > 1500 THEN concat(rtrim(substr(h, 1, 1500)), ' ...') ELSE h END AS description, CASE WHEN page_id % 2 = 0 THEN 'en' END AS language, CAST(NULL AS VARCHAR) AS notes,
  concat(trim(url), chr(10), 'Hotwords: ', page_id, ', x') AS info FROM p
"""


def no_slides(spark: SparkSession, d: str) -> DataFrame:
    """Answers about documents that are nothing but the sentinel (PRJ-17)."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit(" **`NOT_A_SLIDE`**. "))).when(k == 1, F.concat(F.lit("NOT_A_SLIDE: "), "text")).when(k == 2, "NOT_A_SLIDE").otherwise(F.col("text"))
    return table(spark, d, "documents").groupBy("source", parsing.not_a_slide(said).alias("sentinel")).agg(F.count("*").alias("n"))


def profile_keys(spark: SparkSession, d: str) -> DataFrame:
    """The profile that each slice of the documents calibrates (PRJ-13)."""
    end = F.element_at(F.array(*map(F.lit, ("_clean", "_phone", "_noise", "_talks"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, "nospeech").otherwise(F.concat("lang", end)).alias("slice")).groupBy("slice", rules.slice_profile(F.col("slice")).alias("key")).agg(F.count("*").alias("n"))


PROFILES_SQL = """
WITH s AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'nospeech' ELSE concat(lang, (['_clean', '_phone', '_noise', '_talks'])[doc_id % 4 + 1]) END AS slice, CASE WHEN doc_id % 9 = 0 THEN '*' WHEN lang IN ('en', 'es') THEN concat(lang, (['', '-phone', '-noisy', ''])[doc_id % 4 + 1]) END AS key FROM documents)
SELECT slice, key, count(*) AS n FROM s GROUP BY 1, 2
"""


def unusable_windows(spark: SparkSession, d: str) -> DataFrame:
    """Why windows around turns can't be used, by role: half of the conversations end early, some times are unknown or swapped (FN-24)."""
    s = segments(spark, d)
    start, end = F.when(F.col("pos") % 5 != 3, F.col("start")), F.when(F.col("pos") % 7 == 2, F.col("start") - 1).otherwise(F.col("end"))
    return s.groupBy("speaker", rules.window_reason(start, end, F.when(F.col("file_id") % 2 == 0, 20.0).otherwise(1e9)).alias("reason")).agg(F.count("*").alias("n"))


REASONS_SQL = f"""
WITH s AS (SELECT speaker, CASE WHEN pos % 5 != 3 THEN start END AS a, CASE WHEN pos % 7 = 2 THEN start - 1 ELSE "end" END AS z, CASE WHEN file_id % 2 = 0 THEN 20.0 ELSE 1e9 END AS d FROM {S})
SELECT speaker, CASE WHEN a IS NULL OR z IS NULL THEN 'no time' WHEN z < a THEN 'ends before it begins' WHEN least(d, z + 0.3) <= greatest(0, a - 0.3) THEN 'outside the file' END AS reason, count(*) AS n FROM s GROUP BY 1, 2
"""


def lost_smoke(spark: SparkSession, d: str) -> DataFrame:
    """Smoke items of slices that have a manifest and lack them (J-13)."""
    docs = table(spark, d, "documents").select(F.col("source").alias("slice"), "doc_id", F.col("doc_id").cast("string").alias("id"))
    return selection.unmatched_smoke(docs.where("doc_id % 5 = 0").drop("doc_id"), docs.where("doc_id % 3 != 0").drop("doc_id"))


# ---------------------------------------------------------------- sources


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as manifests of their sources, audio relative to the root, and read back (SRC-1, SRC-2)."""
    path = f"{shared_folder(spark)}/manifest"
    docs = table(spark, d, "documents")
    audio = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/data/"), F.col("doc_id").cast("string"))).otherwise("/else/x")
    manifests.write_manifest(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("slice"), "lang", audio.alias("audio"), F.col("text").alias("reference"), (F.length("text") / 14).alias("duration")), path, "/data")
    read = manifests.rooted(manifests.read_manifest(spark, [path]), "/data")
    return read.groupBy("slice", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("audio").startswith("/data/")).alias("rooted"), F.sum(F.length("reference")).alias("chars"))


def engine_output(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as an engine's documents, chunks of words with flags, written as JSON and read back (SRC-12, SRC-4)."""
    path = f"{shared_folder(spark)}/outputs"
    w = transcript(spark, d)
    word = F.struct("text", "start", "end", F.when(F.col("pos") % 10 != 4, F.col("confidence")).alias("prob"), F.col("unclear"))
    chunks = w.groupBy("file_id", F.floor(F.col("pos") / 25).cast("string").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]).alias("words"))
    chunks.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "words"))).alias("chunks")).write.json(path)
    docs = manifests.read_outputs(spark, path, "file_id long, chunks map<string,array<struct<text:string,start:double,end:double,prob:double,unclear:boolean>>>", lines=True)
    return manifests.engine_words(docs).groupBy("file_id", "chunk").agg(F.count("*").alias("words"), F.count("prob").alias("sure"), F.count_if("unclear").alias("unclear"), F.min_by("text", "pos").alias("first"))


OUTPUT_SQL = f"""
WITH w AS (SELECT file_id, pos AS seg, unnest(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')) AS word, generate_subscripts(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), 1) AS i FROM {S}),
p AS (SELECT file_id, word, row_number() OVER (PARTITION BY file_id ORDER BY seg, i) - 1 AS pos FROM w)
SELECT file_id, CAST(pos // 25 AS INTEGER) AS chunk, count(*) AS words, count(*) FILTER (WHERE pos % 10 != 4) AS sure, count(*) FILTER (WHERE pos % 9 = 0) AS unclear, min_by(word, pos) AS first FROM p GROUP BY 1, 2
"""


# ---------------------------------------------------------------- table functions


def lateral_grams(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words of every turn beside it, in a lateral join, counted by role."""
    tables.register(spark)
    sql = "SELECT t.speaker, g.n, count(*) AS grams, count(DISTINCT g.gram) AS kinds, count(g.w2) AS seconds, max(g.pos) AS furthest FROM {turns} t, LATERAL word_grams(t.text, 2) g GROUP BY 1, 2"
    return spark.sql(sql, turns=segments(spark, d))


GRAMS_SQL = f"""
WITH w AS (SELECT file_id, pos AS seg, speaker, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') AS w FROM {S}),
g AS (SELECT speaker, i AS pos, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM w, range(len(w)) r(i), range(1, 3) m(n) WHERE i + n <= len(w))
SELECT speaker, CAST(n AS INTEGER) AS n, count(*) AS grams, count(DISTINCT gram) AS kinds, count(*) FILTER (WHERE n = 2) AS seconds, CAST(max(pos) AS INTEGER) AS furthest FROM g GROUP BY 1, 2
"""


def sliding_words(spark: SparkSession, d: str) -> DataFrame:
    """Every three events in a row of a user, by a table function that asks for its partitioning."""
    tables.register(spark)
    return spark.sql("SELECT * FROM word_windows(TABLE(SELECT file_id, pos, text FROM {w}), 3)", w=words(spark, d))


JOBS = {
    "lateral_grams": (lateral_grams, GRAMS_SQL),
    "sliding_words": (sliding_words, f"SELECT file_id, pos AS first, lead(pos, 2) OVER w AS last, concat_ws(' ', text, lead(text) OVER w, lead(text, 2) OVER w) AS words FROM {Wd} WINDOW w AS (PARTITION BY file_id ORDER BY pos) QUALIFY last IS NOT NULL"),
    "build_segments": (built, BUILT_SQL),
    "split_long": (split, SPLIT_SQL),
    "diarization_error": (turns_apart, TURNS_SQL),
    "near_sounds": (near_words, NEAR_SQL),
    "unclear_text": (marked_text, MARKED_SQL),
    "timing_agreement": (agreement, f"SELECT label, round(quantile_cont(event_id % 10, 0.5), 6) AS median, round(quantile_cont(event_id % 10, 0.9), 6) AS p90, count(*) AS matched FROM {Wd} WHERE event_id % 3 != 0 AND event_id % 13 != 0 AND event_id % 17 != 0 GROUP BY 1"),
    "clamp_words": (clamped, f'SELECT file_id, pos AS chunk, round(start + 1, 6) AS start, round(greatest(start + 1, least("end", greatest(start + 1, "end" - 2))), 6) AS "end" FROM {S}'),
    "refined_segments": (unlike, None),
    "distinct_shots": (kept_shots, f"SELECT file_id AS video_id, count(*) AS shots, count(DISTINCT event_id % 7) AS slides FROM {Wd} GROUP BY 1"),
    "collapse_builds": (built_up, BUILT_UP_SQL),
    "conversation_blocks": (blocks, BLOCKS_SQL),
    "trailing_ghosts": (last_ghosts, GHOSTS_SQL),
    "refine_context": (contexts, CONTEXTS_SQL),
    "not_a_slide": (no_slides, "SELECT source, doc_id % 4 IN (0, 2) AS sentinel, count(*) AS n FROM documents GROUP BY 1, 2"),
    "slice_profile": (profile_keys, PROFILES_SQL),
    "window_reason": (unusable_windows, REASONS_SQL),
    "unmatched_smoke": (lost_smoke, "SELECT source AS slice, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 = 0"),
    "manifest_rows": (manifest_rows, "SELECT source AS slice, lang, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS rooted, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2"),
    "engine_words": (engine_output, OUTPUT_SQL),
}
