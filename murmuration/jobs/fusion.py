"""Jobs on two engines' words, on signals, frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import rules
from murmuration.jobs.domain import PAIRED, WORDS, duck_table, spark_table
from murmuration.operators import fusion, intervals, islands, signal
from murmuration.streaming import run, windows

Wd, P = duck_table(WORDS), duck_table(PAIRED)


def words(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, WORDS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- alignment and decisions


def engines(spark: SparkSession, d: str) -> DataFrame:
    """Engine a hears every word of the conversations; engine b drops and garbles some. A chunk is a turn."""
    said = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk"), F.posexplode(F.split("text", r"\s+")).alias("pos", "text"))
    a = said.withColumns({"engine": F.lit("a"), "prob": F.lit(0.9)})
    b = said.where("pos % 11 != 3").withColumns({"text": F.when(F.col("pos") % 7 == 2, F.reverse("text")).otherwise(F.col("text")), "engine": F.lit("b"), "prob": F.when(F.col("pos") % 5 == 0, 0.4).otherwise(0.8)})
    return a.unionByName(b)


def slots(spark: SparkSession, d: str) -> DataFrame:
    """Events as slots of a chunk per day."""
    kind = F.element_at(F.array(*map(F.lit, ("agree", "agree", "substitute", "a_only", "agree"))), (F.col("event_id") % 5 + 1).cast("int"))
    return words(spark, d).select("file_id", F.floor(F.col("start") / 86400).alias("chunk"), "pos", kind.alias("kind"), F.col("prob").alias("pa"), F.when(F.col("event_id") % 3 == 0, F.col("prob") + 0.3).alias("pb"))


SLOTS = f"(SELECT file_id, CAST(floor(start / 86400) AS BIGINT) AS chunk, pos, (['agree', 'agree', 'substitute', 'a_only', 'agree'])[event_id % 5 + 1] AS kind, prob AS pa, CASE WHEN event_id % 3 = 0 THEN prob + 0.3 END AS pb FROM {Wd})"
SPANS_SQL = f"""
WITH s AS (SELECT *, kind = 'agree' AND least(pa, coalesce(pb, 1)) >= 0.5 AS solid, kind = 'substitute' OR (kind = 'agree' AND least(pa, coalesce(pb, 1)) < 0.5) AS disputed FROM {SLOTS}),
f AS (SELECT *, CASE WHEN solid OR lag(solid) OVER w OR chunk != lag(chunk) OVER w THEN 1 ELSE 0 END AS fresh, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY file_id ORDER BY chunk, pos)),
i AS (SELECT *, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE fresh END) OVER (PARTITION BY file_id ORDER BY chunk, pos) - 1 AS BIGINT) AS span_id FROM f)
SELECT file_id, span_id, min(chunk) AS chunk, min(pos) AS first, max(pos) AS last, CASE WHEN bool_or(solid) THEN 'solid' WHEN bool_or(disputed) THEN 'disputed' ELSE 'missing' END AS tier FROM i GROUP BY 1, 2
"""


def sub_words(spark: SparkSession, d: str) -> DataFrame:
    t = words(spark, d).select("file_id", F.floor(F.col("pos") / 40).alias("chunk"), "pos", F.concat(F.when(F.col("event_id") % 3 == 0, " ").otherwise(""), F.col("label")).alias("text"), "start", (F.col("start") + 1).alias("end"), F.when(F.col("event_id") % 4 != 0, F.col("prob")).alias("confidence"))
    return islands.words_from_tokens(t).select("file_id", "chunk", "word", "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "prob")


SUB_SQL = f"""
WITH t AS (SELECT file_id, pos // 40 AS chunk, pos, concat(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END, label) AS text, start, CASE WHEN event_id % 4 != 0 THEN prob END AS confidence FROM {Wd}),
i AS (SELECT *, CAST(sum(CASE WHEN starts_with(text, ' ') OR pos % 40 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, chunk ORDER BY pos) - 1 AS BIGINT) AS word FROM t)
SELECT file_id, chunk, word, trim(string_agg(text, '' ORDER BY pos)) AS text, round(min(start), 3) AS start, round(max(start) + 1, 3) AS "end", min(confidence) AS prob FROM i GROUP BY 1, 2, 3
"""


def span_table(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = words(spark, d)
    spans = w.select("file_id", F.col("pos").alias("span_id"), F.when(F.col("event_id") % 8 == 0, "b").alias("guarded"), "label")
    choice = F.element_at(F.array(*map(F.lit, ("a", "b", "unclear"))), (F.col("event_id") % 3 + 1).cast("int"))
    picks = w.where("event_id % 6 != 1").select("file_id", F.col("pos").alias("span_id"), choice.alias("choice"))
    scores = w.where("event_id % 10 != 7").select("file_id", F.col("pos").alias("span_id"), F.col("score").alias("sa"), (F.col("event_id") % 60).cast("double").alias("sb"))
    return spans, picks, scores


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """The same spans decided at several margins (CMP-13)."""
    spans, picks, scores = span_table(spark, d)
    margins = spark.createDataFrame([(0.0,), (5.0,), (20.0,)], "margin double")
    decided = fusion.resolve(spans.crossJoin(F.broadcast(margins)), picks, scores, F.col("margin"))  # three margins
    return decided.groupBy("margin", "label").agg(F.count_if(F.col("side") == "b").alias("b_wins"), F.count_if("unclear").alias("unclear"), F.round(F.avg("confidence"), 6).alias("confidence"))


DECIDE = """
x AS (SELECT w.file_id, w.pos AS span_id, label, margin, CASE WHEN event_id % 8 = 0 THEN 'b' END AS guarded, CASE WHEN event_id % 6 != 1 THEN (['a', 'b', 'unclear'])[event_id % 3 + 1] END AS choice,
  CASE WHEN event_id % 10 != 7 THEN score END AS sa, CASE WHEN event_id % 10 != 7 THEN CAST(event_id % 60 AS DOUBLE) END AS sb FROM {w} w, m),
y AS (SELECT *, coalesce(choice IN ('a', 'b'), false) AS picked FROM x),
z AS (SELECT *, CASE WHEN sa IS NULL THEN CASE WHEN picked THEN choice ELSE 'a' END WHEN picked THEN CASE WHEN choice = 'a' THEN CASE WHEN sb > sa + margin THEN 'b' ELSE 'a' END ELSE CASE WHEN sa > sb + margin THEN 'a' ELSE 'b' END END
  WHEN sa > sb THEN 'a' WHEN sb > sa THEN 'b' ELSE 'a' END AS win FROM y),
q AS (SELECT *, win = 'b' AND guarded = 'b' AND (sa IS NULL OR sb - sa < 2 * margin) IS TRUE AS kept FROM z),
r AS (SELECT *, CASE WHEN coalesce(kept, false) THEN 'a' ELSE win END AS side, CASE WHEN sa IS NULL THEN true ELSE NOT picked AND (abs(sa - sb) <= margin OR coalesce(kept, false)) END AS unclear FROM q),
d AS (SELECT *, CASE WHEN sa IS NULL THEN CASE WHEN picked THEN 'pick' ELSE side END WHEN NOT unclear AND picked AND side = choice THEN 'pick' ELSE 'verify' END AS source FROM r),
e AS (SELECT *, CASE WHEN unclear THEN 0.3 WHEN source = 'pick' THEN 0.7 ELSE 0.6 END AS confidence FROM d)
""".replace("{w}", Wd)


def trust(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).select("file_id", F.when(F.col("event_id") % 4 != 0, "agree").otherwise("pick").alias("source"), "unclear", F.col("prob").alias("confidence"))
    f = fusion.trust_features(w)
    score, level = rules.trust_score(F.col("agreement"), F.col("unclear_rate") / 10, F.when(F.col("file_id") % 5 == 0, 1).otherwise(0))
    return rounded(f.withColumns({"trust": score, "level": level}), "agreement", "unclear_rate", "confidence", "trust")


def configured(spark: SparkSession, d: str) -> DataFrame:
    p = spark_table(spark, d, PAIRED)
    keys = p.select("id", F.concat(F.lit("k"), (F.length("id") % 3).cast("string")).alias("key")).distinct()
    ladder = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey < 3").select(F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("key"), F.when(F.col("r_regionkey") % 2 == 0, "F").otherwise("O").alias("system"))
    return fusion.compose(p, keys, ladder).groupBy("slice", "system").agg(F.count("*").alias("n"), F.round(F.avg("wer"), 6).alias("mean"))


# ---------------------------------------------------------------- signals


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    loud, rest = F.filter(e, lambda x: x > 0), F.filter(e, lambda x: x <= 0)
    energy = signal.frame_energy(e, 10)
    df = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id"), signal.dbfs(e).alias("dbfs"), signal.snr_db(loud, rest).alias("snr"), F.size(energy).alias("frames"), F.array_min(energy).alias("quietest"), F.array_max(signal.mix_at_snr(e, F.slice(e, 1, 7), F.lit(10.0))).alias("peak"))
    return rounded(df, "dbfs", "snr", "quietest", "peak")


SIGNAL_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_filter(embedding, lambda x: x > 0) AS l, list_filter(embedding, lambda x: x <= 0) AS r FROM embeddings),
t AS (SELECT *, list_transform(range(0, len(e)), lambda i: e[i % 7 + 1]) AS n, list_transform(range(0, len(e) // 10), lambda i: list_avg(list_transform(e[10 * i + 1:10 * i + 10], lambda x: x * x))) AS f FROM e),
p AS (SELECT *, list_avg(list_transform(e, lambda x: x * x)) AS ps, list_avg(list_transform(n, lambda x: x * x)) AS pn FROM t),
m AS (SELECT *, list_transform(range(1, len(e) + 1), lambda i: e[i] + n[i] * sqrt(ps / (pn * 10))) AS mixed FROM p)
SELECT vec_id, round(20 * log10(greatest(sqrt(ps), 1e-12)), 6) AS dbfs, round(10 * log10(greatest(list_avg(list_transform(l, lambda x: x::DOUBLE * x::DOUBLE)), 1e-12) / greatest(list_avg(list_transform(r, lambda x: x::DOUBLE * x::DOUBLE)), 1e-12)), 6) AS snr,
  len(f) AS frames, round(list_min(f), 6) AS quietest, round(CASE WHEN list_max(list_transform(mixed, lambda x: abs(x))) > 0.99 THEN list_max(mixed) * 0.99 / list_max(list_transform(mixed, lambda x: abs(x))) ELSE list_max(mixed) END, 6) AS peak FROM m
"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as thumbnails: twenty a video, each held for three seconds."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 20).alias("video_id"), (F.col("vec_id") % 20).alias("second"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 40)).alias("thumb"))


FRAMES = "(SELECT vec_id // 20 AS video_id, vec_id % 20 AS second, list_transform(embedding, lambda x: floor(x::DOUBLE * 40)) AS thumb FROM embeddings)"
CHANGED = f"(SELECT video_id, second, thumb, lag(thumb) OVER (PARTITION BY video_id ORDER BY second) AS p FROM {FRAMES})"

# ---------------------------------------------------------------- streams


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of the events stream, drained once; windows that the watermark hasn't passed aren't out yet."""
    e = run.events(spark, d).select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 100).cast("long").alias("value"))
    out = run.drained(windows.sliding_counts(e, "1 hour", "20 hours", "18 hours"))
    return out.select("file_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n", "total")


STREAM_SQL = """
WITH e AS (SELECT user_id AS file_id, epoch_us(ts) AS t, CAST(trunc(value * 100) AS BIGINT) AS v FROM events), w AS (SELECT *, (t // 1000000) // 64800 * 64800 AS s FROM e),
x AS (SELECT file_id, s - k * 64800 AS start, v FROM w, (VALUES (0), (1)) b(k) WHERE t < (s - k * 64800 + 72000) * 1000000::BIGINT)
SELECT file_id, CAST(start AS BIGINT) AS start, CAST(start + 72000 AS BIGINT) AS "end", count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM x WHERE (start + 72000) * 1000000::BIGINT <= (SELECT max(t) // 1000 * 1000 - 3600000000 FROM e) GROUP BY file_id, x.start
"""


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = run.events(spark, d).select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = run.drained(windows.pause_sessions(e, "1 hour", "3 hours"))
    return out.groupBy("file_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


SESSIONS_SQL = """
WITH e AS (SELECT user_id AS file_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY file_id ORDER BY t) <= 10800000000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM f), x AS (SELECT file_id, g, max(t) + 10800000000 AS z, count(*) AS n FROM s GROUP BY 1, 2)
SELECT file_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM x WHERE z <= (SELECT max(t) // 1000 * 1000 - 3600000000 FROM e) GROUP BY 1
"""


def speech_windows(spark: SparkSession, d: str) -> DataFrame:
    speech = words(spark, d).where("label = 'click'").select("file_id", "start", (F.col("start") + 60).alias("end"))
    return intervals.speech_windows(intervals.merge_intervals(speech, ["file_id"]), 300.0).select("file_id", "window", (F.round(F.col("start") * 1000) / 1000).alias("start"))  # halves of a millisecond as the SQL rounds them


JOBS = {
    "align_engines": (lambda s, d: fusion.align_engines(engines(s, d)).groupBy("kind").agg(F.count("*").alias("n")), None),
    "spans": (lambda s, d: islands.group_spans(slots(s, d)), SPANS_SQL),
    "token_words": (sub_words, SUB_SQL),
    "resolve": (
        lambda s, d: fusion.resolve(*span_table(s, d), F.lit(5.0)).select("file_id", "span_id", "side", "source", "unclear", "confidence"),
        f"WITH m(margin) AS (VALUES (5.0::DOUBLE)), {DECIDE} SELECT file_id, span_id, side, source, unclear, CAST(confidence AS DOUBLE) AS confidence FROM e",
    ),
    "margin_sweep": (sweep, f"WITH m(margin) AS (VALUES (0.0::DOUBLE), (5.0), (20.0)), {DECIDE} SELECT margin, label, count(*) FILTER (WHERE side = 'b') AS b_wins, count(*) FILTER (WHERE unclear) AS unclear, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence FROM e GROUP BY 1, 2"),
    "trust": (
        trust,
        f"""WITH f AS (SELECT file_id, avg(CASE WHEN event_id % 4 != 0 THEN 1.0 ELSE 0 END) AS agreement, avg(CASE WHEN unclear THEN 1.0 ELSE 0 END) AS unclear_rate, avg(prob) AS confidence, CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS k FROM {Wd} GROUP BY file_id),
        t AS (SELECT *, greatest(0, least(1, 0.5 * (1 - agreement) + unclear_rate / 10 + 0.05 * k)) AS trust FROM f)
        SELECT file_id, round(agreement, 6) AS agreement, round(unclear_rate, 6) AS unclear_rate, round(confidence, 6) AS confidence, round(trust, 6) AS trust, (['high', 'medium', 'low', 'low'])[CASE WHEN trust < 0.08 THEN 0 WHEN trust < 0.2 THEN 1 ELSE 2 END + k + 1] AS level FROM t""",
    ),
    "compose_configured": (
        configured,
        f"WITH p AS {P}, l AS (SELECT concat('k', r_regionkey) AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'F' ELSE 'O' END AS system FROM region WHERE r_regionkey < 3) SELECT slice, p.system, count(*) AS n, round(avg(wer), 6) AS mean FROM p JOIN l ON l.key = concat('k', length(id) % 3) AND l.system = p.system GROUP BY 1, 2",
    ),
    "signals": (signals, SIGNAL_SQL),
    "shots": (
        lambda s, d: signal.shots(frames(s, d), 0.6, 2, 4.0),
        f"WITH c AS (SELECT *, CASE WHEN p IS NOT NULL AND list_sum(list_transform(range(1, len(thumb) + 1), lambda i: CASE WHEN abs(thumb[i] - p[i]) > 4 THEN 1 ELSE 0 END)) / len(thumb) <= 0.6 THEN 0 ELSE 1 END AS cut FROM {CHANGED}), s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY video_id ORDER BY second) AS BIGINT) AS shot FROM c) SELECT video_id, shot, min(second) AS first, max(second) AS last, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
    "motion": (
        lambda s, d: rounded(signal.motion(frames(s, d), 4.0, 4.0), "rate").drop("soft_rate", "periods"),
        f"WITH c AS (SELECT video_id, unnest(list_filter(list_transform(range(0, len(thumb)), lambda i: CASE WHEN abs(thumb[i + 1] - p[i + 1]) > 4 THEN i END), lambda x: x IS NOT NULL)) AS pixel FROM {CHANGED} WHERE p IS NOT NULL), n AS (SELECT video_id, count(*) - 1 AS n FROM {FRAMES} GROUP BY 1) SELECT video_id, CAST(pixel AS INTEGER) AS pixel, round(count(*) / any_value(n), 6) AS rate FROM c JOIN n USING (video_id) GROUP BY 1, 2",
    ),
    "speech_windows": (
        speech_windows,
        f"""WITH s AS (SELECT file_id, start, start + 60 AS e FROM {Wd} WHERE label = 'click'), f AS (SELECT *, CASE WHEN start - max(e) OVER (PARTITION BY file_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0 THEN 0 ELSE 1 END AS fresh FROM s),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY start, e) AS g FROM f), m AS (SELECT file_id, g, min(start) AS s, max(e) AS e FROM i GROUP BY 1, 2), c AS (SELECT *, e - s AS d, sum(e - s) OVER (PARTITION BY file_id ORDER BY s) - (e - s) AS cum, sum(e - s) OVER (PARTITION BY file_id) AS total FROM m),
        o AS (SELECT DISTINCT file_id, total, CASE WHEN total <= 300 THEN 1 ELSE least(5, ceil(total / 300)) END AS n FROM c), k AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS w FROM o)
        SELECT k.file_id, CAST(w AS INTEGER) AS "window", round(s + (CASE WHEN n = 1 THEN 0 ELSE w * (k.total - 300) / (n - 1) END) - cum, 3) AS start FROM k JOIN c ON c.file_id = k.file_id AND (CASE WHEN n = 1 THEN 0 ELSE w * (k.total - 300) / (n - 1) END) >= cum AND (CASE WHEN n = 1 THEN 0 ELSE w * (k.total - 300) / (n - 1) END) < cum + d""",
    ),
    "stream_windows": (stream_windows, STREAM_SQL),
    "stream_sessions": (stream_sessions, SESSIONS_SQL),
}
