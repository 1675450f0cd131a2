"""Grading systems, comparing them and building the corpus to grade them on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import edits, rules
from murmuration.functions import text as T
from murmuration.jobs.domain import ITEMS, PAIRED, RECORDS, duck_table, spark_table
from murmuration.operators import corpus, metrics, scoring

R, P, I = duck_table(RECORDS), duck_table(PAIRED), duck_table(ITEMS)  # noqa: E741


def records(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, RECORDS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- word errors


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """References and two systems' outputs of every document: words dropped and swapped at fixed places."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "source", "lang", F.col("text").alias("ref"), T.tokens(F.col("text")).alias("_w"))
    changed = lambda drop, swap: F.array_join(F.transform(F.filter("_w", lambda x, i: i % drop != drop - 1), lambda x, i: F.when(i % swap == swap - 1, F.reverse(x)).otherwise(x)), " ")
    both = F.array(F.struct(F.lit("one").alias("system"), changed(9, 7).alias("hyp")), F.struct(F.lit("two").alias("system"), changed(13, 5).alias("hyp")))
    return docs.select("id", "source", "lang", "ref", F.explode(both).alias("o")).select("id", "source", "lang", "ref", "o.*")


def wer_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """Pooled word error rate by source and system over whole, normalized texts. Rows are dealt by hash of the document, so long texts don't follow each other."""
    graded = scoring.word_errors(edits.spread(hypotheses(spark, d), "id"), ("ref", "hyp"))
    sums = graded.groupBy("source", "system").agg(*[F.sum(c).alias(c) for c in ("sub", "del", "ins", "hits", "words")])
    return rounded(sums.withColumn("wer", metrics.share(F.col("sub") + F.col("del") + F.col("ins"), F.col("words"))), "wer")


def disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Word error rate of one system against the other, by language (CMP-12)."""
    h = hypotheses(spark, d)
    one = h.where("system = 'one'").select("id", "lang", F.col("hyp").alias("ref"))
    two = h.where("system = 'two'").select("id", "hyp")
    sums = scoring.word_errors(edits.spread(one.join(two, "id"), "id"), ("ref", "hyp")).groupBy("lang").agg(F.sum(F.col("sub") + F.col("del") + F.col("ins")).alias("errors"), F.sum("words").alias("words"))
    return rounded(sums.withColumn("rate", metrics.share(F.col("errors"), F.col("words"))), "rate")


def stage_effects(spark: SparkSession, d: str) -> DataFrame:
    """Help, harm and neutral edits between the two systems' outputs, by language (FN-8, AGG-7)."""
    h = hypotheses(spark, d)
    one, two = h.where("system = 'one'").select("id", "lang", "ref", F.col("hyp").alias("before")), h.where("system = 'two'").select("id", F.col("hyp").alias("after"))
    return rounded(metrics.harm_rates(scoring.text_effects(edits.spread(one.join(two, "id"), "id"), ("ref", "before", "after")), "lang"), "harm_rate")


# ---------------------------------------------------------------- records

POOLED = """
count(*) FILTER (WHERE ran) AS n, count(skipped) AS n_skipped, count(error) AS n_errors,
round(sum(sub + del + ins) FILTER (WHERE ran AND NOT empty_ref) / nullif(sum(words) FILTER (WHERE ran AND NOT empty_ref), 0), 6) AS wer,
round(sum(char_errors) FILTER (WHERE ran AND NOT empty_ref) / nullif(sum(chars) FILTER (WHERE ran AND NOT empty_ref), 0), 6) AS cer,
round(sum(missed) FILTER (WHERE ran AND NOT empty_ref) / nullif(sum(entities) FILTER (WHERE ran AND NOT empty_ref), 0), 6) AS entity_error,
round(sum(ins) FILTER (WHERE ran AND empty_ref) / nullif(sum(duration) FILTER (WHERE ran AND empty_ref) / 60, 0), 6) AS ins_per_min,
round(sum(duration) FILTER (WHERE ran) / nullif(sum(seconds) FILTER (WHERE ran), 0), 6) AS xrt, round(max(rss) FILTER (WHERE ran AND rss > 0), 6) AS rss
"""
RAN = f"(SELECT *, skipped IS NULL AND error IS NULL AS ran FROM {R})"
RATES = ("wer", "cer", "entity_error", "ins_per_min", "xrt", "rss")


def diarization(spark: SparkSession, d: str) -> DataFrame:
    with_der = records(spark, d).withColumn("der", F.when(F.col("entities") > 0, F.col("missed") / F.col("entities")))
    return rounded(metrics.weighted_der(with_der, "slice", "system"), "der")


def unclear(spark: SparkSession, d: str) -> DataFrame:
    df = records(spark, d).withColumns({"flagged": F.col("sub") + F.col("missed"), "flagged_errors": F.col("missed"), "errors": F.col("sub") + F.col("del") + F.col("missed")})
    return rounded(metrics.unclear_quality(df, "slice", "system"), "precision", "recall", "density")


def harm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.harm_rates(records(spark, d).withColumns({"help": F.col("sub"), "harm": F.col("missed"), "neutral": F.col("ins")}), "system", "split"), "harm_rate")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    p = spark_table(spark, d, PAIRED)
    return metrics.pair_records(p.where("system = 'F'"), p.where("system = 'O'"))


def rises(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """How much more the second system's records harm, by split as stage, and insert where nothing is said."""
    r = records(spark, d).withColumns({"stage": F.col("split"), "help": F.col("sub"), "harm": F.col("missed"), "neutral": F.col("ins")})
    base, cand = r.where("system = 'F'"), r.where("system = 'O'")
    return metrics.harm_rise(base, cand), metrics.insertion_rise(base, cand)


def shared_ids(spark: SparkSession, d: str) -> DataFrame:
    p = spark_table(spark, d, PAIRED).withColumns({"skipped": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return metrics.restricted(p, ["F", "O"]).groupBy("slice", "system").agg(F.count("*").alias("n"), F.round(F.avg("wer"), 6).alias("mean"))


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    df = records(spark, d).select("slice", F.col("words").alias("x"), (F.col("char_errors") + F.col("sub")).alias("y"))
    return rounded(metrics.spearman(df, "x", "y", "slice"), "rho")


def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Routing key of every customer as a file, and the profile it falls back to."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    lang = F.element_at(F.array(*map(F.lit, ("en", "es", "fr", "de"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    key = rules.routing_key(lang, F.col("c_custkey") % 13 == 0, F.col("c_nationkey") % 3 == 0, F.col("c_custkey") % 20)
    profiles = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 4").select(F.element_at(F.array(*map(F.lit, ("en", "es", "en-phone", "*"))), F.col("n_nationkey") + 1).alias("key"), (F.col("n_nationkey") / 10).alias("margin"))
    return metrics.select_profile(c.select("c_custkey", key.alias("routing_key")), profiles)


def regression(spark: SparkSession, d: str) -> DataFrame:
    """Trust weights per slice set from sums of products, as one row."""
    df = records(spark, d).where("skipped is null and error is null").select((F.col("char_errors") / 10.0).alias("y"), F.col("sub").cast("double").alias("a"), F.col("del").cast("double").alias("b"), F.lit(1.0).alias("flat"))
    got = metrics.least_squares(df, "y", ["a", "b", "flat"])
    base, weights = got if got else (None, {})
    return spark.createDataFrame([(base, weights.get("a"), weights.get("b"))], "intercept double, a double, b double").select(*[F.round(c, 6).alias(c) for c in ("intercept", "a", "b")])


# ---------------------------------------------------------------- corpus


def items(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, ITEMS)


def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("slice", T.assign_split(F.col("id")).alias("side")).agg(F.count("*").alias("n"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", T.fingerprint(id=F.col("id"), lang=F.col("lang"), duration=F.col("duration")).alias("fingerprint"))


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Items whose output is missing or made from something else."""
    i = fingerprints(spark, d).withColumn("system", F.lit("one"))
    n = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    outputs = i.where(n % 5 != 0).withColumn("fingerprint", F.when(n % 7 == 0, "old").otherwise(F.col("fingerprint")))
    return corpus.pending(i, outputs).select("id")


NOISE = [(k, s) for k in ("babble", "pink", "room") for s in (5, 10, 20)]
NOISE_SQL = ", ".join(f"({i}, '{k}', {s})" for i, (k, s) in enumerate(NOISE))

#: The greedy choice item by item: every slice's items from long to short, with the lead of dev carried along.
BALANCED_SQL = f"""
WITH RECURSIVE i AS (SELECT slice, CAST(duration AS DOUBLE) AS d, row_number() OVER (PARTITION BY slice ORDER BY duration DESC, id) AS n FROM {I}),
g AS (SELECT slice, n, d, true AS to_dev, d AS lead FROM i WHERE n = 1 UNION ALL SELECT i.slice, i.n, i.d, g.lead <= 0, g.lead + CASE WHEN g.lead <= 0 THEN i.d ELSE -i.d END FROM g JOIN i ON i.slice = g.slice AND i.n = g.n + 1)
SELECT slice, CASE WHEN to_dev THEN 'dev' ELSE 'test' END AS split, count(*) AS n, sum(d) AS seconds FROM g GROUP BY 1, 2
"""

JOBS = {
    "wer_by_slice": (wer_by_slice, None),
    "system_disagreement": (disagreement, None),
    "stage_effects": (stage_effects, None),
    "records_by_slice": (lambda s, d: rounded(metrics.by_keys(records(s, d), "slice", "system"), *RATES), f"SELECT slice, system, {POOLED} FROM {RAN} GROUP BY slice, system"),
    "grouping_sets_report": (
        lambda s, d: rounded(metrics.report(records(s, d)), *RATES).withColumn("level", F.col("level").cast("int")),
        f"SELECT slice, system, split, CAST(grouping(slice, system, split) AS INTEGER) AS level, {POOLED} FROM {RAN} GROUP BY GROUPING SETS ((slice, system), (slice, system, split), (system), (system, split))",
    ),
    "der_by_slice": (diarization, f"WITH x AS (SELECT *, CASE WHEN entities > 0 THEN missed / entities END AS q FROM {R}) SELECT slice, system, round(sum(q * duration) FILTER (WHERE q IS NOT NULL) / sum(duration) FILTER (WHERE q IS NOT NULL), 6) AS der, count(*) FILTER (WHERE q IS NULL) AS der_missing FROM x GROUP BY slice, system"),
    "unclear_quality": (unclear, f"WITH x AS (SELECT slice, system, sum(sub + missed) AS flagged, sum(missed) AS flagged_errors, sum(sub + del + missed) AS errors, sum(words) AS words FROM {R} GROUP BY 1, 2) SELECT slice, system, CAST(flagged AS BIGINT) AS flagged, CAST(flagged_errors AS BIGINT) AS flagged_errors, CAST(errors AS BIGINT) AS errors, CAST(words AS BIGINT) AS words, round(flagged_errors / nullif(flagged, 0), 6) AS precision, round(flagged_errors / nullif(errors, 0), 6) AS recall, round(flagged / nullif(words, 0), 6) AS density FROM x"),
    "harm_rate": (harm, f"SELECT system, split, CAST(sum(sub) AS BIGINT) AS help, CAST(sum(missed) AS BIGINT) AS harm, CAST(sum(ins) AS BIGINT) AS neutral, round(sum(missed) / nullif(sum(sub) + sum(missed) + sum(ins), 0), 6) AS harm_rate FROM {R} GROUP BY system, split"),
    "gate_pairs": (
        lambda s, d: rounded(metrics.pair_counts(pairs(s, d)), "mean_delta"),
        f"WITH p AS {P} SELECT coalesce(b.slice, c.slice) AS slice, count(*) FILTER (WHERE b.id IS NOT NULL AND c.id IS NOT NULL) AS shared, count(*) FILTER (WHERE c.id IS NULL) AS base_only, count(*) FILTER (WHERE b.id IS NULL) AS cand_only, round(avg(c.wer - b.wer), 6) AS mean_delta FROM (SELECT * FROM p WHERE system = 'F') b FULL JOIN (SELECT * FROM p WHERE system = 'O') c ON b.id = c.id GROUP BY 1",
    ),
    "paired_restrict": (shared_ids, f"WITH p AS {P} SELECT slice, system, count(*) AS n, round(avg(wer), 6) AS mean FROM p WHERE id IN (SELECT id FROM p GROUP BY id HAVING count(DISTINCT system) = 2) GROUP BY 1, 2"),
    "bootstrap_ci": (lambda s, d: rounded(metrics.bootstrap(pairs(s, d).where("side = 'both'").select("slice", "id", (F.col("wer_c") - F.col("wer_b")).alias("d")), "d", "slice"), "mean", "lo", "hi"), None),
    "gate_verdict": (lambda s, d: metrics.gate(pairs(s, d), *rises(s, d)), None),
    "gate_slices": (lambda s, d: rounded(metrics.gate_slices(pairs(s, d)), "mean_delta", "lo", "hi"), None),
    "harm_rise": (
        lambda s, d: rounded(rises(s, d)[0], "base", "cand", "delta"),
        f"WITH r AS (SELECT split AS stage, sum(missed) FILTER (WHERE system = 'F') / nullif(sum(sub + missed + ins) FILTER (WHERE system = 'F'), 0) AS base, sum(missed) FILTER (WHERE system = 'O') / nullif(sum(sub + missed + ins) FILTER (WHERE system = 'O'), 0) AS cand FROM {R} GROUP BY 1) SELECT stage, round(coalesce(base, 0), 6) AS base, round(coalesce(cand, 0), 6) AS cand, round(coalesce(cand, 0) - coalesce(base, 0), 6) AS delta FROM r",
    ),
    "insertion_rise": (
        lambda s, d: rounded(rises(s, d)[1], "base", "cand", "delta"),
        f"WITH r AS (SELECT sum(ins) FILTER (WHERE system = 'F') / (sum(duration) FILTER (WHERE system = 'F') / 60) AS base, sum(ins) FILTER (WHERE system = 'O') / (sum(duration) FILTER (WHERE system = 'O') / 60) AS cand FROM {R} WHERE empty_ref) SELECT round(base, 6) AS base, round(cand, 6) AS cand, round(cand - base, 6) AS delta FROM r",
    ),
    "spearman": (
        rank_correlation,
        f"WITH x AS (SELECT slice, words AS a, char_errors + sub AS b FROM {R}), r AS (SELECT slice, rank() OVER (PARTITION BY slice ORDER BY a) + (count(*) OVER (PARTITION BY slice, a) - 1) / 2 AS p, rank() OVER (PARTITION BY slice ORDER BY b) + (count(*) OVER (PARTITION BY slice, b) - 1) / 2 AS q FROM x) SELECT slice, count(*) AS n, round(corr(p, q), 6) AS rho FROM r GROUP BY slice",
    ),
    "profile_lookup": (
        profile_lookup,
        """WITH p(key, margin) AS (SELECT (['en', 'es', 'en-phone', '*'])[n_nationkey + 1], n_nationkey / 10 FROM nation WHERE n_nationkey < 4),
        k AS (SELECT c_custkey, concat(CASE WHEN c_custkey % 4 < 2 AND c_custkey % 13 != 0 THEN (['en', 'es'])[c_custkey % 4 + 1] ELSE 'other' END, CASE WHEN c_nationkey % 3 = 0 THEN '-phone' ELSE '' END, CASE WHEN c_custkey % 20 < 10 THEN '-noisy' ELSE '' END) AS routing_key FROM customer)
        SELECT c_custkey, routing_key, coalesce(a.margin, b.margin, c.margin) AS margin, a.key IS NULL AS unvalidated FROM k LEFT JOIN p a ON a.key = routing_key LEFT JOIN p b ON b.key = split_part(routing_key, '-', 1) LEFT JOIN p c ON c.key = '*'""",
    ),
    "trust_regression": (
        regression,
        f"""WITH x AS (SELECT char_errors / 10 AS y, sub AS a, del AS b FROM {R} WHERE skipped IS NULL AND error IS NULL),
        m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(a, y) AS vay, covar_pop(b, y) AS vby FROM x),
        w AS (SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS wa, (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS wb FROM m)
        SELECT round(my - wa * ma - wb * mb, 6) AS intercept, round(wa, 6) AS a, round(wb, 6) AS b FROM w""",
    ),
    "macro_wer": (
        lambda s, d: metrics.by_keys(records(s, d), "slice", "system").groupBy("system").agg(F.round(F.avg("wer"), 6).alias("mean_wer"), F.round(F.max("wer"), 6).alias("worst"), F.max_by("slice", "wer").alias("worst_slice")),
        f"WITH w AS (SELECT slice, system, sum(sub + del + ins) FILTER (WHERE ran AND NOT empty_ref) / sum(words) FILTER (WHERE ran AND NOT empty_ref) AS wer FROM {RAN} GROUP BY 1, 2) SELECT system, round(avg(wer), 6) AS mean_wer, round(max(wer), 6) AS worst, max_by(slice, wer) AS worst_slice FROM w GROUP BY system",
    ),
    "macro_report": (
        lambda s, d: rounded(metrics.macro(records(s, d)), "mean_wer", "median_item", "worst_item", "seconds_per_hour"),
        f"WITH w AS (SELECT slice, system, sum(sub + del + ins) FILTER (WHERE ran AND NOT empty_ref) / sum(words) FILTER (WHERE ran AND NOT empty_ref) AS wer FROM {RAN} GROUP BY 1, 2), m AS (SELECT system, avg(wer) AS mean_wer, max_by(slice, wer) AS worst_slice FROM w GROUP BY 1), i AS (SELECT system, median((sub + del + ins) / words) FILTER (WHERE NOT empty_ref) AS median_item, max((sub + del + ins) / words) FILTER (WHERE NOT empty_ref) AS worst_item, sum(seconds) / (sum(duration) / 3600) AS sph FROM {RAN} WHERE ran GROUP BY 1) SELECT system, round(mean_wer, 6) AS mean_wer, worst_slice, round(median_item, 6) AS median_item, round(worst_item, 6) AS worst_item, round(sph, 6) AS seconds_per_hour FROM m JOIN i USING (system)",
    ),
    "split_hash": (split_hash, f"SELECT slice, CASE WHEN CAST(('0x' || right(sha256(id), 1)) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END AS side, count(*) AS n FROM {I} GROUP BY 1, 2"),
    "fingerprint": (fingerprints, f"SELECT id, sha256(CAST(to_json({{'duration': duration, 'id': id, 'lang': lang}}) AS VARCHAR)) AS fingerprint FROM {I}"),
    "pending": (pending, f"SELECT id FROM {I} WHERE CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) % 5 = 0 OR CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) % 7 = 0"),
    "smoke": (lambda s, d: corpus.choose_smoke(items(s, d)), f"SELECT slice, id, duration FROM {I} QUALIFY row_number() OVER (PARTITION BY slice ORDER BY duration, id) = 1"),
    "derive_items": (
        lambda s, d: corpus.derive_items(items(s, d), NOISE),
        f"WITH c(c, kind, snr) AS (VALUES {NOISE_SQL}), n AS (SELECT *, (row_number() OVER (PARTITION BY slice, split ORDER BY id) - 1) % 9 AS c FROM {I}) SELECT slice, split, concat(id, '-', kind, snr) AS id, kind, snr, duration FROM n JOIN c USING (c)",
    ),
    "corpus_summary": (lambda s, d: corpus.summary(items(s, d)), f"SELECT coalesce(slice, 'TOTAL') AS slice, count(*) AS items, CAST(sum(duration) AS BIGINT) AS seconds, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test FROM {I} GROUP BY ROLLUP (slice)"),
    "manifest_problems": (
        lambda s, d: corpus.problems(items(s, d)),
        f"""WITH i AS {I}, g AS (SELECT slice, count(*) AS n, sum(duration) AS total, sum(CASE WHEN split = 'dev' THEN duration ELSE 0 END) AS dev, count(*) FILTER (WHERE split = 'dev') AS nd, count(*) FILTER (WHERE split = 'test') AS nt FROM i GROUP BY slice)
        SELECT slice, id, 'duplicate' AS problem FROM i GROUP BY slice, id HAVING count(*) > 1 UNION ALL SELECT slice, id, 'split' FROM i WHERE split NOT IN ('dev', 'test') UNION ALL SELECT slice, id, 'long' FROM i WHERE duration > 600
        UNION ALL SELECT slice, id, 'empty' FROM i WHERE slice != 'nospeech' AND trim(coalesce(reference, '')) = '' UNION ALL SELECT slice, NULL, 'uneven' FROM g WHERE n >= 4 AND (least(nd, nt) < 2 OR least(dev, total - dev) / total < 0.35)""",
    ),
    "balanced_split": (lambda s, d: corpus.balanced_split(items(s, d).withColumn("duration", F.col("duration").cast("double"))).groupBy("slice", "split").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds")), BALANCED_SQL),
}
