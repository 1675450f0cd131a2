"""Which engines and stages a profile uses, decided from graded records (CMP-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators import metrics

SINGLES, CHAIN = ("single-a", "single-b"), ("fused", "+pick", "+verify", "+refine")
HARM_LIMIT, EPS = 0.02, 1e-9


def chain_of(records: DataFrame) -> DataFrame:
    """(key, system, rank): the rungs of the ladder that a key's records reach without a gap."""
    rank = F.array_position(F.array(*map(F.lit, CHAIN)), F.col("system"))
    have = records.where("wer is not null").select("key", "system", rank.alias("rank")).where("rank > 0").distinct()
    return have.alias("x").join(have.alias("y"), F.expr("x.key = y.key and y.rank <= x.rank")).groupBy("x.key", "x.system", "x.rank").agg(F.count("*").alias("n")).where("n = rank").drop("n")


def comparable(records: DataFrame, systems: DataFrame) -> DataFrame:
    """Records of the key's systems on the ids that all of them completed (J-7, SET-2); spoken and silent items apart."""
    own = records.join(systems.select("key", "system"), ["key", "system"], "left_semi")
    need = systems.groupBy("key").agg(F.count_distinct("system").alias("_need"))
    shared = own.groupBy("key", "id").agg(F.count_distinct("system").alias("_have")).join(need, "key").where("_have = _need").select("key", "id")
    return own.join(shared, ["key", "id"], "left_semi")


def differences(records: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(key, a, b, id, d): differences of word error rates on shared ids for every pair of systems."""
    spoken = records.where("wer is not null").select("key", "id", "system", "wer")
    wanted = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    left = spoken.select("key", "id", "system", "wer", F.explode(F.filter(wanted, lambda p: p["a"] == F.col("system"))).alias("p"))
    right = spoken.select("key", "id", F.col("system").alias("b"), F.col("wer").alias("wer_b"))
    return left.select("key", "id", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "wer").join(right, ["key", "id", "b"]).select("key", "a", "b", "id", (F.col("wer") - F.col("wer_b")).alias("d"))


def decide(figures: DataFrame) -> DataFrame:
    """A decision for every key of (key, kind, a, b, x, y), by columns over the rungs: one row for each key, of some thirty numbers.

    Engines: fusion has to beat the better single engine for sure. Rungs: of those up to which no stage harms more than a fiftieth, the
    smallest that no larger one beats for sure, else the one of least error; then the last rung up to it that raises neither error nor insertions over the one before.
    """
    rungs = range(len(CHAIN))
    pairs = [(a, b) for i, a in enumerate(CHAIN) for b in CHAIN[i + 1 :]] + [(CHAIN[0], s) for s in SINGLES]
    one = lambda kind, a, b, value: F.max(F.when((F.col("kind") == kind) & (F.col("a") == a) & (F.col("b") == b), F.col(value)))
    wide = figures.groupBy("key").agg(
        *[one("single", s, "", "x").alias(f"single_{i}") for i, s in enumerate(SINGLES)], *[one(kind, s, "", "x").alias(f"{kind}_{k}") for kind in ("chain", "harm", "ins") for k, s in enumerate(CHAIN)],
        *[one("ci", a, b, "x").alias(f"low {a} {b}") for a, b in pairs], *[one("ci", a, b, "y").alias(f"high {a} {b}") for a, b in pairs],
    )
    col, zero = (lambda kind, k: F.col(f"{kind}_{k}")), F.lit(0.0)
    safe = [reduce(lambda x, y: x & y, [F.coalesce(col("harm", j), zero) <= HARM_LIMIT for j in range(1, k + 1)], col("chain", k).isNotNull()) for k in rungs]
    beaten = [reduce(lambda x, y: x | y, [F.coalesce(F.col(f"low {CHAIN[k]} {CHAIN[j]}") > EPS, F.lit(False)) for j in rungs if j > k], F.lit(False)) for k in rungs]
    raised = [F.lit(False)] + [F.coalesce(col("chain", k) > col("chain", k - 1) + EPS, F.lit(False)) | F.coalesce(col("ins", k) > col("ins", k - 1) + EPS, F.lit(False)) for k in rungs if k]
    least = F.array_min(F.array_compact(F.array(*[F.when(safe[k], F.struct(col("chain", k).alias("x"), F.lit(k).alias("k"))) for k in rungs])))["k"]
    chosen = F.coalesce(*[F.when(safe[k] & ~beaten[k], F.lit(k)) for k in rungs], least)
    held = wide.withColumn("_top", chosen)
    last = F.greatest(*[F.when((F.col("_top") >= k) & ~raised[k], F.lit(k)) for k in rungs])
    best = F.when(F.coalesce(col("single", 0) <= col("single", 1), col("single", 0).isNotNull()), F.lit(SINGLES[0])).when(col("single", 1).isNotNull(), F.lit(SINGLES[1]))
    sure = reduce(lambda x, y: x | y, [(F.col("_best") == s) & F.coalesce(F.col(f"high {CHAIN[0]} {s}") < -EPS, F.lit(False)) for s in SINGLES])
    fused = col("chain", 0).isNotNull() & (F.col("_best").isNull() | sure)
    done = held.withColumns({"_last": last, "_best": best}).where("chain_0 is not null or _best is not null").withColumn("_fused", fused)
    rung = F.when(F.col("_fused"), F.element_at(F.array(*map(F.lit, CHAIN)), F.col("_last") + 1)).otherwise(F.col("_best"))
    stages = [(F.col("_fused") & (F.col("_last") >= k)).alias(name) for k, name in enumerate(("pick", "verify", "refine"), 1)]
    why = F.when(F.col("_fused"), F.concat(F.lit("both engines, "), rung)).otherwise("one engine: fusion isn't better for sure")
    return done.select("key", F.when(F.col("_fused"), "ab").otherwise(F.right("_best", F.lit(1))).alias("engines"), rung.alias("rung"), *stages, why.alias("decision"))


def decide_profiles(records: DataFrame, effects: DataFrame, n: int = 2000) -> DataFrame:
    """One row for each profile key with data (CMP-10).

    `records` holds (key, id, system, wer, empty_ref, ins, duration) of finished items of the dev split; a record with key `*` (nothing
    said) counts for every key. `effects` holds (key, id, system, help, harm, neutral) of the stage that each rung adds. All figures are
    aggregated by Spark.
    """
    keys = records.where("key != '*'").select("key").distinct()
    everywhere = records.where("key = '*'").drop("key").crossJoin(keys)  # profile keys, tens at most
    all_ = records.where("key != '*'").unionByName(everywhere.select(records.columns))
    spoken = all_.where("wer is not null")
    ladder = chain_of(spoken)
    chain = comparable(spoken, ladder)
    silent = comparable(all_.where("empty_ref"), ladder)
    singles = spoken.where(F.col("system").isin(*SINGLES))
    both = comparable(singles, singles.select("key", "system").distinct())
    means = lambda df, kind: df.groupBy("key", "system").agg(F.avg("wer").alias("x")).select("key", F.lit(kind).alias("kind"), F.col("system").alias("a"), F.lit("").alias("b"), "x", F.lit(None).cast("double").alias("y"))
    inside = differences(chain, [(a, b) for i, a in enumerate(CHAIN) for b in CHAIN[i + 1 :]])
    across = differences(spoken, [(CHAIN[0], s) for s in SINGLES])
    ci = metrics.bootstrap(inside.unionByName(across), "d", "key", "a", "b", n=n).select("key", F.lit("ci").alias("kind"), "a", "b", F.col("lo").alias("x"), F.col("hi").alias("y"))
    harm = metrics.harm_rates(effects.join(chain.select("key", "id", "system"), ["key", "id", "system"], "left_semi"), "key", "system")
    ins = silent.groupBy("key", "system").agg(metrics.share(F.sum("ins"), F.sum("duration") / 60).alias("x"))
    row = lambda df, kind, value: df.select("key", F.lit(kind).alias("kind"), F.col("system").alias("a"), F.lit("").alias("b"), F.col(value).alias("x"), F.lit(None).cast("double").alias("y"))
    figures = reduce(DataFrame.unionByName, [means(both, "single"), means(chain, "chain"), ci, row(harm, "harm", "harm_rate"), row(ins, "ins", "x")])
    return decide(figures)
