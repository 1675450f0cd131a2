"""Pooled metrics, paired comparison, statistics and profile fitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.operators import ranks


def share(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def ran() -> Column:
    """A record that was neither skipped nor failed (PRJ-5)."""
    return F.col("skipped").isNull() & F.col("error").isNull()


def pooled(records: DataFrame) -> list[Column]:
    """Aggregates of one group of records (AGG-1, 3, 4, 5, 6)."""
    spoken, silent = ran() & ~F.col("empty_ref"), ran() & F.col("empty_ref")
    total = lambda c, when=spoken: F.sum(F.when(when, c))
    return [
        F.count_if(ran()).alias("n"), F.count_if(F.col("skipped").isNotNull()).alias("n_skipped"), F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        share(total(F.col("sub") + F.col("del") + F.col("ins")), total(F.col("words"))).alias("wer"),
        share(total(F.col("char_errors")), total(F.col("chars"))).alias("cer"),
        share(total(F.col("missed")), total(F.col("entities"))).alias("entity_error"),
        share(total(F.col("ins"), silent), total(F.col("duration"), silent) / 60).alias("ins_per_min"),
        share(total(F.col("duration"), ran()), total(F.col("seconds"), ran())).alias("xrt"),
        F.max(F.when(ran() & (F.col("rss") > 0), F.col("rss"))).alias("rss"),
    ]


def by_keys(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(*pooled(records))


def report(records: DataFrame) -> DataFrame:
    """One scan for all four groupings (AGG-2): (slice, system), with split, (system), with split.

    Columns that no aggregate reads are dropped before the grouping sets expand the rows.
    """
    need = ["slice", "system", "split", "skipped", "error", "empty_ref", "sub", "del", "ins", "words", "char_errors", "chars", "missed", "entities", "duration", "seconds", "rss"]
    sets = [[F.col("slice"), F.col("system")], [F.col("slice"), F.col("system"), F.col("split")], [F.col("system")], [F.col("system"), F.col("split")]]
    return records.select(*need).groupingSets(sets, "slice", "system", "split").agg(F.grouping_id().alias("level"), *pooled(records))


def macro(records: DataFrame) -> DataFrame:
    """Per system the mean of slices' error rates, the median and worst item, seconds per hour of audio, and the worst slice (AGG-24, TOP-8)."""
    slices = by_keys(records, "slice", "system").groupBy("system").agg(F.avg("wer").alias("mean_wer"), F.max_by("slice", "wer").alias("worst_slice"))
    done = records.where(ran())
    wer = F.when(~F.col("empty_ref"), share(F.col("sub") + F.col("del") + F.col("ins"), F.col("words")))
    items = done.groupBy("system").agg(F.percentile(wer, 0.5).alias("median_item"), F.max(wer).alias("worst_item"), share(F.sum("seconds"), F.sum("duration") / 3600).alias("seconds_per_hour"))
    return slices.join(items, "system")


def slice_ranking(records: DataFrame) -> DataFrame:
    """Slices by their best system's error rate, the worst first (TOP-8)."""
    best = by_keys(records, "slice", "system").where("wer is not null").groupBy("slice").agg(F.min_by("system", F.struct("wer", "system")).alias("best"), F.min("wer").alias("wer"))
    return best.orderBy(F.desc("wer"), "slice")


def harm_rates(effects: DataFrame, *keys: str) -> DataFrame:
    """Help, harm and neutral edits and the share of harm (AGG-7)."""
    sums = effects.groupBy(*keys).agg(F.sum("help").alias("help"), F.sum("harm").alias("harm"), F.sum("neutral").alias("neutral"))
    return sums.withColumn("harm_rate", share(F.col("harm"), F.col("help") + F.col("harm") + F.col("neutral")))


def unclear_quality(df: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and density of flags from pooled counts (AGG-8)."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("flagged", "flagged_errors", "errors", "words")])
    return sums.withColumns({"precision": share(F.col("flagged_errors"), F.col("flagged")), "recall": share(F.col("flagged_errors"), F.col("errors")), "density": share(F.col("flagged"), F.col("words"))})


def weighted_der(records: DataFrame, *keys: str) -> DataFrame:
    """Diarization error weighted by duration over items that have one (AGG-9)."""
    has = F.col("der").isNotNull()
    return records.groupBy(*keys).agg(share(F.sum(F.when(has, F.col("der") * F.col("duration"))), F.sum(F.when(has, F.col("duration")))).alias("der"), F.count_if(~has).alias("der_missing"))


def pair_records(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Records of two systems side by side, and where each was (J-6)."""
    b = base.select("id", F.col("slice").alias("slice_b"), F.col("wer").alias("wer_b"))
    c = cand.select("id", F.col("slice").alias("slice_c"), F.col("wer").alias("wer_c"))
    side = F.when(F.col("slice_c").isNull(), "base_only").when(F.col("slice_b").isNull(), "cand_only").otherwise("both")
    return b.join(c, "id", "full_outer").select("id", F.coalesce("slice_b", "slice_c").alias("slice"), "wer_b", "wer_c", side.alias("side"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Shared and one-sided ids and the mean change per slice (SET-1, J-6)."""
    return pairs.groupBy("slice").agg(
        F.count_if(F.col("side") == "both").alias("shared"), F.count_if(F.col("side") == "base_only").alias("base_only"),
        F.count_if(F.col("side") == "cand_only").alias("cand_only"), F.avg(F.col("wer_c") - F.col("wer_b")).alias("mean_delta"),
    )


def restricted(records: DataFrame, systems: list[str]) -> DataFrame:
    """Records of ids that every one of the systems completed (J-7, SET-2)."""
    done = records.where(ran() & F.col("system").isin(*systems))
    full = done.groupBy("id").agg(F.count_distinct("system").alias("_n")).where(F.col("_n") == len(systems)).select("id")
    return done.join(full, "id", "left_semi")


def average_ranks(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, _rank) of the distinct values, ties at their average rank; rows may carry how often they occur as _n.

    Rows of one value are counted first; the distinct values are placed over ranges, so a slice of continuous values is no task of its own.
    """
    counts = df.groupBy(*keys, value).agg((F.sum("_n") if "_n" in df.columns else F.count("*")).alias("_n"))
    below = ranks.placed(counts, list(keys), [value], "_below", weight="_n")
    return below.select(*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias("_rank"))


def spearman(df: DataFrame, x: str, y: str, *keys: str, least: int = 2) -> DataFrame:
    """Rank correlation with average ranks (AGG-15): 0 for a constant side, null under `least` rows.

    Equal pairs are counted first; ranks come from the counts of distinct values and are joined back.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    rank = lambda c, out: average_ranks(pairs.select(*keys, c, "_n"), c, *keys).withColumnRenamed("_rank", out)
    met = pairs.join(rank("_x", "_a"), [*keys, "_x"]).join(rank("_y", "_b"), [*keys, "_y"])
    n, total = F.col("_n"), F.sum("_n")
    sums = met.groupBy(*keys).agg(total.alias("n"), *[F.sum(n * e).alias(f"_{i}") for i, e in enumerate((F.col("_a"), F.col("_b"), F.col("_a") * F.col("_b"), F.col("_a") ** 2, F.col("_b") ** 2))])
    cov = F.col("_2") - F.col("_0") * F.col("_1") / F.col("n")
    spread = (F.col("_3") - F.col("_0") ** 2 / F.col("n")) * (F.col("_4") - F.col("_1") ** 2 / F.col("n"))
    r = F.when(F.col("n") < least, None).when(spread <= 0, 0.0).otherwise(cov / F.sqrt(F.when(spread > 0, spread)))
    return sums.select(*keys, "n", r.alias("rho"))


HELD_GROUPS = 256  # groups whose sums a task holds at a time


def bootstrap(df: DataFrame, value: str, *keys: str, n: int = 2000) -> DataFrame:
    """Mean and 95 % interval of resampled means (AGG-16) by a Poisson bootstrap.

    Each row's weight in resample r is Poisson(1), drawn from a generator seeded by a hash of the row, so sums of (value * weight,
    weight) over any rows add up: a task hands on one row for each key, however many rows it reads, and a group of any size is
    never in one task. Behind the resamples stand the sums without weights. Drawing costs far more than a row's bytes tell, so rows are dealt by
    their hash. An interval is statistically that of drawing with replacement. Nulls are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_h"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(x), t) for t, x in zip(types, zip(*sums))]
            s, w = (pa.array([x[i] for x in sums.values()], pa.list_(pa.float64())) for i in (0, 1))
            return pa.RecordBatch.from_arrays([*columns, s, w], names=[*keys, "s", "w"])

        for b in batches:
            types = [b.column(k).type for k in keys]
            names: dict[tuple, int] = {}
            codes = np.zeros(b.num_rows, np.int64)
            if keys:
                codes = np.array([names.setdefault(k, len(names)) for k in zip(*(b.column(k).to_pylist() for k in keys))], np.int64)
            order = np.argsort(codes, kind="stable")
            v, h = np.asarray(b.column("_v"))[order], np.asarray(b.column("_h")).view(np.uint64)[order]
            ends = np.searchsorted(codes[order], np.arange(max(1, len(names))), side="right").tolist() if b.num_rows else []
            for group, low, high in zip(names or [()], [0, *ends], ends):
                if group not in sums and len(sums) == HELD_GROUPS:
                    yield out()
                    sums.clear()
                own = sums.setdefault(group, np.zeros((2, n + 1)))
                for at in range(low, high, DRAWN):
                    i = slice(at, min(at + DRAWN, high))
                    both = np.stack([v[i], np.ones(i.stop - at)])
                    own[:, :n] += both @ poisson(h[i], n)
                    own[:, n] += both.sum(1)
        if sums:
            yield out()

    dealt = rows.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "_h")
    parts = dealt.mapInArrow(partial, ", ".join([*kinds, "s array<double>", "w array<double>"]))
    each = parts.select(*keys, F.posexplode(F.arrays_zip("s", "w")).alias("r", "x")).groupBy(*keys, "r").agg(share(F.sum("x.s"), F.sum("x.w")).alias("m"), F.sum("x.w").cast("long").alias("w"))
    drawn, whole = F.when(F.col("r") < n, F.col("m")), F.col("r") == n
    return each.groupBy(*keys).agg(F.max(F.when(whole, F.col("m"))).alias("mean"), F.max(F.when(whole, F.col("w"))).alias("n"), F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))


DRAWN = 32  # rows whose draws are made at once: some 500 KB
POISSON = np.cumsum([1 / math.e / math.factorial(k) for k in range(18)])
#: What a draw is by its highest 16 bits, and OPEN where those don't tell.
OPEN = 255
_ends = [np.searchsorted(POISSON, (np.arange(1 << 16) + up) * 2.0**-16 - up * 2.0**-53, side="right") for up in (0, 1)]
DRAWS = np.where(_ends[0] == _ends[1], _ends[0], OPEN).astype(np.uint8)


def poisson(seed: np.ndarray, n: int) -> np.ndarray:
    """n draws of Poisson(1) for each seed, by a counter-based generator."""
    x = seed[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = np.empty_like(x)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= np.right_shift(x, np.uint64(shift), out=y)
        if by != 1:
            x *= np.uint64(by)
    k = DRAWS.take(np.right_shift(x, np.uint64(48), out=y).view(np.int64), mode="clip").ravel()
    left = np.flatnonzero(k == OPEN)
    k[left] = np.searchsorted(POISSON, (x.ravel()[left] >> np.uint64(11)) * 2.0**-53, side="right")
    return k.reshape(x.shape).astype(np.float64)


def gate_slices(pairs: DataFrame, n: int = 2000) -> DataFrame:
    """Per slice: shared and one-sided ids, mean change with its interval, and whether the change is for the worse (AGG-21)."""
    ci = bootstrap(pairs.where("side = 'both'").select("slice", "id", (F.col("wer_c") - F.col("wer_b")).alias("d")), "d", "slice", n=n).drop("n", "mean")
    return pair_counts(pairs).join(ci, "slice", "left").withColumn("worse", F.coalesce(F.col("lo") > 0, F.lit(False)))


def harm_rise(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Harm rates of both sides for every stage that either has, a missing one 0 (AGG-7, SET-3); rows are (stage, help, harm, neutral)."""
    rate = lambda df, out: harm_rates(df, "stage").select("stage", F.coalesce("harm_rate", F.lit(0.0)).alias(out))
    both = rate(base, "base").join(rate(cand, "cand"), "stage", "full_outer").na.fill(0.0, ["base", "cand"])
    return both.withColumn("delta", F.col("cand") - F.col("base"))


def insertion_rise(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Insertions per minute over empty references of both sides, as one row (AGG-5); null without any."""
    rate = lambda df, out: df.where("empty_ref").agg(share(F.sum("ins"), F.sum("duration") / 60).alias(out))
    return rate(base, "base").crossJoin(rate(cand, "cand")).withColumn("delta", F.col("cand") - F.col("base"))  # one row each


def gate(pairs: DataFrame, harm: DataFrame | None = None, insertions: DataFrame | None = None, n: int = 2000) -> DataFrame:
    """Reasons why a change is refused (AGG-21), as (slice, reason, delta): a worse slice, ids that only the base has, a stage
    whose harm rate rises by more than a point, more insertions where nothing is said. No rows: it passes."""
    slices = gate_slices(pairs, n)
    out = slices.where("worse").select("slice", F.lit("worse").alias("reason"), F.col("mean_delta").alias("delta"))
    out = out.unionByName(slices.where("base_only > 0").select("slice", F.lit("missing").alias("reason"), F.col("base_only").cast("double").alias("delta")))
    if harm is not None:
        out = out.unionByName(harm.where("delta > 0.01 + 1e-9").select(F.concat(F.lit("stage "), "stage").alias("slice"), F.lit("harm").alias("reason"), "delta"))
    if insertions is not None:
        out = out.unionByName(insertions.where("delta > 1e-9").select(F.lit("*").alias("slice"), F.lit("insertions").alias("reason"), "delta"))
    return out


def one_system(records: DataFrame) -> DataFrame:
    """The records, or an error where they are of several systems (J-6)."""
    checked = records.agg(F.when(F.count_distinct("system") > 1, F.raise_error(F.lit("records of several systems: name one"))).cast("boolean").alias("_several"))
    return records.crossJoin(checked).where(F.col("_several").isNull()).drop("_several")  # one row


def majority(votes: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Value with the most votes, then the greatest summed weight, then the greatest name; dissent counts sure votes for others (AGG-12)."""
    per = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.count_if(F.col(weight) > 0.6).alias("sure"))
    top = per.groupBy(key).agg(F.max_by(value, F.struct("n", "w", value)).alias("winner"), F.sum("sure").alias("_all"), F.max_by("sure", F.struct("n", "w", value)).alias("_own"))
    return top.select(key, "winner", (F.col("_all") - F.col("_own")).alias("dissent"), (F.col("_all") - F.col("_own") >= 2).alias("switching"))


def first_majority(votes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most common value, of equal ones the one seen first (AGG-12)."""
    per = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return per.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias("winner"))


def low_quantile(df: DataFrame, value: str, key: str, q: float = 0.1) -> DataFrame:
    """The value at place floor(q * (n - 1)) of the sorted values (AGG-14)."""
    w = W.partitionBy(key)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") == F.floor(q * (F.col("_n") - 1)) + 1).select(key, F.col(value).alias("threshold"))


def edges(word: Column) -> Column:
    """The word without punctuation at its edges."""
    return F.regexp_replace(word, r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def uncertain_hints(words: DataFrame, k: int = 3) -> DataFrame:
    """Words at or under the file's low quantile, the lowest k of each segment, in order of time (TOP-1)."""
    low = words.join(low_quantile(words, "score", "file_id"), "file_id").where("score <= threshold")
    ranked = low.withColumn("_r", F.row_number().over(W.partitionBy("file_id", "segment").orderBy("score", "start", "text"))).where(F.col("_r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("start", "text")))
    return ranked.groupBy("file_id", "segment").agg(F.array_join(F.transform(listed, lambda x: edges(x["text"])), ",").alias("hints"))


def least_squares(df: DataFrame, y: str, features: list[str], ridge: float = 0.0) -> tuple[float, dict[str, float]] | None:
    """Intercept and weights from sums of products (AGG-17); features without range are left out; None under 3 rows a feature."""
    ends = df.agg(F.count("*").alias("n"), *[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]).first()
    kept = [f for f in features if ends[f"lo_{f}"] is not None and ends[f"hi_{f}"] > ends[f"lo_{f}"]]
    if not kept or ends["n"] < 3 * len(kept):
        return None
    x = [F.lit(1.0), *[F.col(f) for f in kept]]
    sums = df.agg(*[F.sum(a * b) for i, a in enumerate(x) for b in x[: i + 1]], *[F.sum(a * F.col(y)) for a in x]).first()
    n, at = len(x), 0
    gram = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = sums[at]
            at += 1
    w = np.linalg.solve(gram + ridge * np.eye(n), np.array(sums[at : at + n], float))
    return float(w[0]), dict(zip(kept, map(float, w[1:])))


def select_profile(keys: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile of the key, else of its language, else the default `*`; all but the first unvalidated (J-8)."""
    p = lambda alias: profiles.select(F.col("key").alias(alias), F.col("margin").alias(f"{alias}_margin"))  # noqa: E731  a row per profile key, tens at most
    lang = keys.withColumns({"k1": F.col("routing_key"), "k2": F.split_part("routing_key", F.lit("-"), F.lit(1)), "k3": F.lit("*")})
    met = lang.join(p("k1"), "k1", "left").join(p("k2"), "k2", "left").join(p("k3"), "k3", "left")
    return met.select(*keys.columns, F.coalesce("k1_margin", "k2_margin", "k3_margin").alias("margin"), F.col("k1_margin").isNull().alias("unvalidated"))
