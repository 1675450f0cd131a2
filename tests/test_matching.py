"""Joins of nearly equal sounds against all pairs, and choices of spans against the walk."""

import random

from pyspark.sql import functions as F

from murmuration.functions import sounds
from murmuration.operators import matching


def test_every_near_pair_is_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("KRPTSA") for _ in range(rng.randrange(0, 12)))

    def edited(w):
        w = list(w)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w) + 1) : rng.randrange(len(w) + 1)] = rng.choice(["", "K", "X", "PT"])
        return "".join(w)

    terms = [(f, word()) for f in "ab" for _ in range(40)] + [("a", ""), ("b", "K"), ("a", None)]
    runs = [(f, edited(t or "")) for f, t in terms for _ in range(6)] + [(f, word()) for f in "ab" for _ in range(60)] + [("a", ""), ("a", None), ("b", "K R")]
    g = spark.createDataFrame(sorted(set(runs), key=str), "file string, g_s string")
    t = spark.createDataFrame(sorted(set(terms), key=str), "file string, t_s string")
    for most in (0.35, 0.2):
        want = g.join(t, "file").withColumn("distance", sounds.sound_distance(F.col("g_s"), F.col("t_s"))).where(F.col("distance") <= most)
        got = matching.near_sounds(g, t, ["file"], most)
        key = lambda df: sorted((r.file, r.g_s, r.t_s, round(r.distance, 9)) for r in df.collect())
        assert key(got) == key(want) and len(key(got)) > 60


def test_chosen_spans_are_those_of_a_walk(spark):
    rng = random.Random(4)
    spans = sorted({(f, s, s + rng.randrange(1, 5), rng.choice([0.1, 0.2, 0.3])) for f in "abc" for s in range(60) for _ in range(2)})
    spans = list({r[:3]: r for r in spans}.values()) + [("chain", i, i + 2, 1.0 / (i + 1)) for i in range(9)]
    df = spark.createDataFrame(spans, "file string, start_idx long, end_idx long, distance double")
    got = {tuple(r) for r in matching.choose_apart(df, ["file"], [F.col("distance"), F.col("start_idx") - F.col("end_idx")]).collect()}
    want, taken = set(), set()
    for f, a, z, _ in sorted(spans, key=lambda r: (r[3], r[1] - r[2], r[1])):
        places = {(f, p) for p in range(a, z)}
        if not places & taken:
            taken |= places
            want.add((f, a, z))
    assert got == want
    assert matching.choose_apart(df.limit(0), ["file"], [F.col("distance")]).count() == 0
