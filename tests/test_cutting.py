"""Long spans cut without a walk, against the walk."""

import random

from pyspark.sql import functions as F

from murmuration.operators import cutting


def walked(spans, energy, longest, search, frame, least=0.001):
    out = []
    for f, s, e in spans:
        at, n = s, 0
        while e - at > longest:
            ok = [(v, g) for (h, g), v in energy.items() if h == f and g * frame >= max(s - 1e-9, at + longest - search - 1e-9) and (g + 1) * frame <= min(e, at + longest) + 1e-9]
            cut = (min(ok)[1] + 0.5) * frame if ok else at + longest
            out.append((f, s, n, at, cut))
            at, n = cut, n + 1
        if e - at > least:
            out.append((f, s, n, at, e))
    return sorted((f, round(s, 6), n, round(a, 6), round(z, 6)) for f, s, n, a, z in out)


def cut(spark, spans, energy, longest, search, frame):
    df = spark.createDataFrame(spans, "file_id string, start double, end double")
    frames = spark.createDataFrame([(f, g, v) for (f, g), v in energy.items()], "file_id string, frame long, energy double").repartition(3)
    return sorted((r.file_id, round(r.span_start, 6), r.part, round(r.start, 6), round(r.end, 6)) for r in cutting.split_long(df, frames, longest, search, frame).collect())


def test_long_spans(spark):
    spans = spark.createDataFrame([("f", 0.0, 65.0), ("g", 1.0, 5.0)], "file_id string, start double, end double")
    energy = spark.range(650).select(F.lit("f").alias("file_id"), F.col("id").alias("frame"), F.when(F.col("id").isin(250, 275, 500), 0.0).otherwise(1.0).alias("energy"))
    got = cutting.split_long(spans, energy).orderBy("file_id", "start").collect()
    assert [(r.file_id, r.part, round(r.start, 3), round(r.end, 3)) for r in got] == [("f", 0, 0.0, 25.05), ("f", 1, 25.05, 50.05), ("f", 2, 50.05, 65.0), ("g", 0, 1.0, 5.0)]


def test_random_spans_against_a_walk(spark):
    """Ties, gaps without frames, spans off the grid, files without frames."""
    rng = random.Random(9)
    spans = [("a", 0.0, 700.0), ("a", 800.3, 1400.0), ("b", 3.7, 500.2), ("c", 0.0, 95.0), ("d", 0.0, 20.0), ("d", 50.0, 50.0005)]
    energy = {(f, g): rng.choice([0.1, 0.2, 0.3, 0.4]) for f in "ab" for g in range(1400) if not 300 <= g < 370 and rng.random() < 0.9}
    assert cut(spark, spans, energy, 30.0, 10.0, 1.0) == walked(spans, energy, 30.0, 10.0, 1.0)


WORDS = "file_id string, pos long, start double, end double, speaker string, text string, unclear boolean, alternatives array<string>"


def test_segments(spark):
    base = [("f", i, i * 0.5, i * 0.5 + 0.5, "A", t, False, None) for i, t in enumerate(["a", "b", "c", "d", "e", "f", "g.", "h", "i"])]
    base += [("f", 9, 4.5, 5.0, "B", "x", True, ["y"]), ("f", 10, 9.0, 9.5, "B", "z", True, None), ("f", 11, 30.0, 30.5, "B", "w", False, None)]
    got = cutting.build_segments(spark.createDataFrame(base, WORDS)).orderBy("start").collect()
    assert [r.text for r in got] == ["a b c d e f g.", "h i", "x z", "w"]


def test_segments_against_a_walk(spark):
    """Words in order of time, some very long, runs of unclear words, closing quotes; long stretches without a pause."""
    rng = random.Random(12)
    rows, want = [], []
    for f in "abc":
        at, words = 0.0, []
        for i in range(250):
            gap, size = rng.choice([0.0, 0.0, 0.25, 0.5, 1.0 if rng.random() < 0.2 else 0.0]), rng.choice([0.25, 0.5, 0.75, 14.0 if rng.random() < 0.05 else 0.5])
            unclear = rng.random() < 0.3
            words.append((f, i, at + gap, at + gap + size, rng.choice("AAAAAAAAAB") if f == "b" else None, rng.choice(["w", "w", "w", "end.", 'so?"', "x…)"]), unclear, rng.choice([None, [], ["y"]])))
            at += gap + size
        rows += words
        held = []
        for k, (_, _, s, e, who, _, unclear, others) in enumerate(words):
            before = words[k - 1] if k else None
            together = before and unclear and before[6] and not others
            if before and not together:
                stop = before[5].rstrip("\"')]»”’")
                begin = held[0][2]
                if who != before[4] or s - before[3] >= 0.8 or e - begin > 12.0 or before[3] - begin >= 3.0 and stop[-1] in ".?!…":
                    want.append((f, held[0][2], held[-1][3], " ".join(w[5] for w in held)))
                    held = []
            held.append(words[k])
        want.append((f, held[0][2], held[-1][3], " ".join(w[5] for w in held)))
    got = cutting.build_segments(spark.createDataFrame(rows, WORDS).repartition(4)).collect()
    assert sorted((r.file_id, r.start, r.end, r.text) for r in got) == sorted(want)
