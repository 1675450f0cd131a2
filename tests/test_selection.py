"""Profiles, choices for a corpus, merged files, frames and sources on literal rows."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from murmuration.operators import intervals, islands, metrics, profiles, ranks, selection, signal
from murmuration.sources import manifests


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- profiles


@pytest.mark.parametrize(
    "stats, ci, harm, ins, want",
    [
        ({("single", "single-a"): 0.1, ("single", "single-b"): 0.2}, {}, {}, {}, ("a", "single-a", False, False, False)),
        ({("single", "single-a"): 0.3, ("single", "single-b"): 0.2, ("chain", "fused"): 0.1}, {("fused", "single-b"): (-0.2, 0.01)}, {}, {}, ("b", "single-b", False, False, False)),
        ({("single", "single-a"): 0.3, ("chain", "fused"): 0.1}, {("fused", "single-a"): (-0.2, -0.1)}, {}, {}, ("ab", "fused", False, False, False)),
        ({("chain", "fused"): 0.2, ("chain", "+pick"): 0.1}, {("fused", "+pick"): (0.05, 0.15)}, {"+pick": 0.01}, {}, ("ab", "+pick", True, False, False)),
        ({("chain", "fused"): 0.2, ("chain", "+pick"): 0.1}, {("fused", "+pick"): (0.05, 0.15)}, {"+pick": 0.03}, {}, ("ab", "fused", False, False, False)),
        ({("chain", "fused"): 0.2, ("chain", "+pick"): 0.1}, {("fused", "+pick"): (0.05, 0.15)}, {"+pick": 0.0}, {"fused": 1.0, "+pick": 2.0}, ("ab", "fused", False, False, False)),
        ({("chain", "fused"): 0.2, ("chain", "+pick"): 0.15, ("chain", "+verify"): 0.1}, {("fused", "+verify"): (0.05, 0.1), ("+pick", "+verify"): (-0.01, 0.1)}, {}, {}, ("ab", "+pick", True, False, False)),
    ],
)
def test_decisions(spark, stats, ci, harm, ins, want):
    figures = [("k", kind, s, "", x, None) for (kind, s), x in stats.items()] + [("k", "ci", a, b, lo, hi) for (a, b), (lo, hi) in ci.items()]
    figures += [("k", kind, s, "", x, None) for kind, of in (("harm", harm), ("ins", ins)) for s, x in of.items()] + [("empty", "harm", "+pick", "", 0.5, None)]
    got = profiles.decide(spark.createDataFrame(figures, "key string, kind string, a string, b string, x double, y double")).collect()
    assert [tuple(r)[1:6] for r in got] == [want]


def test_decisions_against_a_walk(spark):
    """Random figures of keys with gaps, against the rule walked rung by rung."""
    rng, keys, rows = random.Random(8), {}, []
    for key in range(150):
        chain = profiles.CHAIN[: rng.randrange(5)]
        f = {("single", s): rng.choice([0.1, 0.2, 0.3]) for s in profiles.SINGLES if rng.random() < 0.7} | {("chain", s): rng.choice([0.1, 0.2, 0.3]) for s in chain}
        f |= {("harm", s): rng.choice([0.0, 0.01, 0.03]) for s in chain if rng.random() < 0.8} | {("ins", s): rng.choice([1.0, 2.0]) for s in chain if rng.random() < 0.7}
        ci = {(a, b): rng.choice([(-0.2, -0.1), (-0.1, 0.1), (0.1, 0.2)]) for a in chain for b in (*profiles.CHAIN, *profiles.SINGLES) if rng.random() < 0.7}
        keys[key] = (chain, f, ci)
        rows += [(key, k, s, "", x, None) for (k, s), x in f.items()] + [(key, "ci", a, b, lo, hi) for (a, b), (lo, hi) in ci.items()]
    got = {r.key: r for r in profiles.decide(spark.createDataFrame(rows, "key int, kind string, a string, b string, x double, y double")).collect()}
    for key, (chain, f, ci) in keys.items():
        have = [s for s in profiles.SINGLES if ("single", s) in f]
        best = sorted(have, key=lambda s: f["single", s])[0] if have else None
        if not chain or best and not ("fused", best) in ci or best and ci["fused", best][1] >= 0:
            assert (got[key].rung if key in got else None) == best
            continue
        allowed = []
        for s in chain:
            if s != "fused" and f.get(("harm", s), 0.0) > 0.02:
                break
            allowed.append(s)
        unbeaten = [s for s in allowed if not any(ci.get((s, t), (0, 0))[0] > 0 for t in profiles.CHAIN[profiles.CHAIN.index(s) + 1 :])]
        at = chain.index(unbeaten[0] if unbeaten else sorted(allowed, key=lambda s: f["chain", s])[0])
        while at and (f["chain", chain[at]] > f["chain", chain[at - 1]] or f.get(("ins", chain[at]), 0) > f.get(("ins", chain[at - 1]), 9)):
            at -= 1
        assert (got[key].engines, got[key].rung, got[key].refine) == ("ab", chain[at], at == 3)


def test_profiles_of_records(spark):
    rng = random.Random(0)
    recs, effects = [], []
    for k, better in (("en", 0.1), ("es", 0.0)):
        for i in range(40):
            w = rng.uniform(0.1, 0.2)
            for s, drop in (("single-a", 0.0), ("single-b", -0.05), ("fused", better), ("+pick", better + 0.03), ("+verify", better + 0.03)):
                if not (s == "+verify" and i == 0):
                    recs.append((k, f"{k}{i}", s, max(0.0, w - drop), False, 0.0, 10.0))
                    effects.append((k, f"{k}{i}", s, 5, int(s == "+verify" and i % 2), 1))
    recs += [("*", "n1", s, None, True, 3.0, 60.0) for s in ("fused", "+pick", "+verify")]
    r = spark.createDataFrame(recs, "key string, id string, system string, wer double, empty_ref boolean, ins double, duration double")
    e = spark.createDataFrame(effects, "key string, id string, system string, help long, harm long, neutral long")
    got = {x.key: x for x in profiles.decide_profiles(r, e, n=400).collect()}
    assert (got["en"].engines, got["en"].rung, got["en"].pick, got["en"].verify) == ("ab", "+pick", True, False) and (got["es"].engines, got["es"].rung) == ("a", "single-a")
    chain = profiles.comparable(r.where("wer is not null"), profiles.chain_of(r.where("wer is not null")))
    assert chain.where("id = 'en0'").count() == 0 and chain.where("key = 'en'").count() == 39 * 3


# ---------------------------------------------------------------- choices


def test_places_without_one_task(spark):
    rng = random.Random(5)
    base = [(k, rng.choice([1, 1, 1, 2, 5, 100, -7]), i) for k in "ab" for i in range(300)]
    got = ranks.placed(spark.createDataFrame(base, "k string, v int, i int").repartition(5), ["k"], ["v", "i"])
    for k in "ab":
        own = sorted((r for r in got.collect() if r.k == k), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(300)) and [(r.v, r.i) for r in own] == sorted((v, i) for x, v, i in base if x == k)
    names = spark.createDataFrame([(w,) for w in ("item-2", "item-10", "b", "é", "")], "w string")
    assert [r.w for r in ranks.placed(names, [], ["w"]).orderBy("place").collect()] == ["", "b", "item-10", "item-2", "é"]
    weighed = spark.createDataFrame([("a", v, v % 3 + 1) for v in range(50)], "k string, v int, n int").repartition(7)
    assert [r.place for r in ranks.placed(weighed, ["k"], [F.desc("v")], weight="n").orderBy("place").collect()] == [sum(v % 3 + 1 for v in range(w + 1, 50)) for w in range(49, -1, -1)]


def test_places_of_ids_of_one_beginning(spark):
    """A hundred thousand ids of one key and one long prefix: every place once, and no range with many more rows than others."""
    ids = spark.range(100_000).select(F.lit("s").alias("k"), F.concat(F.lit("en_clean-corpus-speaker-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("id")).repartition(8)
    got = ranks.placed(ids, ["k"], ["id"])
    assert got.where(F.col("place") != F.substring("id", -9, 9).cast("long")).count() == 0 and got.count() == 100_000
    sizes = [r["count"] for r in ids.repartitionByRange(8, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 100_000 / 8


def test_spread(spark):
    assert [selection.stride(n) for n in (1, 2, 3, 9, 12)] == [1, 1, 1, 4, 5]
    got = selection.spread_order(spark.range(9), ["id"]).orderBy("visit").collect()
    assert [r.id for r in got] == [i * 4 % 9 for i in range(9)]
    meetings = spark.createDataFrame([("ES2b",), ("IS1a",), ("ES2a",), ("IS1b",)], "meeting string")
    assert [r.meeting for r in meetings.orderBy(*selection.meeting_order()).collect()] == ["ES2a", "IS1a", "ES2b", "IS1b"]


def test_small_choices(spark):
    utts = spark.createDataFrame([("g", i, 100.0 + i * 10, 105.0 + i * 10) for i in range(20)] + [("h", 0, 0.0, 1.0)], "group_id string, rn int, start double, end double")
    assert sorted(r.rn for r in selection.time_window(utts, 45.0, 50.0, 3).collect()) == [5, 6, 7, 8, 9] and selection.time_window(utts, 45.0, 50.0, 6).count() == 0
    assert sorted(r.rn for r in selection.time_window(utts, 25.0, 120.0, 2, from_first=False).collect()) == [2, 3, 4]
    words = spark.createDataFrame([("f", 0, -1.0, 2.0), ("f", 0, 9.0, 8.0), ("f", 0, 3.0, 99.0)], "file_id string, chunk int, start double, end double")
    chunks = spark.createDataFrame([("f", 0, 0.0, 10.0)], "file_id string, chunk int, start double, end double")
    assert rows(selection.clamp_words(words, chunks).select("start", "end")) == [(0.0, 2.0), (3.0, 10.0), (9.0, 9.0)]
    smoke = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "slice string, id string")
    items = spark.createDataFrame([("a", "1", "dev"), ("a", "9", "test")], "slice string, id string, split string")
    assert rows(selection.unmatched_smoke(smoke, items)) == [("a", "2")] and selection.select_items(items).count() == 2 and selection.select_items(items, "dev", ["b"]).count() == 0
    ids = spark.createDataFrame([([1, 2, 3], [3, 3, 4, 1])], "asked array<int>, got array<int>")
    p = ids.select(selection.batch_id_problems(F.col("asked"), F.col("got")).alias("p")).first().p
    assert (p.missing, p.unexpected, p.duplicate) == ([2], [4], [3])


def test_merged_files(spark):
    results = spark.createDataFrame([("f", 1, " b ", None, 1.0), ("f", 0, " ", None, 1.0), ("f", 2, "c", "es", 1.0), ("g", 0, None, None, 1.0)], "file_id string, chunk int, text string, language string, duration double")
    segs = spark.createDataFrame([("g", 0, 1, "y"), ("g", 0, 0, " x"), ("f", 0, 0, "no")], "file_id string, chunk int, pos int, text string")
    got = {r.file_id: r for r in selection.merged_transcripts(results, segs).collect()}
    assert (got["f"].text, got["f"].language, [c.chunk for c in got["f"].chunks]) == ("b\n\nc", "es", [0, 1, 2]) and (got["g"].text, got["g"].language) == ("x\n\ny", None)
    stages = spark.createDataFrame([("f", "pick", "ok"), ("f", "verify", "skipped: x"), ("g", "pick", "off"), ("g", "refine", None)], "file_id string, stage string, status string")
    per_file, counts = selection.run_health(stages, spark.createDataFrame([("f", "high"), ("g", "low"), ("h", "low")], "file_id string, level string"))
    assert {r.file_id: r.notes for r in per_file.collect()} == {"f": ["verify: skipped: x"], "g": ["refine"], "h": []} and rows(counts) == [("refine", "low", 1), ("verify", "high", 1)]


def test_builds(spark):
    def ink(n, total=20):
        return [1] * n + [0] * (total - n)

    data = [("v", i, ink(n), float(i), i + 1.0, [i]) for i, n in enumerate([2, 4, 8, 12, 3, 3])] + [("v", 6, ink(3)[::-1], 6.0, 7.0, [])]
    df = spark.createDataFrame(data, "video_id string, pos int, ink array<int>, start double, end double, repeats array<int>")
    got = selection.collapse_builds(df).orderBy("pos").collect()
    assert [(r.pos, r.steps, len(r.spans), sorted(r.repeats)) for r in got] == [(2, 3, 3, [0, 1, 2]), (3, 1, 1, [3]), (4, 1, 1, [4]), (5, 1, 1, [5]), (6, 1, 1, [])]


# ---------------------------------------------------------------- what was partial before


def test_slides_and_order(spark):
    seg = spark.createDataFrame([("f", 0, 0.0, 1.0, "early"), ("f", 1, 4.0, 6.0, " on two "), ("f", 2, None, 1.0, "x"), ("f", 3, 8.0, 9.0, " "), ("f", 4, 20.0, 21.0, "late")], "file_id string, pos int, start double, end double, text string")
    spans = spark.createDataFrame([("f", 1, 2.0), ("f", 2, 5.0), ("f", 3, 5.0), ("f", 1, 15.0)], "file_id string, slide int, start double")
    assert {(r.slide, tuple(r.texts)) for r in intervals.slide_texts(seg, spans).collect()} == {(1, ("early", "late")), (3, ("on two",))}
    order = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 2.0), ("b", 1, 1.0), ("c", 0, None)], "file_id string, pos int, start double")
    assert rows(intervals.ordered_files(order)) == [("a",)]


def test_labels_and_blocks(spark):
    labels = [-1, 0, 0, 9, 9, -1, 1, 9, -1]
    frames = spark.createDataFrame([("f", i, x, float(i)) for i, x in enumerate(labels)] + [("g", 0, 9, 1.0)], "file_id string, frame long, label int, margin double")
    got = islands.collapse_labels(frames, spark.createDataFrame([(0, "a"), (1, "b")], "label int, text string"), 9, seconds=1.0).orderBy("run").collect()
    assert [(r.text, r.start, r.end, r.score) for r in got] == [("a", 1.0, 3.0, 1.5), ("a", 3.0, 5.0, 3.5), ("b", 6.0, 7.0, 6.0), ("b", 7.0, 8.0, 7.0)]
    utts = spark.createDataFrame([("c", i, s, t) for i, (s, t) in enumerate([("EDACC-C01-A", "x" * 14), ("EDACC-C01-B", "x" * 28), ("EDACC-C02-A", "IGNORE_TIME_SEGMENT"), ("EDACC-C02-A", "x" * 140)])], "corpus string, rn int, speaker string, text string")
    got = islands.conversation_blocks(utts, target=2.0).orderBy("rn").collect()
    assert [(r.block, round(r.ahead, 1), r.valid_start) for r in got] == [(0, 3.8, True), (0, 2.4, False), (1, 10.4, True), (1, 10.4, True)]
    placed = islands.longform(spark.createDataFrame([("g", 0, 5.0, " a  b "), ("g", 1, 6.0, ""), ("g", 2, 5.0, "c"), ("g", 3, 5.0, "no")], "group_id string, rn int, seconds double, text string"), 12.5)
    assert rows(islands.longform_references(placed)) == [("g", "a b c", 17.2)]


def test_motion(spark):
    frames = spark.createDataFrame([("v", i, [0 if i % 2 else 100, 20 * (i % 2), 0]) for i in range(5)], "video_id string, second int, thumb array<int>")
    assert {r.pixel: (r.rate, r.soft_rate, r.periods) for r in signal.motion(frames).collect()} == {0: (1.0, 1.0, 4), 1: (0.0, 1.0, 0)}


def test_macro(spark):
    names = "id string, slice string, system string, split string, empty_ref boolean, skipped string, error string, sub long, del long, ins long, words long, char_errors long, chars long, missed long, entities long, duration double, seconds double, rss double"
    base = [(str(i), s, "x", "dev", False, None, None, e, 0, 0, 10, 0, 50, 0, 0, 360.0, 1.0, 0.0) for i, (s, e) in enumerate([("p", 1), ("p", 3), ("q", 9)])]
    r = metrics.macro(spark.createDataFrame(base, names)).first()
    assert (r.mean_wer, r.worst_slice, r.median_item, r.worst_item, r.seconds_per_hour) == (pytest.approx(0.55), "q", 0.3, 0.9, 10.0)
    assert [x.slice for x in metrics.slice_ranking(spark.createDataFrame(base, names)).collect()] == ["q", "p"]


def test_sources(spark, tmp_path):
    items = spark.createDataFrame([("2", "b", "dev", "en", "x.wav", 1.0, "r"), ("1", "a", "dev", "en", "/y.wav", 1.0, "r")], "id string, slice string, split string, lang string, audio string, duration double, reference string")
    manifests.write_manifest(items, f"{tmp_path}/m")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = manifests.read_manifest(spark, f"{tmp_path}/m", ("b", "a", "gone")).orderBy("slice_no").collect()
    assert [r.id for r in got] == ["2", "1"] and any("gone" in str(w.message) for w in told)
    with pytest.raises(FileNotFoundError):
        manifests.read_manifest(spark, f"{tmp_path}/m", ("gone",))
    assert {r.audio for r in manifests.rooted(items, "/data/").collect()} == {"/data/x.wav", "/y.wav"}
    spark.range(10).selectExpr("id as rn", "id * 2 as v", "'z' as w").write.parquet(f"{tmp_path}/c")
    want = spark.createDataFrame([(7, 0), (2, 1), (5, 2)], "rn long, place int")
    assert [r.v for r in manifests.read_corpus(spark, f"{tmp_path}/c", ["rn", "v"], want).collect()] == [14, 4, 10]
    for chapter, lines in (("10", "5-10-1 B\n5-10-0 A\n"), ("11", "5-11-0 C\n\n")):
        (tmp_path / "t" / "5" / chapter).mkdir(parents=True)
        (tmp_path / "t" / "5" / chapter / f"5-{chapter}.trans.txt").write_text(lines)
    assert rows(manifests.read_chapters(spark, f"{tmp_path}/t/*/*/*.trans.txt")) == [("5-10", "A B"), ("5-11", "C")]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "1.json").write_text('{\n"id": "1", "system": "s",\n "text": "t"}')
    assert rows(manifests.read_outputs(spark, f"{tmp_path}/o", "system string, id string, text string")) == [("s", "1", "t")]
