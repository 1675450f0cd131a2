import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmuration.functions import rules
from murmuration.functions import text as T
from murmuration.operators import corpus, fusion, intervals, islands, metrics, signal
from murmuration.sources import manifests, render
from murmuration.streaming import run, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_functions(spark):
    r = one(
        spark, a=T.squeeze(F.lit(" a \n b ")), b=T.squeeze(F.lit(None).cast("string")), c=T.platform(F.lit("https://M.YouTube.com/watch?v=1")), d=T.platform(F.lit("https://notyoutube.com")),
        e=T.video_id(F.lit("https://youtu.be/abc?t=1")), f=T.video_id(F.lit("https://www.youtube.com/embed/xyz/")), g=T.slug(F.lit("..a b/c.mp3_")), h=T.srt_time(F.lit(3661.0015)), i=T.srt_time(F.lit(-2.0)),
        j=T.has_markup(F.lit("a <b> c")), k=T.has_markup(F.lit("1 < 2 > 0")), l=T.mmss(F.lit(125.9)), o=T.unescape_url(F.lit("http:\\/\\/x\\?a\\=1")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("a b", "", "youtube", None, "abc", "xyz", "a_b_c.mp3")
    assert r.h in ("01:01:01,002", "01:01:01,001") and r.i == "00:00:00,000" and r.j and not r.k and r.l == "02:05" and r.o == "http://x?a=1"


@pytest.mark.parametrize(
    "pick, sa, sb, guarded, want",
    [
        ("a", 1.0, 5.0, None, ("a", "pick", False, 0.7)), ("a", 1.0, 7.0, None, ("b", "verify", False, 0.6)), (None, 1.0, 7.0, None, ("b", "verify", False, 0.6)), ("unclear", 3.0, 2.0, None, ("a", "verify", True, 0.3)),
        ("b", 1.0, 9.0, "b", ("a", "verify", False, 0.6)), ("b", 1.0, 12.0, "b", ("b", "pick", False, 0.7)), ("b", None, None, "b", ("a", "pick", True, 0.3)), (None, None, None, None, ("a", "a", True, 0.3)), (None, None, None, "a", ("b", "b", True, 0.3)),
    ],
)
def test_decide(spark, pick, sa, sb, guarded, want):
    lit = lambda v, t: F.lit(v).cast(t)
    d = one(spark, d=rules.decide(lit(pick, "string"), lit(sa, "double"), lit(sb, "double"), F.lit(5.0), F.lit("a"), lit(guarded, "string"))).d
    assert (d.side, d.source, d.unclear, d.confidence) == want


def test_merge_and_coverage(spark):
    df = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.4, 2.0), ("f", 3.0, 2.5), ("f", 2.6, 9.0), ("g", 1.0, 2.0)], "file_id string, start double, end double")
    assert rows(intervals.merge_intervals(df, ["file_id"], 0.5)) == [("f", 0.0, 2.0), ("f", 2.6, 9.0), ("g", 1.0, 2.0)]
    files = spark.createDataFrame([("f", 8.0), ("h", 0.0)], "file_id string, duration double")
    assert rows(intervals.coverage(df, files)) == [("f", pytest.approx(7.0), pytest.approx(0.875)), ("h", 0.0, 0.0)]


def test_asof_and_speakers(spark):
    spans = spark.createDataFrame([("f", 0, 1.0, "x"), ("f", 1, 5.0, "y"), ("f", 2, 5.0, "z")], "file_id string, pos int, start double, name string")
    pts = spark.createDataFrame([("f", 0, 0.5), ("f", 1, 1.0), ("f", 2, 5.0), ("g", 0, 9.0)], "file_id string, pos int, start double")
    got = intervals.last_before(pts, spans, F.col("start"), ["name"]).select("pos", "span_name")
    assert rows(got) == [(1, "x"), (2, "z")]
    words = spark.createDataFrame([("f", 0, 0.0, 1.0), ("f", 1, 3.4, 3.6), ("f", 2, 4.0, 9.0), ("g", 0, 0.0, 1.0)], "file_id string, pos long, start double, end double")
    turns = spark.createDataFrame([("f", 0, 1.5, 3.0, "A"), ("f", 1, 4.0, 6.0, "B"), ("f", 2, 5.0, 8.5, "C")], "file_id string, pos long, start double, end double, speaker string")
    assert rows(intervals.assign_speakers(words, turns, 2.0).select("file_id", "pos", "speaker")) == [("f", 0, "A"), ("f", 1, "A"), ("f", 2, "C"), ("g", 0, "1")]


def test_results_do_not_depend_on_partitions(spark):
    base = [("f", i, float(i), "xyz"[i % 3], i % 4 == 0) for i in range(60)]
    for n in (1, 2, 17):
        df = spark.createDataFrame(base[::-1], "file_id string, pos long, start double, label string, unclear boolean").repartition(n)
        assert len(rows(islands.collapse_runs(df, ["file_id"], ["pos"], "label", "pos"))) == 60
        assert rows(islands.unclear_runs(df)) == [("f", i, i + 1) for i in range(0, 60, 4)]


def test_spans_and_context(spark):
    s = spark.createDataFrame([("f", 0, i, k, p, 0.9) for i, (k, p) in enumerate([("agree", 0.9), ("agree", 0.9), ("substitute", 0.9), ("a_only", 0.9), ("agree", 0.2), ("agree", 0.8), ("b_only", None)])], "file_id string, chunk int, pos int, kind string, pa double, pb double")
    assert [(r[3], r[4], r[5]) for r in rows(islands.group_spans(s))] == [(0, 0, "solid"), (1, 1, "solid"), (2, 4, "disputed"), (5, 5, "solid"), (6, 6, "missing")]


def test_segments_break_by_count_pause_and_stop(spark):
    text = ["w"] * 16 + ["end.", "next"]
    w = spark.createDataFrame([("f", i, t, 0.2 * i + (5 if i >= 3 else 0)) for i, t in enumerate(text)], "file_id string, pos long, text string, start double")
    assert [r.n_words for r in islands.words_to_segments(w).orderBy("start").collect()] == [3, 14, 1]


def test_windows_keep_each_place_once(spark):
    df = spark.createDataFrame([(float(t), 58.0) for t in range(58)], "at double, n double")
    got = islands.window_places(df).groupBy("window").count()
    assert sum(r["count"] for r in got.collect()) == 58 and {r["window"] for r in got.collect()} == {0, 1, 2, 3}


def test_pooled_report(spark):
    names = "id string, slice string, system string, split string, empty_ref boolean, skipped string, error string, sub long, del long, ins long, words long, char_errors long, chars long, missed long, entities long, duration double, seconds double, rss double"
    base = [("1", "a", "s", "dev", False, None, None, 1, 0, 0, 10, 1, 50, 1, 2, 60.0, 2.0, 0.0), ("2", "a", "s", "test", False, None, None, 1, 1, 0, 10, 0, 50, 0, 2, 60.0, 2.0, 5.0), ("3", "a", "s", "dev", True, None, None, 0, 0, 5, 0, 0, 0, 0, 0, 120.0, 1.0, 0.0), ("4", "a", "s", "dev", False, "language", None, 9, 9, 9, 9, 9, 9, 9, 9, 9.0, 9.0, 9.0)]
    got = {(r.slice, r.system, r.split): r for r in metrics.report(spark.createDataFrame(base, names)).collect()}
    whole = got["a", "s", None]
    assert len(got) == 6 and (whole.n, whole.n_skipped, whole.wer, whole.ins_per_min, whole.entity_error, whole.rss) == (3, 1, 3 / 20, 2.5, 0.25, 5.0)


def test_gate(spark):
    names = "id string, slice string, system string, wer double"
    base = [(str(i), "en" if i % 2 else "es", "b", 0.05 + 0.01 * (i % 4)) for i in range(40)]
    frame = lambda r: spark.createDataFrame(r, names)
    same = metrics.gate(metrics.pair_records(frame(base), frame(base)))
    worse = [(i, s, "c", w + (0.03 if s == "en" else 0)) for i, s, _, w in base]
    effects = lambda *r: spark.createDataFrame(list(r), "stage string, help long, harm long, neutral long")
    silent = lambda ins: spark.createDataFrame([(True, ins, 60.0), (False, 9, 60.0)], "empty_ref boolean, ins long, duration double")
    harm = metrics.harm_rise(effects(("pick", 9, 1, 0), ("verify", 5, 0, 5)), effects(("pick", 9, 1, 0), ("refine", 1, 1, 0)))
    got = rows(metrics.gate(metrics.pair_records(frame(base), frame(worse[1:])), harm, metrics.insertion_rise(silent(2), silent(3))).select("slice", "reason"))
    assert rows(same) == [] and got == [("*", "insertions"), ("en", "worse"), ("es", "missing"), ("stage refine", "harm")]
    assert rows(metrics.gate(metrics.pair_records(frame(base), frame(base)), metrics.harm_rise(effects(("a", 99, 1, 0)), effects(("a", 98, 2, 0))), metrics.insertion_rise(silent(2), silent(2)))) == []
    assert {(r.slice, r.worse) for r in metrics.gate_slices(metrics.pair_records(frame(base), frame(worse))).collect()} == {("en", True), ("es", False)}
    with pytest.raises(Exception, match="several systems"):
        metrics.one_system(frame(base + worse)).collect()


def test_bootstrap_of_a_hot_group(spark):
    df = spark.createDataFrame([("hot", float(i % 7), i) for i in range(6000)] + [("cold", 1.0, i) for i in range(5)], "k string, v double, id long").repartition(8)
    got = {r.k: r for r in metrics.bootstrap(df, "v", "k", n=300).collect()}
    assert got["hot"].n == 6000 and abs(got["hot"].mean - 2.9995) < 1e-3 and 0.07 < got["hot"].hi - got["hot"].lo < 0.14 and got["cold"].lo == got["cold"].hi == 1.0


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(10)] + [("b", 1.0, float(i)) for i in range(3)] + [("c", None, 1.0)], "k string, x double, y double")
    assert rows(metrics.spearman(df, "x", "y", "k")) == [("a", 10, pytest.approx(1.0)), ("b", 3, 0.0)]
    assert metrics.least_squares(df.where("k = 'a'").withColumn("z", 2 * F.col("x") + 1), "z", ["x"]) == (pytest.approx(1.0), {"x": pytest.approx(2.0)})
    ci = metrics.bootstrap(df.where("k = 'a'"), "x", "k", n=400).first()
    assert ci.mean == 4.5 and 2.0 < ci.lo < 4.5 < ci.hi < 7.0
    w = spark.createDataFrame([("f", 0 if i < 3 else 1, float(i), t, s) for i, (t, s) in enumerate([("a", 0.9), ("b", 0.1), ("c", 0.1), ("d", 0.8), ("e", 0.9), ("f", 0.1)])], "file_id string, segment int, start double, text string, score double")
    assert [r.hints for r in metrics.uncertain_hints(w).orderBy("segment").collect()] == ["b,c", "f"]


def test_corpus(spark):
    items = spark.createDataFrame([(f"i{n}", "a", "dev" if n % 2 else "test", 10.0 * n, "r") for n in range(1, 6)] + [("x", "b", "odd", 700.0, " "), ("x", "b", "odd", 1.0, "r")], "id string, slice string, split string, duration double, reference string")
    assert {(r.slice, r.problem) for r in corpus.problems(items).collect()} == {("b", "duplicate"), ("b", "split"), ("b", "long"), ("b", "empty")}
    assert {r.slice: (r["items"], r.seconds) for r in corpus.summary(items).collect()} == {"a": (5, 150.0), "b": (2, 701.0), "TOTAL": (7, 851.0)}
    rng = __import__("random").Random(3)
    many = [(f"i{n}", s, float(rng.choice([1, 1, 2, 3, 5, 9]))) for s in "pq" for n in range(60)]
    want = {}
    for s in "pq":
        lead = 0.0
        for i, _, d in sorted((m for m in many if m[1] == s), key=lambda m: (-m[2], m[0])):
            want[s, i] = "dev" if lead <= 0 else "test"
            lead += d if lead <= 0 else -d
    assert {(r.slice, r.id): r.split for r in corpus.balanced_split(spark.createDataFrame(many, "id string, slice string, duration double")).collect()} == want
    side = corpus.balanced_split(items.where("slice = 'a'")).groupBy("split").agg(F.sum("duration").alias("s"))
    assert {r.s for r in side.collect()} <= {70.0, 80.0}


def test_align_guard_and_phrases(spark):
    w = [("a", i, t) for i, t in enumerate("the cat, sat".split())] + [("b", i, t) for i, t in enumerate("The cat sat down".split())]
    words = spark.createDataFrame([(1, 0, e, i, t, 0.5) for e, i, t in w] + [(1, 1, "b", 0, "only", None)], "file_id long, chunk long, engine string, pos long, text string, prob double")
    assert [r[3] for r in rows(fusion.align_engines(words))] == ["agree", "agree", "agree", "b_only", "b_only"]
    chunks = spark.createDataFrame([(1, "Thanks for watching!"), (2, "okay thanks for watching"), (3, "thanks for watching the show"), (4, "okay subscribe")], "id int, text string")
    phrases, polite = spark.createDataFrame([("thanks for watching",), ("subscribe",)], "phrase string"), spark.createDataFrame([("okay",)], "word string")
    assert [r.id for r in fusion.phrase_match(chunks, phrases, polite).orderBy("id").collect()] == [1, 2]


def test_signals(spark):
    r = one(spark, silent=signal.dbfs(F.array(F.lit(0.0))), full=signal.dbfs(F.array(F.lit(1.0), F.lit(-1.0))), snr=signal.snr_db(F.array(F.lit(10.0)), F.array(F.lit(1.0))), mix=signal.mix_at_snr(F.array(*map(F.lit, (0.5, -0.5, 0.5))), F.array(F.lit(0.1)), F.lit(0.0)), none=signal.power(F.array().cast("array<double>")))
    assert (r.silent, r.full, r.snr, r.none) == (-240.0, 0.0, 20.0, None) and r.mix == pytest.approx([0.99, 0.0, 0.99])


def test_render_and_sources(spark, tmp_path):
    seg = spark.createDataFrame([("f", 1, 1.5, 2.0, "B", "there"), ("f", 0, 0.0, 1.25, "A", " hi  you "), ("g", 0, None, 1.0, None, "x"), ("h", 0, 0.0, 1.0, None, " ")], "file_id string, pos int, start double, end double, speaker string, text string")
    assert {r.file_id: r.srt for r in render.srt(seg).collect()}["g"] is None
    assert rows(render.txt(seg.where("file_id = 'f'"))) == [("f", "[0.00 --> 1.25] Speaker A:  hi  you \n[1.50 --> 2.00] Speaker B: there\n")]
    assert {(r.file_id, r.text, r.n_speakers) for r in render.documents(seg).collect()} == {("f", "hi you there", 2), ("g", "x", 0)}
    marks = spark.createDataFrame([("f", 0, "a", False, None), ("f", 1, "b", True, "x"), ("f", 2, "c", True, None), ("f", 3, "d", True, ""), ("f", 4, "e", False, None)], "file_id string, pos int, text string, unclear boolean, alternative string")
    assert rows(render.unclear_text(marks)) == [("f", "a [unclear: b c | x] [unclear: d | —] e")]
    items = spark.createDataFrame([("2", "s", "dev", "en", "/data/a/2.wav", 1.0, "r"), ("1", "s", "dev", "en", "/other/1.wav", 1.0, "r")], "id string, slice string, split string, lang string, audio string, duration double, reference string")
    manifests.write_manifest(items, f"{tmp_path}/m", "/data")
    back = manifests.read_manifest(spark, [f"{tmp_path}/m/slice=s"])
    assert {(r.id, r.audio) for r in back.collect()} == {("2", "a/2.wav"), ("1", "/other/1.wav")}
    raw = spark.createDataFrame([("f", 0, "1.5", None, None, "2", "A", None, " t "), ("f", 1, "x", "3", "4", None, None, "B", "u"), ("f", 2, None, None, None, None, None, None, " ")], "file_id string, pos int, start string, start_time string, end string, end_time string, speaker string, speaker_id string, text string")
    assert rows(manifests.normalize_segments(raw)) == [("f", 0, 1.5, 2.0, "A", "t"), ("f", 1, 3.0, 4.0, "B", "u")]


def test_stream_runs_carry_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for n, labels in enumerate(["aab", "bba", "c"]):
        at = [start + dt.timedelta(seconds=10 * n + i) for i in range(len(labels))]
        pd.DataFrame({"file_id": 1, "ts": pd.Series(at).astype("datetime64[us]"), "label": list(labels)}).to_parquet(f"{tmp_path}/{n}.parquet")
    for n in range(3):
        __import__("os").utime(f"{tmp_path}/{n}.parquet", (1e9 + n, 1e9 + n))
    stream = spark.readStream.schema("file_id long, ts timestamp, label string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = sorted((r["first"], r.label, r.n) for r in run.drained(windows.run_collapse(stream)).collect())
    assert [(label, n) for _, label, n in got] == [("a", 2), ("b", 3), ("a", 1)]
