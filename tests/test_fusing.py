"""Two engines' words, guards, doubtful words and their rewrites, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import fusion, guards, islands, refining

ENGINE = "file_id string, chunk int, engine string, pos long, text string, start double, end double, prob double"


def engine(spark, a, b, probs=()):
    """One chunk: words of both engines, a second each."""
    rows = [("f", 0, e, i, w, float(i), i + 0.9, dict(probs).get((e, i), 0.9)) for e, side in (("a", a), ("b", b)) for i, w in enumerate(side.split())]
    return spark.createDataFrame(rows, ENGINE)


def test_alignment_keeps_times_and_blanks(spark):
    got = fusion.align_engines(engine(spark, "The — quick twenty fox ...", "the quick 20 — box jumps")).orderBy("pos").collect()
    assert [(r.kind, r.a, r.b, r.blank) for r in got] == [
        ("agree", "The", "the", False), ("agree", "—", None, True), ("agree", "quick", "quick", False), ("agree", "twenty", "20", False), ("b_only", None, "box", False), ("substitute", "fox", "jumps", False), ("agree", "...", None, True),
    ]
    assert (got[0].a_start, got[0].b_end, got[1].a_start, got[4].a_start, got[4].b_start) == (0.0, 0.9, 1.0, None, 4.0)
    one = fusion.align_engines(engine(spark, "only — here", ""))
    assert [(r.kind, r.a) for r in one.orderBy("pos").collect()] == [("a_only", "only"), ("agree", "—"), ("a_only", "here")]


def fused(spark, slots, picks=(), scores=(), margin=0.05, forced=False):
    marked = islands.mark_spans(slots, forced=forced)
    p = spark.createDataFrame(list(picks), "file_id string, span_id long, choice string")
    s = spark.createDataFrame([(*x[:2], *map(float, x[2:])) for x in scores], "file_id string, span_id long, sa double, sb double")
    return fusion.fused_words(marked, p, s, F.lit(margin)).orderBy("pos").collect()


@pytest.mark.parametrize(
    "pick, scores, text, tier, source, confidence, alternatives",
    [
        (None, None, "fox", "unclear", "a", 0.3, []), ("b", None, "box", "unclear", "pick", 0.3, []), ("a", (-1.0, -1.0), "fox", "resolved", "pick", 0.7, []), ("a", (-2.0, -1.0), "box", "resolved", "verify", 0.6, []),
        ("unclear", (-1.0, -2.0), "fox", "resolved", "verify", 0.6, []), (None, (-1.02, -1.0), "box", "unclear", "verify", 0.3, ["fox"]), (None, (-1.0, -1.0), "fox", "unclear", "verify", 0.3, ["box"]),
    ],
)
def test_fused_words_of_a_disputed_span(spark, pick, scores, text, tier, source, confidence, alternatives):
    slots = fusion.align_engines(engine(spark, "the fox ran", "the box ran"))
    got = fused(spark, slots, [("f", 1, pick)] if pick else [], [("f", 1, *scores)] if scores else [])
    assert [r.text for r in got] == ["the", text, "ran"] and [r.pos for r in got] == [0, 1, 2]
    r = got[1]
    assert (r.tier, r.source, r.confidence, r.alternatives, r.unclear) == (tier, source, confidence, alternatives, tier == "unclear")
    assert got[0].tier == "solid" and got[0].source == "agree" and got[0].confidence == pytest.approx(0.9)


def test_fused_words_of_one_sided_spans(spark):
    slots = fusion.align_engines(engine(spark, "we go now", "we go right now"))
    assert [r.text for r in fused(spark, slots, [("f", 2, "b")], [("f", 2, -1.0, -1.0)])] == ["we", "go", "right", "now"]
    assert [r.text for r in fused(spark, slots, [("f", 2, "a")], [("f", 2, -1.0, -1.0)])] == ["we", "go", "now"]  # an empty side may win
    single = fusion.single_engine_slots(engine(spark, "maybe yes —", "", {("a", 0): 0.2, ("a", 2): 0.1}.items()).where("engine = 'a'"))
    spans = islands.group_spans(single, forced=True).orderBy("span_id").collect()
    assert [(s.first, s.last, s.tier) for s in spans] == [(0, 0, "disputed"), (1, 1, "solid"), (2, 2, "solid")]
    kept = fused(spark, single, [("f", 0, "b")], [("f", 0, -1.0, -0.95)], forced=True)  # the empty side needs twice the margin
    assert [r.text for r in kept] == ["maybe", "yes", "—"] and kept[0].source == "verify"
    gone = fused(spark, single, [("f", 0, "b")], [("f", 0, -1.0, -0.85)], forced=True)
    assert [r.text for r in gone] == ["yes", "—"]
    assert [r.text for r in fused(spark, single, [("f", 0, "b")], [], forced=True)][0] == "maybe"  # never on a pick alone


def test_span_contexts(spark):
    slots = islands.mark_spans(fusion.align_engines(engine(spark, "a b c d e", "a b x d e")))
    got = {r.span_id: r for r in islands.span_contexts(slots, k=2).collect()}
    assert (got[2].left_context, got[2].right_context, got[2].left_start, got[2].right_end) == ("a b", "d e", 0.0, 4.9) and (got[0].left_context, got[0].left_start) == ("", None)


def test_picks_come_back_to_their_sides(spark):
    slots = islands.mark_spans(fusion.align_engines(engine(spark, "a one b two c Three d four", "a uno b dos c tree, d 4x")))
    asked = fusion.candidates(slots, batch=2)
    rows = asked.orderBy("span_id").collect()
    assert [r.batch for r in rows if r.choice is None] == [0, 0, 1, 1][: len(rows)] and all({r.first, r.second} <= {"one", "uno", "two", "dos", "Three", "tree,", "four", "4x"} for r in rows)
    answers = asked.select("file_id", "span_id", F.when(F.col("first").isin("uno", "dos", "tree,", "4x"), "1").otherwise("2").alias("answer"))
    assert {r.choice for r in fusion.picked(asked, answers).collect()} == {"b"}
    assert {r.choice for r in fusion.picked(asked, answers.where("false")).collect()} == {"unclear"}


def test_timing(spark):
    words = engine(spark, "a b c d", "a b x d").withColumn("start", F.when(F.col("engine") == "b", F.col("start") + F.col("pos") * 0.1).otherwise(F.col("start")))
    r = fusion.timing_agreement(fusion.align_engines(words), "file_id").first()
    assert r.matched == 3 and r.median == pytest.approx(0.1) and r.p90 == pytest.approx(0.26)


# ---------------------------------------------------------------- guards


@pytest.mark.parametrize(
    "text, silent, speech, kept, flags",
    [
        ("Thanks for watching!", False, None, 0, ["known-phrase"]), ("thanks for watching everyone", False, None, 0, ["known-phrase"]), ("I subscribe", False, None, 2, []), ("guys subscribe", False, None, 2, []),
        ("real words here", True, None, 0, ["low-energy"]), ("", True, None, 0, []), ("bueno adiós Subtítulos realizados por la comunidad de Amara.org", False, None, 2, ["known-phrase-trailing"]),
        ("thank you for listening ok thank you for listening", False, None, 9, []), ("no " * 12 + "yes", False, None, 2, ["repetition"]), ("no no no", False, None, 3, []), ("we go " * 6, False, None, 2, ["repetition"]),
        ("one two three", False, [], 0, ["outside-speech"]), ("one two three four", False, [(0.0, 1.5)], 2, ["trailing"]), ("one two three", False, [(0.0, 9.0)], 3, []),
    ],
)
def test_guards_of_a_chunk(text, silent, speech, kept, flags):
    words = [dict(pos=i, text=w, start=float(i), end=i + 0.9, prob=0.9) for i, w in enumerate(text.split())]
    got = guards.guarded(words, silent, None if speech is None else [dict(s0=a, s1=b) for a, b in speech])
    assert (len(got[0]), got[1]) == (kept, flags)


def test_guards_over_tables(spark):
    rows = [("f", c, i, w, c * 30.0 + i, c * 30.0 + i + 0.9, p) for c, text in enumerate(["hello there world", "please subscribe", "and so on", "quiet words"]) for i, (w, p) in enumerate((w, 0.1 if w == "world" else None) for w in text.split())]
    words = spark.createDataFrame(rows, "file_id string, chunk int, pos long, text string, start double, end double, prob double")
    chunks = spark.createDataFrame([("f", c, c * 30.0, c * 30.0 + 30, r) for c, r in enumerate([0.1, 0.1, None, 0.001])], "file_id string, chunk int, start double, end double, rms double")
    kept, flags = guards.apply_guards(words, chunks, spark.createDataFrame([("f", 0.0, 40.0)], "file_id string, start double, end double"))
    assert sorted((r.chunk, r.text) for r in kept.collect()) == [(0, "hello"), (0, "there")]
    assert {(r.chunk, r.flag) for r in flags.collect()} == {(0, "trailing"), (1, "known-phrase"), (2, "outside-speech"), (3, "low-energy")}
    kept, flags = guards.apply_guards(words, chunks)
    assert kept.where("chunk = 2").count() == 3 and flags.where("chunk = 2").count() == 0


# ---------------------------------------------------------------- doubtful words

FUSED = "file_id string, pos long, text string, start double, end double, tier string, confidence double, source string, alternatives array<string>, unclear boolean, speaker string"


def transcript(spark, words):
    """Words as text, or (text, unclear, confidence, alternatives)."""
    rows = []
    for i, w in enumerate(words):
        text, unclear, confidence, alternatives = w if isinstance(w, tuple) else (w, False, 0.9, [])
        rows.append(("f", i, text, float(i), i + 1.0, "solid", confidence, "agree", alternatives, unclear, "1"))
    return spark.createDataFrame(rows, FUSED)


def test_targets(spark):
    words = transcript(spark, ["we", "ask", "Andres", "Carpathy", "about", ("menu", True, 0.3, ["MenuGen"]), ("jen", True, 0.3, []), "and", ("odd", False, 0.4, []), "Karpathy", "again"])
    terms = spark.createDataFrame([("f", "Karpathy"), ("f", "ab"), ("f", "MenuGen")], "file_id string, term string")
    got = refining.refine_targets(words, terms, "en").orderBy("target_id").collect()
    assert [(r.target_id, r.start_idx, r.end_idx, r.text, r.reason) for r in got] == [(0, 3, 4, "Carpathy", "term_near"), (1, 5, 7, "menu jen", "unclear"), (2, 8, 9, "odd", "low_conf_agree")]
    assert got[1].alternatives == ["MenuGen"] and got[1].left == "we ask Andres Carpathy about" and got[1].right == "and odd Karpathy again" and got[0].left_start == 0.0 and got[2].right_end == 11.0


def test_near_runs_do_not_overlap(spark):
    words = transcript(spark, "the car pathy talk by karpathi now".split())
    got = refining.term_near(words, spark.createDataFrame([("f", "Karpathy")], "file_id string, term string"), "en").collect()
    assert {(r.start_idx, r.end_idx) for r in got} == {(1, 3), (5, 6)}


@pytest.mark.parametrize(
    "text, alternatives, replacement, reason, terms, lang, gate, match",
    [
        ("casa", [], " ", "unclear", [], "es", "empty", False), ("la casa", [], "la casa de mi abuela", "unclear", [], "es", "length", False), ("casa", [], "perro", "unclear", [], "es", "phonetic", False), ("casa", ["perra"], "perro", "unclear", [], "es", None, False),
        ("pues la casa grande", [], "la caza grande", "unclear", [], "es", "filler_removed", False), ("um the night train stops", [], "the knight train stops", "unclear", [], "en", "filler_removed", False), ("eza", [], "eso", "unclear", [], "es", "pronoun_swap", False), ("casa", [], "caza", "low_conf_agree", [], "es", "locked", False),
        ("casa", [], "caza", "unclear", [], "es", None, False), ("carpathy", [], "Karpathy", "low_conf_agree", ["Karpathy"], "en", None, True), ("weather", [], "Karpathy", "unclear", ["Karpathy"], "en", "phonetic", False),
    ],
)
def test_gates(spark, text, alternatives, replacement, reason, terms, lang, gate, match):
    df = spark.createDataFrame([(text, alternatives, replacement, reason, terms)], "text string, alternatives array<string>, replacement string, reason string, terms array<string>")
    r = refining.gate_edits(df, lang).first()
    assert (r.gate, r.term_match) == (gate, match)


def test_edits_are_judged_and_applied(spark):
    words = transcript(spark, ["hola", ("caza", True, 0.3, []), "gris", ("baca", True, 0.3, []), "y", ("boz", True, 0.3, [])])
    terms = spark.createDataFrame([("f", "nada")], "file_id string, term string")
    targets = refining.refine_targets(words, terms, "es")
    proposals = spark.createDataFrame([("f", 0, 0, "casa"), ("f", 0, 1, "perro"), ("f", 1, 0, "vaca"), ("f", 2, 0, "voz"), ("f", 9, 0, "x")], "file_id string, target_id long, n int, replacement string")
    scores = spark.createDataFrame([("f", 0, -5.0, -4.9), ("f", 1, -5.0, -4.99)], "file_id string, target_id long, original double, replaced double")
    v = refining.judged(targets, proposals, terms, "es", scores)
    assert {r.target_id: r.verdict for r in v.collect()} == {0: "accepted", 1: "audio", 2: "unverifiable"}
    assert {r.verdict for r in refining.judged(targets, proposals, terms, "es").collect()} == {"no_audio_check"}
    two = v.withColumn("replacement", F.when(F.col("target_id") == 0, "mi casa").otherwise(F.col("replacement")))
    got = refining.apply_edits(words, two).orderBy("pos").collect()
    assert [r.text for r in got] == ["hola", "mi", "casa", "gris", "baca", "y", "boz"] and [r.pos for r in got] == list(range(7))
    assert (got[1].start, got[1].end, got[2].start, got[2].end) == (1.0, pytest.approx(1 + 1 / 3), pytest.approx(1 + 1 / 3), 2.0) and got[1].source == "refine" and got[1].confidence == 0.6 and not got[1].unclear


def test_pronouns_and_fillers(spark):
    assert refining.swaps_in_pronoun("the cat sat", "it sat", "en") and not refining.swaps_in_pronoun("it sat", "they sat", "en") and not refining.swaps_in_pronoun("cat", "cat it", "en") and not refining.swaps_in_pronoun("x", "it", "fr")
    df = spark.createDataFrame([("So, you know, likely it's... you  know like this. ¿no? bueno",)], "t string")
    assert list(df.select(*refining.filler_counts(F.col("t"), "en")).first()) == [0, 0, 1, 2, 1, 0, 0]
    assert list(df.select(*refining.filler_counts(F.col("t"), "es")).first()) == [0, 0, 0, 0, 1, 1]


def test_hungarian_against_all_mappings():
    import itertools

    import numpy as np

    from murmuration.operators import sequential

    rng = random.Random(0)
    for _ in range(200):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        x = np.array([[rng.randrange(20) for _ in range(m)] for _ in range(n)], float)
        y = x if n <= m else x.T
        assert sequential.best_mapping(x) == max(sum(y[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(y.shape[1]), y.shape[0]))
    wide = np.zeros((2, 13))
    wide[0, :2], wide[1, :1] = (10, 9), 9
    assert sequential.best_mapping(wide) == 18
