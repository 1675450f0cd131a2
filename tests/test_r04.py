import random

import pytest
from pyspark.sql import functions as F

from murmuration.functions import sounds
from murmuration.operators import matching, refining, scoring

FUSED = "file_id string, pos int, text string, start double, end double, tier string, confidence double, source string, alternatives array<string>, unclear boolean, speaker string"


def moved(spark, run):
    """What `run` returns, and how many rows and bytes were written for other tasks meanwhile."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        it = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
        while it.hasNext():
            s = it.next()
            yield s.stageId(), s.shuffleWriteRecords(), s.shuffleWriteBytes()

    last = max((s[0] for s in stages()), default=-1)
    out = run()
    new = [s for s in stages() if s[0] > last]
    return out, sum(s[1] for s in new), sum(s[2] for s in new)


def transcripts(spark, seed, files, n, odd=()):
    """Words of many files, some unclear or unsure, made of a few syllables so that many sound alike."""
    draw = random.Random(seed)
    word = lambda: draw.choice(odd) if odd and draw.random() < 0.1 else "".join(draw.choice(("kar", "ma", "ty", "lo", "pha", "chi", "Ben", "o", "sk", "ght")) for _ in range(draw.randrange(1, 4)))
    rows = [(f"f{f}", i, word(), float(i), i + 0.9, "solid", 0.4 if draw.random() < 0.1 else 0.9, "agree", ["x"], draw.random() < 0.1, "1") for f in range(files) for i in range(n)]
    return rows, spark.createDataFrame(rows, FUSED)


def test_targets_move_words_once(spark):
    """Runs of words and contexts don't travel: what does grows with the words, not with three runs a word at every join."""
    rows, words = transcripts(spark, 3, 20, 400)
    terms = spark.createDataFrame([(f"f{f}", t) for f in range(20) for t in ("Karmaty", "Benlochi", "phaskoma")], "file_id string, term string")
    rows_of = lambda df: sorted(map(str, df.collect()))
    got, n, _ = moved(spark, lambda: rows_of(refining.refine_targets(words, terms, "en")))
    assert {"unclear", "term_near", "low_conf_agree"} == {x.split("reason='")[1].split("'")[0] for x in got}
    assert n < 5 * len(rows)


@pytest.mark.parametrize("lang", ["en", "es", "de"])
def test_few_and_many_terms_find_the_same(spark, lang):
    """A run's sound is that of its words, equal runs cover the same places, and files of either kind can stand side by side."""
    odd = ("rock'n'roll", "'tis", "''я''", "foo_bar-baz", "…", "", "42", "ñandú", "guitarra", "Cïty")
    rows, words = transcripts(spark, 5, 6, 150, odd)
    draw = random.Random(1)
    some = {f"f{f}": sorted({" ".join(r[2] for r in rows[f * 150 + a : f * 150 + a + draw.randrange(1, 4)]) for a in (draw.randrange(140) for _ in range(8))} | {"Karmaty", "яяяя"}) for f in range(6)}
    t = spark.createDataFrame([(f, x) for f, xs in some.items() for x in xs], "file_id string, term string").select("file_id", refining.plain(F.col("term")).alias("term"))
    t = t.where(refining.letters(F.col("term")) >= 3).distinct().withColumns({"t_n": refining.letters(F.col("term")), "t_s": F.replace(sounds.phonemes(F.col("term"), F.lit(lang)), F.lit(" "))})
    told = lambda df: sorted((r.file_id, r.start_idx, r.end_idx, round(r.distance, 9)) for r in df.collect())
    few, many = told(refining._near_among_few(words, t, lang)), told(refining._near_among_many(words, t, lang))
    assert few == many and len(few) > 40
    more = [("f0", f"filler{i:03d}zz") for i in range(matching.FEW + 1)] + [(f, x) for f, xs in some.items() for x in xs]
    both = refining.term_near(words, spark.createDataFrame(more, "file_id string, term string"), lang)
    got = {(r.file_id, r.start_idx, r.end_idx) for r in both.collect()}
    alone = {(r.file_id, r.start_idx, r.end_idx) for r in refining.term_near(words, spark.createDataFrame(more[matching.FEW + 1 :], "file_id string, term string"), lang).collect()}
    assert {x for x in got if x[0] != "f0"} == {x for x in alone if x[0] != "f0"} and any(x[0] == "f0" for x in got)


def test_words_in_spans(spark):
    words = spark.createDataFrame([(f, i, f"w{i}") for f in "ab" for i in range(6)], "file_id string, pos int, text string")
    spans = spark.createDataFrame([("a", 1, 3, "x"), ("a", 3, 4, "y"), ("b", 5, 6, "z")], "file_id string, start_idx int, end_idx int, reason string")
    got = {(r.file_id, r.pos): (r.start_idx, r.end_idx, r.reason) for r in refining.in_spans(words, spans, ["reason"]).collect()}
    assert len(got) == 12 and got["a", 0] == got["a", 4] == got["b", 4] == (None, None, None)
    assert got["a", 1] == got["a", 2] == (1, 3, "x") and got["a", 3] == (3, 4, "y") and got["b", 5] == (5, 6, "z")


def test_rewrites_are_applied_with_words_moved_once(spark):
    """Neither the words nor their places are joined to every place of a rewrite."""
    rows, words = transcripts(spark, 4, 10, 400)
    found = [(r[0], r[1], r[1] + 1, "new words", "accepted" if r[1] % 20 == 0 else "audio") for r in rows if r[1] % 10 == 0]
    verdicts = spark.createDataFrame(found, "file_id string, start_idx int, end_idx int, replacement string, verdict string")
    got, n, _ = moved(spark, lambda: refining.apply_edits(words, verdicts).collect())
    want = [x for r in rows for x in (["new", "words"] if r[1] % 20 == 0 else [r[2]])]
    assert [r.text for r in sorted(got, key=lambda r: (int(r.file_id[1:]), r.pos))] == want and n < 4 * len(rows)


def test_items_move_their_texts_once(spark):
    """Words that are those of the text travel as flags; others, nulls, missing outputs and ids that repeat are scored as by a plain join."""
    draw = random.Random(11)
    text = lambda n: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 9))) for _ in range(n))
    refs = {f"i{i}": text(200) for i in range(60)}
    items = [(k, s, "x", "dev", "en", r, 3.0, None) for k, r in refs.items() for s in ("one", "two")] + [("dup", "one", "x", "dev", "en", "a b", 1.0, None)] * 2 + [(None, "one", "x", "dev", "en", "a b", 1.0, None), ("none", "one", "x", "dev", "en", "a b", 1.0, "language")]
    flags = lambda t: [(x, draw.random() < 0.3) for x in t.split(" ")]
    outputs = []
    for i, (k, r) in enumerate(refs.items()):
        for s in ("one", "two"):
            said = " ".join(w if draw.random() < 0.8 else text(1) for w in r.split(" "))
            outputs.append((s, k, said, flags(said), None))
    outputs += [("one", "dup", "a", [("a", None)], None), ("one", "dup", "b  c", [("b", True), ("", None), ("c", None)], None), ("two", "dup", "a", None, None), ("one", None, "a", [("a", True)], None), ("three", "i0", "a", [], None)]
    items += [("odd1", "one", "x", "dev", "en", "a b c", 1.0, None), ("odd2", "one", "x", "dev", "en", "a b c", 1.0, None), ("odd3", "one", "x", "dev", "en", "", 1.0, None)]
    outputs += [("one", "odd1", "a b", [("a b", True), (None, True), ("c d", False)], None), ("one", "odd2", None, [("a", True)], None), ("one", "odd3", "", [("", True)], None)]
    i = spark.createDataFrame(items, "id string, system string, slice string, split string, lang string, ref string, duration double, skipped string")
    o = spark.createDataFrame(outputs, "system string, id string, text string, words array<struct<text:string,unclear:boolean>>, error string")
    names = ["id", "system", *scoring.TEXT_SCORES, *scoring.UNCLEAR, "empty_ref"]
    plain = scoring.text_scores(i.join(o.withColumnsRenamed({"text": "hyp", "words": "said_words"}), ["system", "id"], "left"), "said_words")
    want = sorted(map(str, plain.select(names).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _, size = moved(spark, lambda: sorted(map(str, scoring.score_items(i, o).select(names).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and len(got) == 60 * 2 + 4 + 1 + 1 + 3
    assert size < 1.3 * sum(len(x[5]) for x in items) * 2
