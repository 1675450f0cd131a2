import random

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from murmuration.functions import edits
from murmuration.operators import fusion, scoring


def test_speech_windows_round_as_their_sql(spark, tmp_path):
    """Merged speech of odd lengths puts windows at halves of a millisecond."""
    import duckdb

    ts = F.timestamp_millis(F.pmod(F.xxhash64("id"), F.lit(20_000_000)) + (F.col("id") % 1500) * 1_500_000 + 1704067200000)
    events = spark.range(60000).select(F.col("id").alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), (F.col("id") % 1500).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(entry_module.oracle_sql()["speech_windows"]).fetchall()
    got = [tuple(r) for r in entry_module.queries()["speech_windows"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_speech_windows_begin_at_borders_as_in_their_sql(spark, tmp_path):
    """The last window begins just where speech ends; events before 2024 lie between milliseconds."""
    import duckdb

    draw = random.Random(7)
    rows = []
    for user in range(600):
        early = [draw.randrange(65_000, 100_000) for _ in range(8)]
        at = [sum(early[: k + 1]) for k in range(8)] + [1_000_000 + k * 100_000 + draw.randrange(30_000) for k in range(5)]
        rows += [(user, (t if user % 4 else t - 3_000_000) * 1000 + user) for t in at]
    made = spark.createDataFrame(rows, "user_id long, us long").withColumn("event_id", F.monotonically_increasing_id())
    ts = F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'2024-01-01 00:00:00')")
    events = made.select("event_id", ts.alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(entry_module.oracle_sql()["speech_windows"]).fetchall()
    got = [tuple(r) for r in entry_module.queries()["speech_windows"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_a_batch_is_taken_apart_by_its_words():
    """What becomes Python objects at a time doesn't grow with the rows of a batch."""
    lists = [["w"] * n for n in (0, 3, 90, 2, 2, 2, 200, 1)] * 50 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "w"])
    for b in (batch, batch.slice(7, 300)):
        parts = list(edits.pieces(b, "w", most=100))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and all(p.num_rows == 1 or sum(len(x or ()) for x in p.column("w").to_pylist()) <= 100 for p in parts)
    assert list(edits.pieces(batch.slice(0, 0), "w")) == []


def test_alignment_takes_texts_by_place(spark):
    """Blanks, null texts, one-sided chunks and more words than a piece holds."""
    assert fusion.slots_of(["a", "-", "b"], ["a", "b", "c"], "en") == [(edits.EQUAL, 0, 0, False), (edits.EQUAL, 1, None, True), (edits.EQUAL, 2, 1, False), (edits.ONLY_B, None, 2, False)]
    rows = [("f", c, e, i, f"w{i}" if i % 9 else None if c else "...", 0.5) for c in range(60) for e in "ab" for i in range(300) if (e == "a" or i % 7) and (c != 5 or e == "b")]
    got = fusion.align_engines(spark.createDataFrame(rows, "file_id string, chunk long, engine string, pos long, text string, prob double")).collect()
    said = lambda c, side: [r[side] for r in sorted((r for r in got if r.chunk == c), key=lambda r: r.pos) if r["p" + side] is not None]
    for c in (0, 5, 59):
        assert said(c, "a") == [t for _, k, e, _, t, _ in rows if (k, e) == (c, "a")]
    assert {r.kind for r in got if r.chunk == 5} == {"b_only"} and {r.kind for r in got if r.chunk != 5} == {"agree", "a_only"}


def test_texts_are_scored_in_one_pass(spark):
    """The same counts as normalizing first and aligning lists of words after; easy and hard words, forms, null texts."""
    from murmuration.functions import normal
    from murmuration.operators import scoring

    texts = ["He's St. John, isn't he | twenty-five of%%% them", "won't uh pay $2,500 (laughs) to dr who", "", None, "the cat sat", "y treinta y cinco | mil uno más", "can t wanna"]
    rows = [(r, h, lang) for r in texts for h in texts for lang in ("en", "es", "de")]
    for r in scoring.word_errors(spark.createDataFrame(rows, "ref string, hyp string, lang string").repartition(3)).collect():
        assert (r["sub"], r["del"], r["ins"], r["hits"], r["words"]) == edits.counts(normal.tokens_of(r.ref, r.lang), normal.tokens_of(r.hyp, r.lang))
    for r in scoring.text_effects(spark.createDataFrame([(*x, "the dog sat") for x in rows], "ref string, before string, lang string, after string")).collect():
        assert (r["help"], r["harm"], r["neutral"]) == edits.effects(*(normal.tokens_of(t, r.lang) for t in (r.ref, r.before, r.after)))
    for text in filter(None, texts):
        got, flags = normal.flagged(text.split(), [w.startswith("t") for w in text.split()], "en")
        assert got == normal.tokens_of(text, "en") and len(flags) == len(got)


def test_shots_with_equal_thumbs(spark):
    """Equal thumbs go to the first kept shot that they are alike to; a null one stays by itself."""
    from murmuration.operators import sequential

    thumbs = [[0.0, 0.0], [30.0, 0.0], [60.0, 0.0], [30.0, 0.0], [60.0, 0.0], None, None, [0.0, 0.0], [60.0, 0.0]] + [[0.0, 0.0]] * 30
    got = sequential.distinct_shots(spark.createDataFrame([(1, i, t) for i, t in enumerate(thumbs)], "video_id long, shot long, thumb array<double>")).collect()
    assert [r.slide for r in sorted(got, key=lambda r: r.shot)] == [0, 0, 2, 0, 2, 5, 6, 0, 2] + [0] * 30


def test_runs_meet_few_terms_without_segments(spark, monkeypatch):
    """The same pairs whether terms are few for their length, many, or both."""
    from murmuration.operators import matching

    words = [("f", a + b + c) for a in ("KR", "PST", "SA") for b in ("TAS", "PAK", "") for c in ("RAS", "KIP", "TOL")]
    runs, terms = spark.createDataFrame([*words, ("f", None), ("f", "KRTASRAS")], "file string, g_s string"), spark.createDataFrame(words[::2], "file string, t_s string")
    got = []
    for few in (0, 3, 100):
        monkeypatch.setattr(matching, "FEW", few)
        near = matching.near_sounds(runs, terms, ["file"], 0.35)
        got.append(sorted(map(tuple, near.collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 20
    # of few terms a run is a row, not one for each segment
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "_many" in plan


def test_bootstrap_draws_once(spark):
    """Draws are those of the whole numbers behind them, each is made once, and many groups come out of a task in parts."""
    import numpy as np

    from murmuration.operators import metrics

    seed = np.random.default_rng(3).integers(0, 1 << 63, 3000, dtype=np.uint64)
    x = seed[:, None] + np.arange(1, 501, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    assert (metrics.poisson(seed, 500) == np.searchsorted(metrics.POISSON, u, side="right")).all()
    edges = np.unique(np.concatenate([(metrics.POISSON * 2**16).astype(int) + i for i in (-1, 0, 1)]).clip(0, 65535))
    low, high = (np.searchsorted(metrics.POISSON, v, side="right") for v in (edges * 2.0**-16, (edges + 1) * 2.0**-16 - 2.0**-53))
    assert (metrics.DRAWS[edges] == np.where(low == high, low, metrics.OPEN)).all()

    rows = spark.range(2000).select((F.col("id") % 700).alias("k"), (F.col("id") / 2000).alias("v"))
    ci = metrics.bootstrap(rows, "v", "k", n=50)
    assert ci._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.k: r for r in ci.collect()}
    assert len(got) == 700
    for k, r in got.items():
        own = [i / 2000 for i in range(2000) if i % 700 == k]
        assert r.n == len(own) and abs(r.mean - sum(own) / len(own)) < 1e-12 and min(own) - 1e-9 <= r.lo <= r.hi <= max(own) + 1e-9
    none = metrics.bootstrap(rows.where("v > 2"), "v", n=50).first()
    assert (none.mean, none.n, none.lo, none.hi) == (None, None, None, None)


def test_distances_side_by_side(spark, monkeypatch):
    """The least edits of every pair, whatever its neighbours; scores of held rows come back in their order."""
    import random

    from murmuration.functions import normal
    from murmuration.operators import scoring

    rng, side = random.Random(7), []
    bad = lambda a: "".join(rng.choice([c, c, c, c, "", c + "x", rng.choice("abcé😀")]) for c in a)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.choice([0, 1, 2, 63, 64, 65, 128, 200, rng.randrange(600)]))) for _ in range(400)]
    pairs = [(a, bad(a) if k % 5 else "".join(rng.choice("abc xé") for _ in range(rng.randrange(300)))) for k, a in enumerate(texts)]
    want = [edits.distance(a, b) for a, b in pairs]
    both = edits._side_by_side
    monkeypatch.setattr(edits, "_side_by_side", lambda group: side.append(len(group)) or both(group))
    assert edits.distances([(a, b, d + rng.choice([0, 1, 30, 400])) for (a, b), d in zip(pairs, want)]) == want and sum(side) > 200
    assert edits.distances([]) == [] and edits.distances([("", "ab", 9), ("a", "a", 9)]) == [2, 0]

    monkeypatch.setattr(scoring, "HELD_ROWS", 37)
    rows = [(k, a, b, "de") for k, (a, b) in enumerate(pairs)] + [(400, None, "x", "de"), (401, "x", None, "en")]
    got = {r.k: r for r in scoring.text_scores(spark.createDataFrame(rows, "k int, ref string, hyp string, lang string")).collect()}
    assert len(got) == 402
    for k, a, b, lang in rows:
        r, h = normal.tokens_of(a, lang), normal.tokens_of(b, lang)
        assert (got[k]["sub"], got[k]["del"], got[k]["ins"], got[k].hits, got[k].words, got[k].char_errors) == edits.word_scores(r, h)


def test_training_keeps_no_powers(spark):
    """The driver hashes words once, when it learns labels; what that took is free after it."""
    from murmuration.llm import shared, toxicity

    docs = spark.createDataFrame([(i, f"some {'awful' if i % 2 else 'kind'} words w{i}") for i in range(60)], "doc_id long, text string")
    toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert not shared._POWERS
    assert len(shared.words(b"a b")[0]) == 2 and shared._POWERS  # made again where words are hashed again


def test_toxicity_is_learned_in_a_task(spark, monkeypatch):
    """The driver neither collects the texts nor fits: what it gets is the same field; a sample of none gives the empty one."""
    from murmuration.llm import toxicity

    rows = [(i, f"word{i % 7} said of {'idiot scumbag' if i % 3 == 0 else 'day ñandú'} {i % 11}" * 3, int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, None if i == 5 else t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    known = sorted((r.doc_id, r.text, r.toxic) for r in toxicity.sample_labels(docs, labels).collect())
    want = toxicity.fit([t.encode() for _, t, _ in known], [y == 1 for *_, y in known])
    here, fit, calls = __import__("os").getpid(), toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda *a: (calls.append(len(a[0])) if __import__("os").getpid() == here else None, fit(*a))[1])
    got = toxicity.train(docs, labels)
    assert not calls and want.keys.any() and (got.keys == want.keys).all() and (got.weights == want.weights).all()
    assert got.bias == want.bias and (got.moves == want.moves).all() and (got.scale == want.scale).all()
    none = toxicity.train(docs, labels.where("toxic > 1"))
    assert not none.keys.any() and none.bias == -6.0


def test_terms_look_at_telling_words_only(spark):
    """Words are taken out once and of chunks that can hold a term; places, names over gaps and shouting are as they were for all words."""
    from murmuration.functions import parsing

    cases = {
        "and Ada then Lovelace, Ada Lovelace now": [(2, "Ada Lovelace")], "one word iPhone": [(2, "iPhone")], "Only one capital here, and Another": [], "no capital, no number": [],
        "EVERY NASA WORD": [], "EVERY NASA word": [(0, "EVERY"), (1, "NASA")], "so ½ x² 30k x9": [(2, "x²"), (4, "x9")], "Saw Alan Kay x9 Grace Hopper": [(3, "x9"), (3, "Alan Kay"), (6, "Grace Hopper")], "see Www.A.org/B or HTTPS://c.D/E": [],
    }
    terms = parsing.extract_terms(spark.createDataFrame([(i, 0, t, False) for i, t in enumerate(cases)], "file_id int, part int, text string, title boolean"))
    got: dict = {}
    for r in terms.orderBy("file_id", "pos").collect():
        got.setdefault(r.file_id, []).append((r.pos["at"], r.term))
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_bands_narrow_as_edits_are_spent(monkeypatch):
    """Distances with enough edits given, and by widening; of a long pair fewer rows are worked out than the diagonals alone leave."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += ["".join(c for i, c in enumerate(t) if i % 9) for t in texts] + ["".join(t[i : i + 5][::-1] for i in range(0, len(t), 5)) for t in texts]
    for width in (64, 3):
        monkeypatch.setattr(edits, "NARROW", width)
        for a, b in zip(texts, texts[60:] + texts[:60]):
            want = sum(k != edits.EQUAL for k in edits.moves(a, b))
            assert edits.distance(a, b) == want and all(edits.distance(a, b, want + more) == want for more in (0, 1, 40) if want + more)
    monkeypatch.setattr(edits, "NARROW", 64)
    a = "".join(rng.choice("abcdefgh") for _ in range(8000))
    b = "".join(c if i % 6 else "x" for i, c in enumerate(a))
    rows, columns = [], edits._columns
    monkeypatch.setattr(edits, "_columns", lambda places, part, up, down, mask: (rows.append(len(part) * mask.bit_length()), columns(places, part, up, down, mask))[1])
    assert edits.distance(a, b, 1800) == sum(i % 6 == 0 for i in range(8000)) and sum(rows) < 8000 * 1800


def test_reference_of_an_item_once(spark):
    """Rows of an item follow each other and share what is made of its reference; the words' bound of the edits between characters counts equal places."""
    assert edits.word_pair(["abc", "def", "g"], ["abd", "def"])[-1] == ("abc def g", "abd def", 3)
    rng = random.Random(11)
    word = lambda: rng.choice(["uno", "twenty", "Berlin", "ab|", "xyz", "zyx", "|", "5"])
    for _ in range(300):
        a, b = ([word() for _ in range(rng.randrange(12))] for _ in range(2))
        *_, (x, y, most) = edits.word_pair(a, b)
        assert edits.distance(x, y) <= most
        assert edits.moves(a, b, edits._places(a)) == edits.moves(a, b)
    refs = [" ".join(word() for _ in range(30)) for _ in range(9)] + [None, ""]
    rows = [(str(i) if i % 4 else None, f"s{s}", r, " ".join(word() for _ in range(25)), "en") for i, r in enumerate(refs) for s in range(3)]
    df = spark.createDataFrame(rows, "id string, system string, ref string, hyp string, lang string")
    assert sorted(map(str, scoring.text_scores(df, item="id").collect())) == sorted(map(str, scoring.text_scores(df).collect()))
    partitions = edits.spread(df, "id", "ref").sortWithinPartitions("id").select("id", "ref").rdd.glom().collect()
    for own in partitions:
        keys = [r.id for r in own if r.id is not None]
        assert keys == sorted(keys)
