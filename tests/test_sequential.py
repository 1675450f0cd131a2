import random

import pytest

from murmuration.operators import sequential as S


@pytest.mark.parametrize(
    "ref, hyp, want",
    [
        ([(0, 5, "1"), (5, 10, "2")], [(0, 5, "B"), (5, 10, "A")], 0.0), ([(0, 5, "1"), (5, 10, "2"), (10, 15, "1")], [(0, 5, "a"), (5, 10, "b")], 5 / 15), ([(0, 10, "1"), (0, 10, "2")], [(0, 10, "x")], 0.5),
        ([], [(0, 1, "x")], 1.0), ([(0, 10, "1")], [(0, 5, "a"), (5, 10, "b")], 0.5),
    ],
)
def test_diarization(spark, ref, hyp, want):
    rows = [("i", side, float(s), float(e), who) for side, turns in (("ref", ref), ("hyp", hyp)) for s, e, who in turns]
    got = S.diarization_error(spark.createDataFrame(rows, "item string, side string, start double, end double, speaker string"), 0.0).first()
    assert got.der == pytest.approx(want)


def framewise(rows, collar, best):
    """By the definition, frame by frame, with every mapping tried."""
    half = round(collar * 100)
    turns: list = []
    for side, who, s, e in sorted((side, who, round(s * 100), round(e * 100)) for side, s, e, who in rows):  # a speaker's turns that touch are one
        if turns and turns[-1][:2] == (side, who) and s <= turns[-1][3]:
            turns[-1] = (side, who, turns[-1][2], max(e, turns[-1][3]))
        else:
            turns.append((side, who, s, e))
    last = max((e for *_, e in turns), default=0) + half
    shut = {t for side, _, s, e in turns if side == "ref" for x in (s, e) for t in range(max(0, x - half), x + half)}
    frames = [t for t in range(last) if t not in shut]
    active = {t: ({w for d, w, s, e in turns if d == "ref" and s <= t < e}, {w for d, w, s, e in turns if d == "hyp" and s <= t < e}) for t in frames}
    total = sum(len(r) for r, _ in active.values())
    if not total:
        return 1.0 if any(h for _, h in active.values()) else 0.0
    refs, hyps = sorted({w for d, w, *_ in turns if d == "ref"}), sorted({w for d, w, *_ in turns if d == "hyp"})
    hyps += [None] * len(refs)
    right = max(sum(sum(1 for a, b in active.values() if r in a and h in b) for r, h in zip(refs, chosen) if h) for chosen in best(hyps, len(refs)))
    return (sum(max(len(r), len(h)) for r, h in active.values()) - right) / total


def test_diarization_frame_by_frame(spark):
    import itertools

    rng = random.Random(6)
    items = {}
    for i in range(12):
        items[i] = [(side, a / 10, (a + rng.randrange(1, 25)) / 10, f"{side[0]}{rng.randrange(3)}") for side in ("ref", "hyp") for a in (rng.randrange(60) for _ in range(rng.randrange(0, 6)))]
    items = {i: t for i, t in items.items() if t}
    rows = [(i, *t) for i, own in items.items() for t in own]
    df = spark.createDataFrame(rows, "item int, side string, start double, end double, speaker string")
    for collar in (0.0, 0.25):
        got = {r.item: r.der for r in S.diarization_error(df, collar, width=1.0).collect()}
        assert got == {i: pytest.approx(framewise(own, collar, itertools.permutations)) for i, own in items.items()}


def test_refined(spark):
    seg = spark.createDataFrame([("f", 0, "the cat sat on a mat"), ("f", 1, "hello"), ("f", 2, "keep me here please")], "file_id string, pos int, text string")
    new = spark.createDataFrame([("f", 0, "The cat sat on the mat."), ("f", 1, "utterly different words"), ("f", 2, " ")], "file_id string, pos int, text string")
    got = S.apply_refined(seg, new).orderBy("pos").collect()
    assert [(r.text, r.changed, r.guarded) for r in got] == [("The cat sat on the mat.", True, False), ("hello", False, True), ("keep me here please", False, False)]


def test_shots(spark):
    rows = [(1, i, [float(v)] * 4) for i, v in enumerate([0, 100, 5, 103, 200])]
    got = S.distinct_shots(spark.createDataFrame(rows, "video_id long, shot long, thumb array<double>")).orderBy("shot").collect()
    assert [r.slide for r in got] == [0, 1, 0, 1, 4]


def test_shots_against_a_walk(spark):
    """Shots a few pixels apart, chains of ones alike, repeats; with no, one and more pixels that may change."""
    rng = random.Random(2)
    rows, pool = [], []
    for v in range(3):
        for i in range(60):
            x = [float(rng.randrange(0, 255)) for _ in range(12)] if not pool or rng.random() < 0.3 else list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                x[rng.randrange(12)] += rng.choice([-45, -40, 39, 40, 41, 90])
            pool.append(x)
            rows.append((v, i, x))
    df = spark.createDataFrame([*rows, (9, 1, None), (9, 2, [])], "video_id long, shot long, thumb array<double>").repartition(3)
    for same in (0.0003, 0.1, 0.2):
        want, kept = {(9, 1): 1, (9, 2): 2}, {}
        for v, i, x in rows:
            home = next((k for k, y in kept.get(v, []) if sum(abs(a - b) > 40 for a, b in zip(x, y)) / 12 <= same), None)
            if home is None:
                kept.setdefault(v, []).append((i, x))
            want[v, i] = i if home is None else home
        assert {(r.video_id, r.shot): r.slide for r in S.distinct_shots(df, same).collect()} == want
