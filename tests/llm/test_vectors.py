"""Vector codes and whitening on small rows, held against plain loops and numpy."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from murmuration.llm import codes, vectors, whitening

EMBEDDINGS = "vec_id long, embedding array<double>, label int"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """By the definition, in Python's whole numbers."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (dim - len(v)), lab) for i, v, lab in kept]
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda: [[min((dist(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), g in zip(kept, got) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    labels = {}
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] = labels.get(lab, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in g), err, labels[lab], sha) for (i, _, lab), g, err in zip(kept, got, errors)), key=str)


def some_vectors(rng, n, dim=16):
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(dim)], rng.choice([1, 1, 1, 2, None])) for i in rng.sample(range(1000), n)]
    return rows + [(5, None, 1), (6, [1.0, None] + [0.0] * (dim - 2), 1), (7, [float("nan")] * dim, 2), (8, [float("inf")] * dim, 2), (None, [0.5] * dim, 2), *rows[:3]]


@pytest.mark.parametrize("seed,n", [(1, 80), (2, 9)])
def test_codes_equal_the_definition(spark, seed, n):
    rows = some_vectors(random.Random(seed), n)
    got = codes.compress(spark.createDataFrame(rows, EMBEDDINGS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    mixed = [(i, [float(i)] * (i % 5 + 1), None) for i in range(30)] + [(99, [], 3)]
    got = codes.compress(spark.createDataFrame(mixed, EMBEDDINGS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_codes(mixed)
    assert codes.compress(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    none = codes.compress(spark.createDataFrame([(None, [1.0], 2)], EMBEDDINGS)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in none] == [(None, "", 0, 0)]
    only_empty = codes.compress(spark.createDataFrame([(1, [], 2), (2, [], 2)], EMBEDDINGS)).collect()
    assert {(r.code, r.error) for r in only_empty} == {("00" * 8, 0)}
    clash = spark.createDataFrame([(i, [float(i % 3)] * 8, 1, "x", 7) for i in range(20)], EMBEDDINGS + ", code string, total int")
    assert sorted(clash_row.vec_id for clash_row in codes.compress(clash).collect()) == list(range(20))


def test_codes_of_great_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**40 for _ in range(8)], 1) for i in range(40)] + [(50, [1e300] * 8, 1)]
    got = {r.vec_id: r for r in codes.compress(spark.createDataFrame(rows, EMBEDDINGS)).collect()}
    wanted = {r[0]: r for r in brute_codes([*rows[:-1], (50, [2.0**53 / 4096] * 8, 1)])}
    most = codes.LONGEST
    for i, r in got.items():
        assert (r.code, r.error, r.codebooks_sha256) == (wanted[i][1], min(wanted[i][2], most), wanted[i][4])


def test_annulus_leaves_nothing_out():
    """Ties between entries go to the lower index; distances outside the annulus aren't evaluated."""
    rng = np.random.default_rng(3)
    for spread in (3, 50, 5000):
        x, c = rng.integers(-spread, spread, (300, 4)), rng.integers(-spread, spread, (16, 4))
        c[9] = c[2]
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        for big in (False, True):
            index, best, _ = codes.nearest(x, c, big)
            assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    shells = np.outer(np.arange(1, 17) * 1000, [1, 0, 0, 0])
    x = shells[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 4))
    assert codes.nearest(x, shells)[2] < 2 * len(x)


def test_grid_keeps_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"v": pa.array([[1.5, -0.1], None, [], [2.0, None], [float("inf")], [0.25]], pa.list_(pa.float32()))})
    x, good = vectors.grid(batch, 4, 3)
    assert good.tolist() == [True, False, True, False, False, True]
    assert x.tolist() == [[6, -1, 0], [0, 0, 0], [1, 0, 0]]


# ---------------------------------------------------------------- whitening


def brute_whitening(rows, k=32):
    kept = [v for _, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max(map(len, kept))
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v + [0.0] * (dim - len(v))] for v in kept], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    y = (d / n).astype(float)
    e, a = np.linalg.eigh(y.T @ y / n)
    return n, [int(v) for v in (d * d).sum(1)], y, e[::-1][:k], a[:, ::-1][:, :k], np.trace(y.T @ y / n)


def held_against(spark, rows, **options):
    got = whitening.whiten(spark.createDataFrame(rows, EMBEDDINGS).repartition(3), **options).collect()
    k = options.get("components", 32)
    n, deviation, y, e, axes, trace = brute_whitening(rows, k)
    wanted = (y @ axes) / np.sqrt(e)
    order = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    assert len(got) == len(order) * len(e)
    rows_of = {}
    for r in got:
        rows_of.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    sign = {}
    for (i, _, _), dev, w in zip(order, deviation, wanted):
        for c in range(1, len(e) + 1):
            r = rows_of[i, dev][c]
            assert r.n == n and abs(r.explained - e[c - 1] / trace) < 1e-9 and 0 <= r.identity_error < 1e-9
            if abs(w[c - 1]) > 1e-3:
                sign.setdefault(c, np.sign(w[c - 1] * r.whitened))
            assert abs(r.whitened * sign.get(c, 1) - w[c - 1]) < 1e-6
    return got


def decaying(rng, n, dim, fall):
    basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return (rng.standard_normal((n, dim)) * 400 * fall ** np.arange(dim)) @ basis


def test_whitening_of_a_flat_spectrum_expands(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((300, 48)))]
    rows += [(900, None, 1), (901, [None] * 48, 1), (902, [float("nan")] * 48, 1), (3, rows[3][1], 1), (None, [0.5] * 48, 2)]
    held_against(spark, rows)
    frame = spark.createDataFrame(rows, EMBEDDINGS).select(whitening.F.col("embedding").alias("v"))
    assert whitening.fit(frame).expanded


def test_whitening_of_a_falling_spectrum_needs_no_expansion(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(decaying(rng, 400, 60, 0.5))]
    frame = spark.createDataFrame(rows, EMBEDDINGS).select(whitening.F.col("embedding").alias("v"))
    found = whitening.fit(frame, components=3, passes=12)
    assert not found.expanded and found.passes < 12
    held_against(spark, rows, components=3, passes=12)


def test_sweeps_don_t_lose_digits_to_the_shift(spark):
    rows = [(i, [2e-2 * (i % 2), 3e5 + i % 3, -1e4 + i % 5], 1) for i in range(60)]
    held_against(spark, rows)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, EMBEDDINGS)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0], 1)])).count() == 0
    assert whitening.whiten(make([(i, [1.0, 2.0], 1) for i in range(5)])).count() == 0
    assert whitening.whiten(make([(1, [], 1), (2, None, 1)])).count() == 0
    flat = whitening.whiten(make([(i, [float(i), 1.0], 1) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and abs(sum(r.whitened**2 for r in flat) / 9 - 1) < 1e-12
    held_against(spark, [(i, [float(i * i % 7)] * (1 + i % 3), 1) for i in range(40)])
    great = whitening.whiten(make([(1, [1e300], 1), (2, [-1e300], 1), (3, [0.0], 1)])).collect()
    assert {r.deviation for r in great} <= {whitening.LONGEST, 0, *range(10**7)} and len(great) == 3
    clash = spark.createDataFrame([(i, [float(i)], 1, 2, 3) for i in range(4)], EMBEDDINGS + ", n int, component int")
    assert whitening.whiten(clash).count() == 4


def test_exact_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 5]]) + whitening.SHIFT
    sums = tuple(int(v) for v in x.sum(0))
    assert whitening.deviations(x, 2, sums) == [min(sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums)), whitening.LONGEST) for r in x]
