"""Exact top-k inner products by a pivot-distance index.

Inner products become angles by one more coordinate: with M the greatest norm of all vectors,
x' = (x, sqrt(M^2 - |x|^2)) / M lies on a sphere, and for q' = (q, 0) / |q| the inner product is
q.x = |q| M cos(q', x'). Angles are a metric. Every vector is keyed by its nearest pivot and its
angle to it. Per pivot the angles are cut into rings, and within a ring the sorted vectors into annuli.

A query's k-th best score among a bounded sample is its first bound. It then expands over rings,
those that may hold the best scores first, and what they give is its bound for the rest. A ring
or annulus [low, high] around pivot p is never joined if the triangle inequality,
angle(q', x') >= max(angle(q', p) - high, low - angle(q', p)), leaves no room for a score of the bound
or more. The search stops where no ring is left.

Pivots, the edges of rings and the first bounds come from a sample (at most `SAMPLE` rows and
`SAMPLE_BYTES`, those with the smallest hash of their id); the index holds every row, and the
search is exact whatever the sample is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared

PIVOTS, SAMPLE, SAMPLE_BYTES = 32, 4096, 32 << 20
RING_ROWS, RINGS, MAX_RINGS = (2048, 65536), 128, 65536
ANNULUS, ANNULUS_BYTES, PACK, NEAR = 1024, 1 << 20, 256, 8
TILE = 64  # packs of queries that one task holds against one part of a ring
ROOM = 1e-6  # radians that rounding may take
LEAST = np.iinfo(np.int64).min
ANNULI = "ring int, sub int, low double, high double, n int, ids binary, vectors binary"
PACKS = "ring int, pack string, lo double, hi double, n int, q_ids binary, q_vectors binary, q_bounds binary"


class Index(NamedTuple):
    """annuli: the packed rows. The rest is bounded, whatever the rows: pivots, a row for each ring, the sample."""

    annuli: DataFrame
    rows: int
    dim: int
    most: float
    kind: str
    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ring: np.ndarray
    size: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray


# ---------------------------------------------------------------- vectors


def matrix(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows floor(256 x), padded with zeros, of the vectors of a batch (id, v) that take part."""
    lists = batch.column("v")
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    bad = np.bincount(owner, ~np.isfinite(values), minlength=len(size)) > 0
    good = ~bad & np.asarray(lists.is_valid()) & np.asarray(batch.column("id").is_valid())
    x = np.zeros((len(size), dim if dim is not None else int(size.max(initial=0))))
    at = good[owner]
    x[owner[at], (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))[at]] = values[at]
    return np.asarray(batch.column("id").filter(pa.array(good))).astype(np.int64), x[good]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def about(vectors: DataFrame):
    """n, dim, most (greatest squared norm) and peak (greatest component) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, x = matrix(b)
            if len(ids):
                yield pa.RecordBatch.from_pylist([dict(n=len(ids), dim=x.shape[1], most=float((x**2).sum(1).max(initial=0)), peak=float(np.abs(x).max(initial=0)))])

    got = vectors.mapInArrow(run, "n long, dim long, most double, peak double")
    return got.agg(F.sum("n").alias("n"), F.max("dim").alias("dim"), F.max("most").alias("most"), F.max("peak").alias("peak")).first()


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, as int64; beyond 64 bits the nearest long."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object)
    got = whole(q) @ whole(x).T
    return np.clip(got, -(2**63), 2**63 - 1).astype(np.int64)


def raised(x: np.ndarray, most: float) -> np.ndarray:
    """Rows on the unit sphere of one more dimension."""
    if not most:
        return np.hstack([x * 0, np.ones((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x**2).sum(1)))[:, None]]) / np.sqrt(most)


def directions(q: np.ndarray) -> np.ndarray:
    size = np.sqrt((q**2).sum(1))[:, None]
    return np.hstack([q / np.where(size > 0, size, 1), np.zeros((len(q), 1))])


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


# ---------------------------------------------------------------- index


def fit_pivots(unit: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Farthest-first seeds and a few rounds of k-means on the sphere."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(pivots, len(unit)) and near.min() < 1 - 1e-12:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen].copy()
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        for c in range(len(centres)):
            mean = unit[own == c].sum(0)
            size = np.sqrt((mean**2).sum())
            if size > 0:
                centres[c] = mean / size
    return centres


def ring_edges(unit: np.ndarray, pivots: np.ndarray, rings: int) -> list[np.ndarray]:
    """For each pivot the angles at which a ring ends and the next begins: quantiles of the sample."""
    angle = angles(unit, pivots)
    own = angle.argmin(1)
    out = []
    for c in range(len(pivots)):
        mine = np.sort(angle[own == c, c])
        n = int(round(rings * len(mine) / len(unit)))
        out.append(np.unique(mine[(np.arange(1, n) * len(mine)) // n]) if n > 1 else np.zeros(0))
    return out


def build(vectors: DataFrame, pivots: int = PIVOTS, annulus: int = ANNULUS) -> Index | None:
    """The index of (id, v), None if no vector takes part. Rows are shuffled once, by ring.

    A ring that a sample finds larger than a task should hold (copies of one vector lie at one angle) is dealt
    over parts by row number; rings themselves have bounds from all their rows.
    """
    told = about(vectors)
    if not told.n:
        return None
    spark, rows, dim, most = vectors.sparkSession, int(told.n), int(told.dim), float(told.most)
    kind = "<f4" if told.peak < 2**24 else "<f8"
    room = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
    sampled = vectors.where("id is not null and v is not null").orderBy(F.xxhash64("id"), "id").limit(room)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, x = matrix(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    got = sampled.mapInArrow(plain, "id long, v binary").collect()
    ids, x = np.array([r.id for r in got], np.int64), np.frombuffer(b"".join(r.v for r in got), np.float64).reshape(len(got), dim)
    ids, at = np.unique(ids, return_index=True)
    x = x[at]
    if not len(ids):  # only vectors that take no part have small hashes
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim))
    unit = raised(x if len(x) else np.zeros((1, dim)), most)
    centres = fit_pivots(unit, pivots)
    per_ring = min(max(rows // RINGS, RING_ROWS[0]), RING_ROWS[1])
    edges = ring_edges(unit, centres, min(MAX_RINGS, max(len(centres), rows // per_ring)))
    offset = np.concatenate(([0], np.cumsum([len(e) + 1 for e in edges]))).astype(np.int64)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = angles(raised(x, most), centres)
        own = angle.argmin(1)
        a = angle[np.arange(len(x)), own]
        ring = np.zeros(len(x), np.int64)
        for c in np.unique(own):
            mine = own == c
            ring[mine] = offset[c] + np.searchsorted(edges[c], a[mine], side="right")
        return ring, a

    share = np.bincount(place(x)[0], minlength=offset[-1]) * (rows / max(1, len(x)))
    subs = np.maximum(1, np.ceil(share / (2 * per_ring))).astype(np.int64)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for b in pieces(batches):
            ids, x = matrix(b, dim)
            ring, a = place(x)
            sub = (count + np.arange(len(ids))) % subs[ring]
            count += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ring, pa.int32()), pa.array(sub, pa.int32()), pa.array(a), pa.array(ids), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())],
                names=["ring", "sub", "angle", "id", "v"],
            )

    most_rows = max(1, min(annulus, ANNULUS_BYTES // (max(1, dim) * int(kind[-1]))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ring, sub = held[0][:2]
            a, ids, raw = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), b"".join(h[4] for h in held)
            held.clear()
            return pa.RecordBatch.from_pylist(
                [dict(ring=ring, sub=sub, low=float(a.min()), high=float(a.max()), n=len(a), ids=ids.tobytes(), vectors=raw)],
                schema=pa.schema([("ring", pa.int32()), ("sub", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]),
            )

        for b in batches:
            ring, sub, a, ids = (np.asarray(b.column(c)) for c in ("ring", "sub", "angle", "id"))
            raw = b.column("v").to_pylist()
            heads = np.flatnonzero(np.append(True, (np.diff(ring) != 0) | (np.diff(sub) != 0))) if len(ids) else np.zeros(0, int)
            for s, e in zip(heads.tolist(), np.append(heads[1:], len(ids)).tolist()):
                if held and held[0][:2] != (int(ring[s]), int(sub[s])):
                    yield out()
                while s < e:
                    to = min(e, s + most_rows - sum(len(h[2]) for h in held))
                    held.append((int(ring[s]), int(sub[s]), a[s:to], ids[s:to], b"".join(raw[s:to])))
                    if sum(len(h[2]) for h in held) >= most_rows:
                        yield out()
                    s = to
        if held:
            yield out()

    keyed = vectors.mapInArrow(key, "ring int, sub int, angle double, id long, v binary")
    dealt = keyed.repartition("ring", "sub").sortWithinPartitions("ring", "sub", "angle", "id")
    annuli = shared.materialize(dealt.mapInArrow(cut, ANNULI))
    # at most MAX_RINGS rows of numbers
    told = annuli.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("ring").collect()
    ring = np.array([r.ring for r in told], np.int64)
    return Index(
        annuli, rows, dim, most, kind, centres, np.searchsorted(offset, ring, side="right") - 1,
        np.array([r.low for r in told]), np.array([r.high for r in told]), ring, np.array([r.n for r in told], np.int64), ids, x,
    )


# ---------------------------------------------------------------- search


def queries_of(vectors: DataFrame, index: Index, chosen: Column) -> DataFrame:
    """(id, v binary) of the chosen rows that take part; rows that repeat an id and vector count once."""
    dim, kind = index.dim, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, x = matrix(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["id", "v"])

    return shared.materialize(vectors.where(chosen).mapInArrow(run, "id long, v binary").distinct())


def first_bounds(ids: np.ndarray, q: np.ndarray, index: Index, k: int) -> np.ndarray:
    """The k-th score of every query among the sample's other ids."""
    got = scores(q, index.sample)
    own = np.searchsorted(index.sample_ids, ids)
    hit = own < len(index.sample_ids)
    hit[hit] = index.sample_ids[own[hit]] == ids[hit]
    got[np.flatnonzero(hit), own[hit]] = LEAST
    if got.shape[1] < k + 1:
        return np.full(len(ids), LEAST)
    return np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k]


def wanted(asked: DataFrame, index: Index, k: int, begin: int, end: int | None) -> DataFrame:
    """Packs of queries for the rings at places begin..end of their order that their bounds leave.

    `asked` holds (id, v, bound); a null bound means that the sample gives it. A pack's [lo, hi] are the
    angles around the ring's pivot beyond which none of its queries can find a score of its bound.
    """
    shown = asked.sparkSession.sparkContext.broadcast(index._replace(annuli=None))  # bounded by MAX_RINGS, PIVOTS and the sample's bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shown.value
        schema = pa.schema([("ring", pa.int32()), ("pack", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("q_bounds", pa.binary())])
        for b in pieces(batches, max(16, min(4096, (1 << 22) // max(1, len(x.ring))))):
            ids = np.asarray(b.column("id"))
            q = np.frombuffer(b"".join(b.column("v").to_pylist()), x.kind).reshape(len(ids), x.dim).astype(np.float64)
            bound = first_bounds(ids, q, x, k)
            known = b.column("bound").is_valid().to_numpy(zero_copy_only=False)
            bound = np.where(known, np.maximum(bound, b.column("bound").fill_null(LEAST).to_numpy(zero_copy_only=False)), bound)
            theta = angles(directions(q), x.pivots)[:, x.cell]
            gap = np.maximum(0, np.maximum(theta - x.high, x.low - theta))
            length = np.sqrt((q**2).sum(1) * x.most)[:, None]
            best = length * np.cos(np.maximum(0, gap - ROOM))
            room = best + np.abs(best) * 1e-9 + 1 >= bound[:, None].astype(np.float64)
            order = np.argsort(gap + 1e-7 * np.abs(theta - (x.low + x.high) / 2), axis=1, kind="stable")
            chosen = np.zeros_like(room)
            np.put_along_axis(chosen, order[:, begin:end], True, axis=1)
            chosen &= room
            with np.errstate(invalid="ignore", divide="ignore"):
                need = np.clip((bound.astype(np.float64)[:, None] - 1) / np.where(length > 0, length, 1) - 1e-9, -1, 1)
            reach = np.where(length > 0, np.arccos(need), np.pi)[:, 0] + ROOM
            rows = []
            for r in np.flatnonzero(chosen.any(0)):
                mine = np.flatnonzero(chosen[:, r])
                mine = mine[np.argsort(theta[mine, r], kind="stable")]
                for at in range(0, len(mine), PACK):
                    own = mine[at : at + PACK]
                    rows.append(dict(
                        ring=int(x.ring[r]), pack=f"{x.ring[r]}/{ids[own[0]]}/{ids[own[-1]]}/{len(own)}/{at}", lo=float((theta[own, r] - reach[own]).min()), hi=float((theta[own, r] + reach[own]).max()), n=len(own),
                        q_ids=ids[own].tobytes(), q_vectors=q[own].astype(x.kind).tobytes(), q_bounds=bound[own].tobytes()))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return asked.mapInArrow(run, PACKS)


def meetings(packs: DataFrame, index: Index) -> DataFrame:
    """Packs and the annuli of their ring that they can't rule out. Each side is shuffled once for a tile of the other.

    A task holds one part of a ring against at most TILE packs, so neither many queries at one ring nor many rows in it meet in one task.
    """
    tiles = packs.groupBy("ring").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    subs = index.annuli.groupBy("ring").agg((F.max("sub") + 1).alias("subs"))
    left = packs.join(tiles, "ring").join(subs, "ring")
    left = left.select("*", F.pmod(F.xxhash64("pack"), F.col("tiles")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).drop("tiles", "subs", "n")
    right = index.annuli.join(tiles, "ring").select("ring", "sub", "low", "high", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    met = left.hint("merge").join(right, ["ring", "sub", "tile"]).where("high >= lo and low <= hi")
    return met.select("pack", "q_ids", "q_vectors", "q_bounds", "ids", "vectors")


def best_of(q: np.ndarray, ids: np.ndarray, got: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k best ids, an id by its greatest score, ties to the smaller id; ordered by query and rank."""
    order = np.lexsort((~got, ids, q))
    order = order[np.append(True, (np.diff(q[order]) != 0) | (np.diff(ids[order]) != 0))] if len(order) else order
    order = order[np.lexsort((ids[order], ~got[order], q[order]))]
    heads = np.flatnonzero(np.append(True, np.diff(q[order]) != 0)) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < k]


def scan(met: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each pack's annuli that reach the query's bound. The annuli of a pack come one after the other, and raise its bounds."""
    dim, kind = index.dim, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, asked, held = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(asked[0][held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                if r["pack"].as_py() != name:
                    if held is not None and len(held[0]):
                        yield out()
                    name, qid = r["pack"].as_py(), np.frombuffer(r["q_ids"].as_buffer(), np.int64)
                    asked = [qid, np.frombuffer(r["q_vectors"].as_buffer(), kind).reshape(len(qid), dim).astype(np.float64), np.frombuffer(r["q_bounds"].as_buffer(), np.int64).copy()]
                    held = [np.zeros(0, np.int64)] * 3
                ids = np.frombuffer(r["ids"].as_buffer(), np.int64)
                got = scores(asked[1], np.frombuffer(r["vectors"].as_buffer(), kind).reshape(len(ids), dim).astype(np.float64))
                q, v = np.nonzero((got >= asked[2][:, None]) & (ids[None, :] != asked[0][:, None]))
                if not len(q):
                    continue
                all_ = [np.concatenate([a, c]) for a, c in zip(held, (q, ids[v], got[q, v]))]
                top = best_of(*all_, k)
                held = [a[top] for a in all_]
                full = np.flatnonzero(np.bincount(held[0], minlength=len(asked[0])) == k)
                if len(full):
                    last = np.searchsorted(held[0], full, side="right") - 1
                    asked[2][full] = np.maximum(asked[2][full], held[2][last])
        if held is not None and len(held[0]):
            yield out()

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    kept = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    at = F.row_number().over(shared.W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", at.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, k: int = 5, step: int = 50, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, annulus: int = ANNULUS, near: int = NEAR) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every other row for rows whose id is divisible by `step`.

    Vectors that are null or hold a null or a non-finite component are left out, as are rows with a null id.
    Shorter vectors count as padded with zeros. With fewer than k candidates all are returned; an
    empty table gives no rows. Rows that repeat an id and vector count once. An id that occurs with
    different vectors is several rows of that id, none of which is a candidate of its own id. Extra
    columns are left out.
    """
    vectors = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    index = build(vectors, pivots, annulus)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = queries_of(vectors, index, F.col("id") % step == 0)
    first = shared.materialize(wanted(asked.withColumn("bound", F.lit(None).cast("long")), index, k, 0, near))
    found = shared.materialize(ranked(scan(meetings(first, index), index, k), k))
    bounds = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "bound")
    rest = shared.materialize(wanted(asked.join(bounds, "id", "left").select("id", "v", "bound"), index, k, near, None))
    more = scan(meetings(rest, index), index, k)
    return ranked(found.select("query_id", "vec_id", "score").unionByName(more), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(shared.table(spark, sf_dir, "embeddings"))
