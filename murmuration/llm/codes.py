"""Short codes of vectors: the nearest codebook entry of each part, found by annular norm pruning.

A vector is cut into equal parts, and each part position has a codebook of its own. To find a part's nearest entry the entries
are sorted by norm. The entry whose norm is nearest gives the first best distance; an entry can only be nearer, or as near, if its norm
differs from the part's by no more than that (the triangle inequality), so a binary search finds the annulus to look
at, ends included, and only its entries are evaluated, in whole numbers. A better distance narrows the annulus at once.

Codebooks are refined in rounds over all rows: a round reads the vectors once and adds up, for each entry, its parts. The sums
of a task leave it as one row for each entry, so what is shuffled and what the driver holds grows with the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LONGEST = (1 << 63) - 1
SUMS = "part int, entry int, at int, total decimal(38,0), n long"


class Codebooks(NamedTuple):
    """entries: (parts, entries, width) of longs; `big`: distances may need more than 64 bits."""

    entries: np.ndarray
    big: bool

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(x: np.ndarray, y: np.ndarray, big: bool) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - y
    if not big:
        return np.einsum("ij,ij->i", d, d)
    d = d.astype(object)
    return (d * d).sum(1) if d.shape[1] else np.zeros(len(d), object)


def norms(x: np.ndarray, big: bool) -> np.ndarray:
    return np.sqrt(squares(x, np.zeros_like(x), big).astype(np.float64))


def nearest(x: np.ndarray, entries: np.ndarray, big: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of every row, the lower of equal ones, its squared distance, and how many distances were evaluated.

    The annulus is widened by what rounding of norms can take, so no entry that could be as near is left out.
    """
    n = len(x)
    size = norms(entries, big)
    order = np.argsort(size, kind="stable")
    ranked, size = entries[order], size[order]
    own = norms(x, big)
    room = 1e-9 * (own + (size[-1] if len(size) else 0)) + 1e-6
    right = np.searchsorted(size, own)
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(size) - 1)
    place = np.where(own - size[left] <= size[right] - own, left, right)
    best = squares(x, ranked[place], big)
    index = order[place]
    looked = n

    def annulus(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = np.sqrt(best[rows].astype(np.float64)) + room[rows]
        return np.searchsorted(size, own[rows] - reach), np.searchsorted(size, own[rows] + reach, side="right")

    low, high = annulus(np.arange(n))
    # Outwards from the first entry: the rows whose annulus still holds the entry so many places below or above.
    for step in range(1, len(size)):
        for side in (-step, step):
            at = place + side
            rows = np.flatnonzero((at >= low) & (at < high))
            if not len(rows):
                continue
            looked += len(rows)
            at = at[rows]
            d, i = squares(x[rows], ranked[at], big), order[at]
            won = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            better = rows[won]
            best[better], index[better] = d[won], i[won]
            low[better], high[better] = annulus(better)
    return index, best, looked


def first_entries(rows: DataFrame, dim: int, entries: int, parts: int) -> np.ndarray:
    """The vectors of the smallest ids, cut into parts; a task hands on no more rows than there are entries. Equal ids go by their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int]]] = []
        for b in vectors.pieces(batches):
            x, good = vectors.grid(b, SCALE, dim)
            ids = b.column("id").filter(pa.array(good)).to_pylist()
            limit = held[-1][0] if len(held) == entries else None
            held += [(i, x[k].tolist()) for k, i in enumerate(ids) if i is not None and (limit is None or i <= limit)]
            held = sorted(held)[:entries]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([v for _, v in held], pa.list_(pa.int64()))], names=["id", "v"])

    got = rows.select("id", "v").mapInArrow(run, "id long, v array<long>").orderBy("id", "v").limit(entries).collect()
    return np.array([r.v for r in got], np.int64).reshape(len(got), parts, dim // parts).transpose(1, 0, 2)


def refine(rows: DataFrame, dim: int, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean; an entry without parts stays."""
    entries, big = books
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width), object if big else np.int64)
        count = np.zeros((parts, k), np.int64)
        for b in vectors.pieces(batches):
            x, _ = vectors.grid(b, SCALE, dim)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                index, _, _ = nearest(part, entries[p], big)
                if big:
                    np.add.at(total[p], index, part.astype(object))
                else:  # sums of a piece are whole numbers that doubles hold
                    total[p] += (np.eye(k)[index].T @ part).astype(np.int64)
                count[p] += np.bincount(index, minlength=k)
        for p in range(parts):
            used = np.flatnonzero(count[p])
            at = np.tile(np.arange(width, dtype=np.int32), len(used))
            sums = pa.array([int(v) for v in total[p, used].ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(at), sums, pa.array(np.repeat(count[p, used], width))],
                names=["part", "entry", "at", "total", "n"],
            )

    found = rows.select("v").mapInArrow(run, SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    new = entries.copy()
    for r in found:
        new[r.part, r.entry, r.at] = int(r.total) // r.n
    return Codebooks(new, big)


def fit(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks of a frame (id, v), and the dimensions that vectors are padded to: those of the longest, rounded up to whole parts."""
    seen = vectors.about(rows, SCALE)
    dim = -(-seen.dim // parts) * parts
    books = Codebooks(first_entries(rows, dim, entries, parts), 8 * seen.peak**2 * max(dim, vectors.ROWS) >= LONGEST)
    for _ in range(rounds if books.entries.size else 0):
        books = refine(rows, dim, books)
    return books, dim


def encode(rows: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distances, summed) of a frame (id, v, label)."""
    entries, big = books
    parts, k, width = entries.shape
    digits = np.array([f"{i:02x}" for i in range(k)], object)
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.pieces(batches):
            x, good = vectors.grid(b, SCALE, dim)
            kept = pa.array(good)
            code, error = np.full(len(x), "", object), np.zeros(len(x), object if big else np.int64)
            for p in range(parts if k else 0):
                index, d, _ = nearest(x[:, p * width : (p + 1) * width], entries[p], big)
                code, error = code + digits[index], error + d
            out = pa.array([min(int(e), LONGEST) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(kept), b.column("label").filter(kept), pa.array(code, pa.string()), out], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {label}, code string, error long")


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is not null and holds no null or non-finite component.

    Repeated rows each count and are each coded. Rows with a null id are coded, but no codebook starts with one; where no id is left all codes are empty and
    errors 0. Shorter vectors, and dimensions that aren't whole parts, count as padded with zeros; components beyond 2**53 / 4096 as that. With fewer
    rows than entries there are as many entries as rows. Errors beyond a long are the greatest long. Nulls are one label. Extra columns are left out; an
    empty table gives no rows. The input is read once for each round and three times more: hand in a written table where it is costly.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    books, dim = fit(rows, entries, parts, rounds)
    coded = shared.materialize(encode(rows, books, dim))
    # A struct holds nulls as values that are equal. Counts of labels are few rows or many: adaptive execution chooses the join and splits a hot label.
    keyed = coded.withColumn("key", F.struct("label"))
    total = keyed.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    most = F.lit(LONGEST).cast("decimal(38,0)")
    return keyed.join(total, "key").select(
        F.col("id").alias("vec_id"), "code", "error", F.least("total", most).cast("long").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(shared.table(spark, sf_dir, "embeddings"))
