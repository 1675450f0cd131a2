"""Vectors of a batch as rows of whole numbers, and what is known of a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = float(1 << 53)  # whole numbers are held to this, either way
ROWS = 1 << 12  # rows of a batch handled at once


class About(NamedTuple):
    rows: int
    dim: int
    peak: int  # the greatest absolute component


def grid(batch: pa.RecordBatch, scale: int, dim: int | None = None, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the batch's vectors without nulls and non-finite components as longs, padded with zeros, and which rows they are of."""
    lists = batch.column(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.bincount(owner, ~np.isfinite(values), minlength=len(size)) > 0
    good = ~bad & np.asarray(lists.is_valid())
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(values * scale), -MOST, MOST)
    x = np.zeros((len(size), dim if dim is not None else int(size[good].max(initial=0))), np.int64)
    at = good[owner]
    x[owner[at], (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))[at]] = whole[at].astype(np.int64)
    return x[good], good


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def about(rows: DataFrame, scale: int) -> About:
    """How many vectors take part, of how many dimensions the longest is, and the greatest component; of a frame with a column v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dim = peak = 0
        for b in pieces(batches):
            x, _ = grid(b, scale)
            n, dim, peak = n + len(x), max(dim, x.shape[1]), max(peak, int(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_pylist([dict(n=n, dim=dim, peak=peak)])

    got = rows.select("v").mapInArrow(run, "n long, dim long, peak long").agg(F.sum("n"), F.max("dim"), F.max("peak")).first()
    return About(*(x or 0 for x in got))
