"""Best-fit packing into sequences of several permitted lengths.

Best fit, decreasing: pieces go from long to short, each into the open bin with the least
space that holds it. If none does, a new bin is opened with the permitted length whose cost
(its length and a fixed cost for each sequence) is least for what it is going to hold: the
pieces at hand and, in the space left, the shorter pieces that are still to come. At the end each
bin is downsized to the smallest permitted length that holds its contents.

Pieces of one length are alike, so the decisions are made on the histogram of lengths, at
most `max(sizes)` numbers whatever the data, and come out as ranges: the r-th piece of a length
goes to a bin that follows from r. Ranking the pieces and looking their range up is all that the
rows need, so the packing is that of one global best fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared

SIZES = (512, 1024, 2048, 4096)
OVERHEAD = 32


def word_count(text: str = "text") -> Column:
    """Words without white space; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bins_of(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[list]:
    """Groups of equal bins, [first bin, bins, opened size, used, contents], where contents are (length, first rank, pieces per bin, start).

    Bin for bin as if each piece were placed alone: bins are opened together only as long as as many pieces
    are left as the longest bin holds, since the cost of opening one doesn't change before.
    """
    sizes = tuple(sorted(sizes))
    left = dict(histogram)  # pieces still to place
    tokens_below = 0
    below: dict[int, int] = {}
    for n in sorted(left):
        below[n] = tokens_below  # tokens in pieces shorter than n
        tokens_below += n * left[n]
    lengths = sorted(left)
    # an open group: [first bin, bins, size, used, contents]; contents: (length, rank, per bin, start)
    by_space: dict[int, list[list]] = defaultdict(list)
    spaces: list[int] = []
    done: list[list] = []
    bins = 0

    def put(group: list) -> None:
        space = group[2] - group[3]
        if group[1] <= 0:
            return
        if space == 0:
            done.append(group)
            return
        if not by_space[space]:
            insort(spaces, space)
        by_space[space].append(group)

    def fill(group: list, n: int, rank: int, count: int) -> int:
        """Puts up to `count` pieces of length n into the bins of a group, bin after bin; returns how many."""
        first, many, size, used, contents = group
        each = (size - used) // n
        full = min(many, count // each)
        rest = min(count - full * each, each) if full < many else 0
        cut = lambda k: [(m, r + k * p, p, s) for m, r, p, s in contents]
        if full:
            put([first, full, size, used + each * n, [*contents, (n, rank, each, used)]])
        if rest:
            put([first + full, 1, size, used + rest * n, [*cut(full), (n, rank + full * each, rest, used)]])
        gone = full + bool(rest)
        put([first + gone, many - gone, size, used, cut(gone)])
        return full * each + rest

    def cheapest(n: int, count: int) -> int:
        def cost(size: int) -> tuple[float, int]:
            own = min(size // n, count) * n
            space = size - own
            shorter = lengths[: bisect_left(lengths, min(n, space + 1))]
            more = min(space, below[shorter[-1]] + shorter[-1] * left[shorter[-1]]) if shorter else 0
            # what a bin will be downsized to, if it isn't filled
            ends = next(s for s in sizes if s >= own + more)
            return (ends + overhead) / (own + more), -size

        return min((s for s in sizes if s >= n), key=cost)

    for n in reversed(lengths):
        count, rank = left[n], 0
        while count:
            at = bisect_left(spaces, n)
            if at < len(spaces):
                space = spaces[at]
                group = by_space[space].pop()
                if not by_space[space]:
                    spaces.pop(at)
            else:
                size = cheapest(n, count)
                many = max(0, count - sizes[-1] // n) // (size // n) + 1
                group = [bins, many, size, 0, []]
                bins += many
            placed = fill(group, n, rank, count)
            rank += placed
            count -= placed
        left[n] = 0
    return [*done, *(g for gs in by_space.values() for g in gs)]


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[tuple[int, ...]]:
    """(length, first rank, pieces, first bin, pieces per bin, start in bin, bin size) for ranges of equal pieces; bins downsized."""
    sizes, out = tuple(sorted(sizes)), []
    for first, many, _, used, contents in bins_of(histogram, sizes, overhead):
        size = next(s for s in sizes if s >= used)
        out += [(n, rank, many * each, first, each, start, size) for n, rank, each, start in contents]
    return out


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, from_token, n_tokens, bin_id, bin_size, start for every piece.

    A document of more than max(sizes) tokens is cut into pieces of that length and a rest. Rows without
    tokens (null or empty text) are one piece of 0 tokens in no bin: bin_id, bin_size and start are
    null. A null doc_id is packed like others. Repeated rows are packed each; extra columns are left out.
    """
    spark, top = docs.sparkSession, max(sizes)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (tokens if tokens is not None else word_count()).alias("_n"))
    pieces = counted.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("_n") / top) - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("from_token"), F.least(F.lit(top), F.col("_n") - F.col("piece") * top).cast("long").alias("n_tokens"))
    pieces = shared.materialize(pieces)
    # at most max(sizes) lengths, each with a number
    histogram = {r.n_tokens: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    names = ["n_tokens", "_rank0", "_pieces", "_bin0", "_each", "_start", "bin_size"]
    ranges = spark.createDataFrame(pd.DataFrame(plan(histogram, sizes, overhead), columns=names, dtype="int64"), ", ".join(f"{n} long" for n in names))
    ranked = shared.dense_slots(pieces, ["n_tokens"], ["doc_id", "piece"], out="_r")
    r = ranges.withColumnRenamed("n_tokens", "_n")
    # The plan's rows are bounded by the lengths and sizes, not by the data.
    met = ranked.join(F.broadcast(r), (ranked["n_tokens"] == r["_n"]) & (F.col("_r") >= F.col("_rank0")) & (F.col("_r") < F.col("_rank0") + F.col("_pieces")), "left")
    nth = F.col("_r") - F.col("_rank0")
    return met.select(
        "doc_id", "piece", "from_token", "n_tokens", (F.col("_bin0") + F.floor(nth / F.col("_each"))).cast("long").alias("bin_id"), "bin_size",
        (F.col("_start") + (nth % F.col("_each")) * F.col("n_tokens")).cast("long").alias("start"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
