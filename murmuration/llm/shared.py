"""What several operators share: tables on shared storage, components, dense ranks,
word hashes and the exchange of packed columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

U64 = np.uint64

# ---------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Without one, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("murmuration.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="murmuration-")
        spark.conf.set("murmuration.scratch", found)
    return found


_MADE: list[list[str]] = []  # tables written within the open scopes


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Removes at its end the tables that were written within it, but for those that the frames in `keep` read."""
    _MADE.append([])
    try:
        yield
    finally:
        made = _MADE.pop()
        read = {f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()}
        kept = [p for p in made if any(r.endswith(p.rsplit("/", 1)[1]) for r in read)]
        for path in set(made) - set(kept):
            _delete(spark, path)
        if _MADE:
            _MADE[-1] += kept


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back.

    The shuffles behind the table are no longer needed, so their files are released. A `scratch` scope removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _MADE:
        _MADE[-1].append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """The session setting that queries over texts run with: Arrow batches of at most 32 MB, where the default is 64.

    A batch stands in memory several times over, in the JVM and in the worker. Operators work with any value.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges, as (node, component): the smallest node.

    Alternating large-star and small-star steps; every step is an aggregation with
    map-side combine and a join on the node, which adaptive execution splits for hubs.
    Nodes that have no edge are not returned. Nulls are no nodes; loops are ignored.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = materialize(e)
    while not e.isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        new = materialize(small)
        forget(e)
        e = new
        # Done when every edge leads straight to a node that has no smaller neighbour.
        if e.alias("x").join(e.alias("y"), F.col("x.v") == F.col("y.u")).isEmpty():
            break
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )


# ---------------------------------------------------------------- dense ranks


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the frame has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dense_slots(df: DataFrame, keys: list[str], order: list[str], out: str = "slot") -> DataFrame:
    """Gapless 0-based positions within keys, ordered by `order`; keys aren't null.

    Rows are dealt in ranges of (keys, order, place of reading), cut at sampled quantiles, so sparse, equal and
    null values of the order spread over tasks like any others. The place is written down with the row first, so a task that runs again finds the same
    rows, and sampling doesn't work them out twice. A row's place within its task and one count
    for each key and task give its position.
    """
    tie, at, part, low, n, start = fresh(df, "tie", "at", "part", "low", "n", "start")
    by = [*keys, *order, tie]
    ranged = materialize(df.withColumn(tie, F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialize(ranged.withColumn(at, F.monotonically_increasing_id()).drop(tie)).withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(*keys, part).agg(F.min(at).alias(low), F.count("*").alias(n))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(low)).drop(low, n)
    return placed.join(starts, [*keys, part]).withColumn(out, F.col(start) + F.col(at)).drop(at, part, start)


def salted(left: DataFrame, right: DataFrame, key: str, limit: int = 200_000) -> DataFrame:
    """Inner join on a key of which `left` may have very many rows: beyond `limit` they are dealt over copies of the right rows.

    Counts are combined before they are shuffled; at most one row in `limit` is a hot key.
    """
    salts, salt = fresh(left.join(right, key), "salts", "salt")
    hot = left.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("int").alias(salts)).where(F.col(salts) > 1)
    many = F.coalesce(F.col(salts), F.lit(1))
    dealt = left.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*left.columns), many).cast("int")).drop(salts)
    copied = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(salts)
    return dealt.join(copied, [key, salt]).drop(salt)


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 18  # bytes hashed at once; a worker holds some 60 times as much
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("p", ())) <= n:
        size = max(n + 1, PIECE + 1)
        for name, base in (("p", _BASE), ("q", _INVERSE)):
            x = np.full(size, U64(base), U64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=U64)
    return _POWERS["p"], _POWERS["q"]


def let_go() -> None:
    """Frees the powers, 4 MB and more, in a process that has no more words to hash."""
    _POWERS.clear()


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Sums P with hash(codes[s:e]) = (P[e] - P[s]) * inverse**s, modulo 2**64."""
    p, _ = powers(len(codes))
    out = np.empty(len(codes) + 1, U64)
    out[0] = 0
    np.cumsum((codes.astype(U64) + U64(1)) * p[: len(codes)], out=out[1:])
    return out


def words(joined: bytes, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of the bytes; a word has no byte of `gaps`, A-Z count as a-z.

    Works through pieces that end at a space, so memory is bounded by PIECE and the longest word.
    """
    starts, ends, hashes = [], [], []
    at, size = 0, len(joined)
    whole = np.frombuffer(joined, np.uint8)
    while at < size:
        to = min(size, at + PIECE)
        while to < size and not gaps[whole[to]]:
            step = np.flatnonzero(gaps[whole[to : to + PIECE]])
            to = to + int(step[0]) if len(step) else min(size, to + PIECE)
        raw = whole[at:to]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~gaps[raw]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = prefix_hashes(_LOWER[raw])
        _, inverse = powers(len(raw))
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `limit` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)).astype(np.int64)
        group = np.cumsum(size + 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; a null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes within its text) of every word; first word and count of each text."""
    joined = b"\n".join(texts)
    s, e, h = words(joined)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    first = np.searchsorted(s, begins)
    count = np.diff(np.append(first, len(s)))
    base = np.repeat(begins, count)
    return h, s - base, e - base, first, count


# ---------------------------------------------------------------- packed columns


def pack(**columns: np.ndarray) -> dict[str, bytes]:
    return {k: v.tobytes() for k, v in columns.items()}


def unpack(table_: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table_.column(name).to_pylist()), dtype)


def parts_for(df: DataFrame, text: str, per_part: int) -> int:
    """How many groups of about `per_part` bytes of text there are: grows with the data, so a group doesn't."""
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return int(max(8, -(-total // per_part)))
