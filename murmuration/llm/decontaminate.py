"""Benchmark decontamination by spaced seeds.

A seed is a mask over `SPAN` neighbouring words: only the words at its marked places are
hashed, so a word that was replaced at an unmarked place doesn't hide a match. Documents and
benchmark items meet by (mask, hash). Around every hit the words of both are laid over each
other at the hit's offset: a document is contaminated by an item if some stretch of at least
`least` words (or of the whole item, if that is shorter, but never under `SPAN`) has no more than
one differing word in `every`, begins and ends with equal words.

Words are runs without white space, A-Z as a-z, with ASCII punctuation taken off both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared
from murmuration.llm.shared import U64

#: Each mask marks 5 or 6 of 8 words. Together they hit every stretch that the rule accepts: with at most one inner word in five replaced, wherever, some
#: 8 words of it have all differences at unmarked places (test_masks_hit_every_permitted_stretch goes through all patterns of 8 to 30 words).
MASKS = ((0, 1, 2, 5, 6, 7), (0, 1, 3, 4, 6, 7), (0, 2, 3, 4, 5, 7), (2, 3, 4, 5, 6, 7), (0, 1, 2, 3, 4, 5), (0, 2, 4, 6, 7))
SPAN = 8
LEAST, EVERY = 13, 5
FILTER_BITS, MOST_BITS = 22, 28  # a bitmap of 512 KB to 32 MB
PROBES = (0, 21, 42)  # shifts at which a seed's slots are read
_C = [U64(pow(0xD1342543DE82EF95, 2 * i + 1, 1 << 64) | 1) for i in range(SPAN)]
_PLAIN = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, first word and count of each text; words without letter or digit are left out."""
    joined = b"\n".join(texts)
    s, e, _ = shared.words(joined)
    raw = np.frombuffer(joined, np.uint8)
    plain = np.concatenate(([0], np.flatnonzero(_PLAIN[raw]), [len(raw)])) if len(raw) else np.zeros(2, np.int64)
    a = plain[np.minimum(np.searchsorted(plain[1:-1], s) + 1, len(plain) - 1)]
    z = plain[np.searchsorted(plain[1:-1], e)] + 1
    has = a < e
    s, e = a[has], z[has]
    out = np.zeros(len(s), U64)
    for p in range(0, len(s), 1 << 18):
        x, y = s[p : p + (1 << 18)], e[p : p + (1 << 18)]
        part = shared._LOWER[raw[x[0] : y[-1]]]
        sums = shared.prefix_hashes(part)
        _, inverse = shared.powers(len(part))
        out[p : p + len(x)] = shared.mix((sums[y - x[0]] - sums[x - x[0]]) * inverse[x - x[0]] + (y - x).astype(U64))
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64) if texts else np.zeros(0, np.int64)
    first = np.searchsorted(s, begins)
    return out, first, np.diff(np.append(first, len(s)))


def seeds(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word index, owner, seed hash) for each mask, at every place where the whole span is inside the text."""
    if len(h) < SPAN:
        return
    owner = np.repeat(np.arange(len(first)), count)
    inside = np.flatnonzero(owner[SPAN - 1 :] == owner[: len(owner) - SPAN + 1])
    for m, mask in enumerate(MASKS):
        x = np.zeros(len(h) - SPAN + 1, U64)
        for j in mask:
            x += h[j : j + len(x)] * _C[j]
        yield inside, owner[inside], shared.mix(x[inside] + U64(m + 1))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words): the word hashes of every benchmark item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "text", 1 << 20):
            h, first, count = word_hashes(shared.texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([h[a : a + n].tobytes() for a, n in zip(first, count)], pa.binary())], names=["item_id", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, words binary")


def item_seeds(known: DataFrame) -> DataFrame:
    """(seed, item_id, place) of every seed of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "words", 1 << 20):
            own = [np.frombuffer(x, U64) for x in b.column("words").to_pylist()]
            count = np.array([len(x) for x in own], np.int64)
            h, first = np.concatenate(own), np.cumsum(count) - count
            ids = np.array(b.column("item_id").to_pylist(), np.int64)
            for at, owner, seed in seeds(h, first, count):
                yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int64)), pa.array(ids[owner]), pa.array(at - first[owner])], names=["seed", "item_id", "place"])

    return known.mapInArrow(run, "seed long, item_id long, place long")


def passes_for(seeds: int) -> tuple[int, int]:
    """(bits, passes): a bitmap of which the benchmark's seeds fill an eighth at most, in as many passes over the documents as that takes."""
    bits = min(MOST_BITS, max(FILTER_BITS, (8 * len(PROBES) * max(1, seeds) - 1).bit_length()))
    return bits, -(-8 * len(PROBES) * seeds // (1 << bits)) or 1


def bitmap(found: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Which hash slots the seeds fill, three a seed, as 2 ** bits bits. Tasks fill pieces of 32 KB, so the driver gets one row for each."""
    size = 1 << min(18, bits)
    slots = found.select(F.explode(F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND((1 << bits) - 1) for s in PROBES])).alias("slot"))

    def fill(t: pa.Table) -> pa.Table:
        slot = np.asarray(t.column("slot"))
        have = np.zeros(size, np.uint8)
        have[slot % size] = 1
        return pa.Table.from_pydict({"piece": [int(slot[0]) // size], "have": [np.packbits(have, bitorder="little").tobytes()]})

    pieces = slots.distinct().withColumn("piece", F.floor(F.col("slot") / size)).groupBy("piece").applyInArrow(fill, "piece long, have binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.collect():
        out[r.piece * size // 8 : (r.piece + 1) * size // 8] = np.frombuffer(r.have, np.uint8)
    return out.view(U64)


def maybe(have: np.ndarray, seed: np.ndarray, bits: int, turn: tuple[int, int] = (0, 1)) -> np.ndarray:
    """Indexes of the pass's seeds whose three slots are filled."""
    hit = np.arange(len(seed)) if turn[1] == 1 else np.flatnonzero((seed >> U64(1)) % U64(turn[1]) == turn[0])
    for s in PROBES:
        low = (seed[hit] >> U64(s)) & U64((1 << bits) - 1)
        hit = hit[((have[(low >> U64(6)).astype(np.int64)] >> (low & U64(63))) & U64(1)).astype(bool)]
    return hit


def document_hits(docs: DataFrame, filled, reach: int, bits: int = FILTER_BITS, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """(doc_id, lo, around, seeds, places): the documents' seeds that may be the benchmark's, and the words around all of them from place lo.

    `turn` is (pass, passes): of several passes each looks at the seeds that are its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = filled.value
        for b in shared.small_batches(batches, "text"):
            h, first, count = word_hashes(shared.texts_of(b))
            ids = b.column("doc_id").to_pylist()
            found = [(at[hit], owner[hit], seed[hit]) for at, owner, seed in seeds(h, first, count) if len(hit := maybe(have, seed, bits, turn))]
            if not found:
                continue
            at, owner, seed = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((at, owner))
            at, owner, seed = at[order], owner[order], seed[order]
            cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
            own = owner[cuts[:-1]]
            lo = np.maximum(first[own], at[cuts[:-1]] - reach)
            hi = np.minimum(first[own] + count[own], at[cuts[1:] - 1] + SPAN + reach)
            offsets, whole = pa.array(cuts.astype(np.int32)), first[owner]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[o] for o in own], pa.int64()), pa.array((lo - first[own]).astype(np.int64)), pa.array([h[a:z].tobytes() for a, z in zip(lo, hi)], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(seed.astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array((at - whole).astype(np.int64))),
            ], names=["doc_id", "lo", "around", "seeds", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, lo long, around binary, seeds array<long>, places array<long>")


def best_stretch(same: np.ndarray, least: int, every: int) -> tuple[int, int]:
    """The longest stretch, as (begin, end), of at least `least` places with at most one differing in `every`; (0, 0) if none.

    It begins and ends with an equal place. Over places the sum of 1 for an equal and 1 - every for a
    differing one must be 0 or more, so a stretch is a pair of prefix sums in order.
    """
    n = len(same)
    if n < least:
        return 0, 0
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, 1 - every))))
    begins = np.flatnonzero(same)
    ends = begins + 1
    best = (0, 0)
    low = total[begins]
    # begins with a sum lower than all before them are the only ones worth trying, ends from the far side
    keep = np.concatenate(([True], low[1:] < np.minimum.accumulate(low)[:-1])) if len(low) else np.zeros(0, bool)
    for i in begins[keep]:
        far = ends[(ends >= i + least) & (total[ends] >= total[i])]
        if len(far) and far[-1] - i > best[1] - best[0]:
            best = (int(i), int(far[-1]))
    return best


def overlaps(docs: DataFrame, items: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(doc_id, item_id, begin, end, item_begin, words, equal): verified overlaps, the longest of each document and item.

    begin and end count the document's words. Items shorter than a seed's span, nulls and empty texts
    match nothing. Repeated items give a row each under their item_id; repeated documents one row. Every
    overlap that the rule accepts is found: the masks cover all its patterns of replaced words.
    """
    known = shared.materialize(item_words(items))
    found = shared.materialize(item_seeds(known))
    widest = known.agg(F.max(F.octet_length("words"))).first()[0] or 0
    bits, passes = passes_for(found.count())
    own = F.shiftrightunsigned("seed", 1) % passes
    hits = None
    for turn in range(passes):
        filled = docs.sparkSession.sparkContext.broadcast(bitmap(found if passes == 1 else found.where(own == turn), bits))
        more = document_hits(docs, filled, int(widest) // 8, bits, (turn, passes))
        hits = more if hits is None else hits.unionByName(more)
    hits = shared.materialize(hits.withColumn("row", F.monotonically_increasing_id()))
    # names and places meet by seed; the words join only what is left: one look at each diagonal of a document and an item
    spots = hits.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    met = shared.salted(spots, found, "seed").groupBy("row", "item_id", (F.col("at") - F.col("place")).alias("shift")).agg(F.min_by(F.struct("at", "place"), "at").alias("m"))
    once = met.select("row", "item_id", "m.*").join(hits.select("row", "doc_id", "lo", "around"), "row").join(known, "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                around, words = np.frombuffer(r["around"], U64), np.frombuffer(r["words"], U64)
                a, w = r["at"] - r["lo"], r["place"]
                back, ahead = min(a, w), min(len(around) - a, len(words) - w)
                same = around[a - back : a + ahead] == words[w - back : w + ahead]
                x, y = best_stretch(same, max(SPAN, min(least, len(words))), every)
                if y:
                    rows.append((r["doc_id"], r["item_id"], r["at"] - back + x, r["at"] - back + y, w - back + x, y - x, int(same[x:y].sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "begin", "end", "item_begin", "words", "equal"])

    names = "doc_id long, item_id long, begin long, end long, item_begin long, words long, equal long"
    tried = once.mapInArrow(run, names)
    best = tried.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("begin", "end", "item_begin", "words", "equal"), F.struct("words", "equal", -F.col("begin"))).alias("o"))
    return best.select("doc_id", "item_id", "o.*")


def report(docs: DataFrame, items: DataFrame, **rule: int) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (of the longest overlap, ties to the smallest), overlap_words of every row.

    Rows with a null doc_id are never contaminated. Repeated rows are each returned; extra columns are left out.
    """
    per_doc = overlaps(docs, items, **rule).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max_by("item_id", F.struct("words", -F.col("item_id"))).alias("item_id"), F.max("words").alias("overlap_words")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(per_doc, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "overlap_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, **rule: int) -> DataFrame:
    """The documents without a verified overlap, all columns.

    Null and empty texts and rows with a null doc_id stay. A doc_id with an overlap in one of its rows goes with all of them; repeated rows go or stay together. No document
    or no item: all stay. Extra columns go along, whatever they are called but for a second doc_id or text.
    """
    bad = shared.materialize(overlaps(docs, items, **rule).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
