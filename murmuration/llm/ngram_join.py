"""Near duplicates: an exact Jaccard self-join of word-shingle sets by set relations.

1. Index. Every distinct set (documents with equal sets are one set) sends its shingles to
   the part of the index that their hash falls in. A part finds the shingles that occur in
   two sets or more, ranks them by how many sets have them, and sends them back. A set with
   less than the threshold's share of such shingles can't be similar to any other, exactly.
2. Lists. The other sets are listed under the rarest shingles of their own: if two sets are
   similar, they share one of these. An entry has the set's size and the shingle's position.
3. Derived answers. In every list one set leads. A set is compared with the one leader that
   it meets most; if they are similar, the set is at home with that leader, at a known
   distance. Further rounds do the same between sets of different components, with other
   leaders, as long as links turn up: each has at most one comparison for each set.
4. What is left are lists of several components. Jaccard distance obeys the triangle
   inequality, so the answers of a leader decide most of those of its members: lists are
   reduced to blocks of a home each, blocks are skipped by their sizes and positions or if they
   are one component already, and of homes whose leaders aren't similar only those members are
   compared that are closer than threshold plus both distances to their leaders.

Only connected components are asked for, so links inside a component needn't be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from murmuration.llm import shared
from murmuration.llm.shared import U64

WIDTH = 5
PER_PART = 16 << 20  # bytes of text whose shingles make one part of the index
WEIGHTS = [U64(pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) | 1) for i in range(64)]
META = "doc_id long, n_shingles long, set long"
LISTS = "part int, sets binary, sizes binary, counts binary, low binary, high binary"
SHARED = "bucket int, sets binary, sizes binary, counts binary, tokens binary"


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of every text, and a hash of each whole set (0 for none)."""
    h, _, _, first, count = shared.document_words(texts)
    rolled = np.zeros(max(0, len(h) - width + 1), U64)
    for j in range(width):
        rolled += h[j : j + len(rolled)] * WEIGHTS[j]
    rolled = shared.mix(rolled)
    sets, names = [], np.zeros(len(texts), U64)
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        if n >= width:
            own = np.unique(rolled[a : a + n - width + 1])
        elif n:
            own = shared.mix((h[a : a + n] * np.array(WEIGHTS[8 : 8 + n])).sum(keepdims=True) + U64(n))
        else:
            own = rolled[:0]
        sets.append(own)
        if n:
            names[i] = shared.mix(shared.mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + U64(len(own)))[0] >> U64(1) or U64(1)
    return sets, names


def documents_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and the set's hash (null without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "text"):
            sets, names = shingle_sets(shared.texts_of(b), width)
            ids = [int(x) or None for x in names]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "n_shingles", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, META)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def send(docs: DataFrame, parts: int, width: int = WIDTH) -> DataFrame:
    """The shingles of the sets, packed by part of the index: runs of one set, 48 bits for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "text"):
            sets, names = shingle_sets(shared.texts_of(b), width)
            names, at = np.unique(names, return_index=True)
            keep = at[names > 0]
            if not len(keep):
                continue
            names = names[names > 0]
            sizes = np.array([len(sets[i]) for i in keep])
            token = np.concatenate([sets[i] for i in keep])
            owner = np.repeat(np.arange(len(keep)), sizes)
            part = (token % U64(parts)).astype(np.uint16 if parts < 65536 else np.uint32)
            order = np.argsort(part, kind="stable")
            token, owner, part = token[order], owner[order], part[order].astype(np.int64)
            begin = runs(part, owner)
            length = np.diff(np.append(begin, len(token))).astype(np.uint32)
            o = owner[begin]
            cell = token >> U64(16)
            low, high = (cell & U64(0xFFFFFFFF)).astype(np.uint32), (cell >> U64(32)).astype(np.uint16)
            heads = runs(part[begin])
            rows = []
            for r0, r1 in zip(heads, np.append(heads[1:], len(begin))):
                t0, t1 = begin[r0], begin[r1] if r1 < len(begin) else len(token)
                rows.append(dict(part=int(part[begin[r0]]), **shared.pack(sets=names[o[r0:r1]], sizes=sizes[o[r0:r1]].astype(np.uint32), counts=length[r0:r1], low=low[t0:t1], high=high[t0:t1])))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in ("sets", "sizes", "counts", "low", "high")]))

    return docs.select("text").mapInArrow(run, LISTS)


def give_back(lists: DataFrame, parts: int) -> DataFrame:
    """Each part's shingles of two sets or more, packed by bucket of sets.

    A token has the rank of its number of sets in its top bits, so tokens sort from rare to common.
    """

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        counts = shared.unpack(t, "counts", np.uint32)
        sets = np.repeat(shared.unpack(t, "sets", U64), counts)
        sizes = np.repeat(shared.unpack(t, "sizes", np.uint32), counts)
        cell = shared.unpack(t, "high", np.uint16).astype(U64) << U64(32) | shared.unpack(t, "low", np.uint32)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        same = cell[1:] == cell[:-1]
        often = np.zeros(len(cell), bool)
        often[1:] |= same
        often[:-1] |= same
        order, cell = order[often], cell[often]
        sets, sizes = sets[order], sizes[order]
        order = np.lexsort((sets, cell))
        cell, sets, sizes = cell[order], sets[order], sizes[order]
        once = runs(cell, sets)  # copies of a set send the same shingles
        cell, sets, sizes = cell[once], sets[once], sizes[once]
        begin = runs(cell)
        df = np.diff(np.append(begin, len(cell)))
        rank = np.minimum(63, 1.5 * np.log2(np.maximum(df, 1))).astype(U64)
        rank, df = np.repeat(rank, df), np.repeat(df, df)
        token = rank << U64(57) | ((cell * U64(parts) + U64(part)) & U64((1 << 57) - 1))
        keep = df >= 2
        token, sets, sizes = token[keep], sets[keep], sizes[keep]
        bucket = sets % U64(parts)
        order = np.lexsort((sets, bucket))
        token, sets, sizes, bucket = token[order], sets[order], sizes[order], bucket[order]
        begin = runs(sets)
        length = np.diff(np.append(begin, len(sets))).astype(np.uint32)
        heads = runs(bucket[begin])
        rows = []
        for r0, r1 in zip(heads, np.append(heads[1:], len(begin))):
            t0, t1 = begin[r0], begin[r1] if r1 < len(begin) else len(token)
            rows.append(dict(bucket=int(bucket[t0]), **shared.pack(sets=sets[begin[r0:r1]], sizes=sizes[begin[r0:r1]], counts=length[r0:r1], tokens=token[t0:t1])))
        return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("sets", "sizes", "counts", "tokens")]))

    return lists.groupBy("part").applyInArrow(run, SHARED)


def possible(back: DataFrame, percent: int) -> DataFrame:
    """(set, n, tokens): the sets with enough shared shingles, these sorted from rare to common."""

    def run(t: pa.Table) -> pa.Table:
        counts = shared.unpack(t, "counts", np.uint32)
        sets, sizes = np.repeat(shared.unpack(t, "sets", U64), counts), np.repeat(shared.unpack(t, "sizes", np.uint32), counts)
        token = shared.unpack(t, "tokens", U64)
        order = np.lexsort((token, sets))
        sets, sizes, token = sets[order], sizes[order], token[order]
        begin = runs(sets)
        size = np.diff(np.append(begin, len(sets)))
        good = 100 * size >= percent * sizes[begin].astype(np.int64) if len(begin) else np.zeros(0, bool)
        keep = np.repeat(good, size)
        offsets = np.concatenate(([0], np.cumsum(size[good]))).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[keep].astype(np.int64)))
        return pa.Table.from_arrays([pa.array(sets[begin][good].astype(np.int64)), pa.array(sizes[begin][good].astype(np.int32)), tokens], names=["set", "n", "tokens"])

    return back.groupBy("bucket").applyInArrow(run, "set long, n int, tokens array<long>")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) of every pair: exact overlap of the two sets."""
    a = sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    met = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("t_a", "t_b"))).drop("t_a", "t_b")
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return met.select("a", "b", (1 - F.col("both") / union).alias("distance"), (100 * F.col("both") >= percent * union).alias("linked"))


def fits(percent: int) -> str:
    """Whether two entries or blocks of a list leave room for a link: sizes, shared shingles and positions."""
    return (
        f"100 * least(x.n1, y.n1) >= {percent} * greatest(x.n0, y.n0) "
        f"and {100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n0 + y.n0)"
    )


def entries(known: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """The lists: a row for every set and each of the rarest shingles that it is listed under, or those of `lists`."""
    own = known.select("set", "n", "s", "home", "distance", "comp", *(["head"] if lists is None else []))
    rows = own.select("*", F.posexplode("head").alias("pos", "token")).drop("head") if lists is None else own.join(lists, "set")
    return rows.withColumns({"rest": F.col("s") - F.col("pos"), "n0": F.col("n"), "n1": F.col("n")})


def mixed(rows: DataFrame) -> DataFrame:
    """Lists of more than one component; the others have nothing left to find."""
    return rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")


def merged(known: DataFrame, links: DataFrame, jumps: int = 2) -> DataFrame:
    """The sets with components joined by links: each component goes to the least that it links with, and on from there.

    A few jumps needn't reach the end of a chain. Components only tell what need not be compared, so
    two names for one are harmless; the last step names them once and for all.
    """
    to = links.groupBy(F.greatest("comp_a", "comp_b").alias("u")).agg(F.min(F.least("comp_a", "comp_b")).alias("v"))
    for _ in range(jumps):
        to = to.alias("x").join(to.alias("y"), F.col("x.v") == F.col("y.u"), "left").select("x.u", F.coalesce("y.v", "x.v").alias("v"))
    joined = known.join(to, known["comp"] == to["u"], "left")
    return shared.materialize(joined.withColumn("comp", F.coalesce("v", "comp")).drop("u", "v"))


def lead_round(known: DataFrame, lists: DataFrame | None, sets: DataFrame, percent: int, nth: int, tries: int = 4) -> DataFrame:
    """(a, b, comp_a, comp_b, distance, linked): each set against the leaders of other components that it meets most.

    The leader of a list is its set of least hash, another one in every round; in the first the least set.
    """
    rows = entries(known, lists)
    order = F.col("set") if nth == 0 else F.xxhash64("set", F.lit(nth))
    lead = rows.groupBy("token").agg(F.min(F.struct(order.alias("o"), "set", "comp", "n0", "n1", "rest")).alias("y"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    met = rows.alias("x").join(lead.select("token", "y"), "token").where(f"x.comp != y.comp and {fits(percent)}")
    met = met.groupBy("set", F.col("y.set").alias("lead")).agg(F.count("*").alias("times"), F.first("comp").alias("comp_a"), F.first("y.comp").alias("comp_b"))
    # the first round gives each set its home; later ones try a few leaders each, so that components meet soon
    most = F.row_number().over(W.partitionBy("set").orderBy(F.desc("times"), "lead"))
    best = met.withColumn("_k", most).where(F.col("_k") <= (1 if nth == 0 else tries))
    pairs = shared.materialize(best.select(F.col("set").alias("a"), F.col("lead").alias("b"), "comp_a", "comp_b"))
    return shared.materialize(compare(pairs.select("a", "b"), sets, percent).join(pairs, ["a", "b"]))


def set_components(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(set, comp) of every set that has a link."""
    far = 1 - percent / 100
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("tokens"))
    known = sets.select(
        "set", "n", F.size("tokens").alias("s"), F.slice("tokens", 1, F.greatest(prefix.cast("int"), F.lit(1))).alias("head"),
        F.col("set").alias("home"), F.lit(0.0).alias("distance"), F.col("set").alias("comp"),
    )
    total, nth, links, lists = sets.count(), 0, [], None
    while True:
        near = lead_round(known, lists, sets, percent, nth).where("linked")
        links.append(near.select("a", "b"))
        if nth == 0:  # homes: one leader each
            home = near.select(F.col("a").alias("set"), F.col("b").alias("_home"), F.col("distance").alias("_d"))
            known = known.join(home, "set", "left").withColumns({"home": F.coalesce("_home", "home"), "distance": F.coalesce("_d", "distance")}).drop("_home", "_d")
        known = merged(known, near)
        if nth == 0:  # most lists are one component by now and stay so
            rows = entries(known)
            lists = shared.materialize(rows.join(mixed(rows), "token", "left_semi").select("set", "pos", "token"))
        nth += 1
        if near.count() * 100 <= total:  # few links turn up: what is left is compared below, all of it
            break

    rows = entries(known, lists)
    blocks = (
        rows.join(mixed(rows), "token", "left_semi")
        .groupBy("token", "home").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("rest").alias("rest"), F.max("distance").alias("r"), F.min("comp").alias("comp"))
    )
    leaders = (
        blocks.alias("x").join(blocks.alias("y"), F.expr(f"x.token = y.token and x.home < y.home and x.comp != y.comp and {fits(percent)}"))
        .groupBy(F.col("x.home").alias("a"), F.col("y.home").alias("b"))
        .agg(F.max("x.r").alias("r_a"), F.max("y.r").alias("r_b"), F.first("x.comp").alias("comp_a"), F.first("y.comp").alias("comp_b"))
    )
    leaders = shared.materialize(leaders)
    tried = shared.materialize(compare(leaders.select("a", "b"), sets, percent).join(leaders, ["a", "b"]))
    links.append(tried.where("linked").select("a", "b"))
    known = merged(known, tried.where("linked"))

    # Members of homes whose leaders are neither similar nor far enough apart to rule a link out.
    unsure = tried.where(f"not linked and r_a + r_b > 0 and distance <= {far} + r_a + r_b + 1e-9").select(F.col("a").alias("home_a"), F.col("b").alias("home_b"), F.col("distance").alias("apart"), "r_b")
    member = known.select("set", "n", "s", "head", "home", "distance", "comp")
    met = (
        unsure.join(member.alias("x"), F.expr(f"home_a = x.home and apart <= {far} + x.distance + r_b + 1e-9"))
        .join(member.alias("y"), F.expr(
            f"home_b = y.home and x.comp != y.comp and x.distance + y.distance > 0 and apart <= {far} + x.distance + y.distance + 1e-9 "
            f"and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {100 + percent} * least(x.s, y.s) >= {percent} * (x.n + y.n) and arrays_overlap(x.head, y.head)"))
    )
    opened = shared.materialize(met.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")))
    links.append(shared.materialize(compare(opened, sets, percent).where("linked").select("a", "b")))
    comps = shared.components(reduce(DataFrame.unionByName, links))
    return shared.materialize(comps.select(F.col("node").alias("set"), F.col("component").alias("comp")))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH, per_part: int = PER_PART) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A null or empty text, or one without words, has an empty set and is alone. A null doc_id is
    never a component's name: such rows are linked, but alone their component_id is null.
    Repeated rows are each returned; different texts under one doc_id count as linked with
    each other. Extra columns are left out; an empty table gives none. Sets are compared by
    64-bit shingle hashes and named by a 63-bit hash of the whole set.
    """
    parts = shared.parts_for(docs, "text", per_part)
    named = shared.materialize(documents_sets(docs, width))
    sets = shared.materialize(possible(give_back(send(docs, parts, width), parts), percent))
    comps = set_components(sets, percent)
    placed = named.join(comps, "set", "left").withColumn("_of", F.coalesce("comp", "set")).select("doc_id", "n_shingles", "set", "_of")
    rows = shared.materialize(placed)
    ends = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("_of").alias("a"), F.max("_of").alias("z")).where("a < z")
    one_id = shared.materialize(rows.join(ends, "doc_id").where("_of != a").select("a", F.col("_of").alias("b")))
    if not one_id.isEmpty():
        joins = shared.components(one_id)
        rows = rows.join(joins, rows["_of"] == joins["node"], "left").withColumn("_of", F.coalesce("component", "_of")).drop("node", "component")
    first = rows.where("_of is not null").groupBy("_of").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(first, "_of", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component, all columns.

    Rows with a null doc_id stay, as do texts without words. Rows that repeat a doc_id stay or go together. Extra columns go along; an empty table stays empty.
    """
    found = near_duplicates(docs, percent)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
