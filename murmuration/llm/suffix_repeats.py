"""Exact substring removal: repeats of `length` bytes by an enhanced suffix array.

Only places that can be part of a repeat reach a suffix array:

1. Anchors. The anchor of a window of `length` bytes is its k-gram of least hash, so equal windows
   have equal anchors. Consecutive windows of one anchor make a run; a run's context is the
   bytes that its windows cover. Of equal runs that a task reads together all but the first are
   repeats. The rest meet by anchor. An anchor that occurs once can't be in a
   repeat. Of runs with equal contexts all but the first are repeats as a whole.
2. Suffix arrays. Where one anchor has several contexts, the first run of each sends its
   bytes. The suffixes of these contexts are sorted, neighbours give common-prefix lengths, and a
   stack scan yields the tree of common-prefix intervals. An interval of `length` or more whose
   occurrences differ in the byte before them is a maximal repeat, with all its occurrences.
3. Every occurrence of a repeat but the first of all is removed.

Documents are UTF-8 bytes, ordered by doc_id; positions are bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared
from murmuration.llm.ngram_join import runs
from murmuration.llm.shared import U64

LENGTH, GRAM = 100, 32
PER_PART = 8 << 20  # bytes of text whose anchors make one part
PIECE = 1 << 18  # bytes hashed at once
ENTRIES = "part int, anchor binary, context binary, doc binary, per_doc binary, start binary, width binary"
MARKS = "bucket int, kind int, doc binary, start binary, width binary, family binary"
CONTEXTS = "part int, doc binary, start binary, width binary, body binary"


def window_runs(joined: bytes, valid: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows - 1, anchor hash, context hash) of the runs, piece by piece.

    `valid` tells which positions begin a window. A run that is cut by the end of a piece is two
    runs of other contexts, which the suffix arrays compare.
    """
    whole, span = np.frombuffer(joined, np.uint8), length - gram + 1
    low = U64((1 << 24) - 1)
    for at in range(0, len(whole), PIECE):
        raw = whole[at : at + PIECE + length - 1]
        ok = valid[at : at + PIECE][: max(0, len(raw) - length + 1)]
        if not ok.any():
            continue
        sums = shared.prefix_hashes(raw)
        _, inverse = shared.powers(len(raw))
        n = len(raw) - gram + 1
        grams = shared.mix((sums[gram:] - sums[:n]) * inverse[:n])
        key = (grams & ~low) | np.arange(n, dtype=U64)
        least, reach = key, 1
        while 2 * reach <= span:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        begin = np.flatnonzero(ok)
        anchor = (least[begin] & low).astype(np.int64)
        new = np.ones(len(begin), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)
        head = np.flatnonzero(new)
        first, a = begin[head], anchor[head]
        last = begin[np.append(head[1:], len(begin)) - 1]
        context = (sums[last + length] - sums[first]) * inverse[first]
        context = shared.mix(context + shared.mix(((a - first) * 4096 + (last - first)).astype(U64)))
        yield first + at, last - first, grams[a], context


def starts_of_windows(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts joined, where windows begin, and where each text begins."""
    joined = b"\0".join(texts)
    valid = np.ones(len(joined) + 1, bool)
    begins, at = np.zeros(len(texts), np.int64), 0
    for i, t in enumerate(texts):
        begins[i] = at
        valid[max(at, at + len(t) - length + 1) : at + len(t) + 1] = False
        at += len(t) + 1
    return joined, valid, begins


def anchors(docs: DataFrame, parts: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of every document, packed by the part that their anchor falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "text"):
            joined, valid, begins = starts_of_windows(shared.texts_of(b), length)
            ids = np.array(b.column("doc").to_pylist(), np.int64)
            got = list(window_runs(joined, valid, length, gram))
            if not got:
                continue
            first, width, anchor, context = (np.concatenate(x) for x in zip(*got))
            owner = np.searchsorted(begins, first, side="right") - 1
            # of equal runs of a batch only the first can be the first of all; the others are repeats and go where their documents do
            by = np.argsort(context, kind="stable")
            same = context[by][1:] == context[by][:-1]
            several = by[np.append(False, same) | np.append(same, False)]
            several = several[np.lexsort((first[several] - begins[owner[several]], ids[owner[several]], context[several]))]
            keys = context[several], ids[owner[several]], first[several] - begins[owner[several]]
            again, twice = np.zeros(len(context), bool), np.zeros(len(context), bool)
            later = np.ones(len(several), bool)
            later[runs(keys[0])] = False
            again[several] = later
            repeated = np.ones(len(several), bool)
            repeated[runs(*keys)] = False
            twice[several] = repeated  # repeated rows are one document
            if twice.any():
                first, width, anchor, context, owner, again = (x[~twice] for x in (first, width, anchor, context, owner, again))
            part = np.where(again, ids[owner] % parts, (anchor % U64(parts)).astype(np.int64))
            order = np.lexsort((again, part)) if again.any() else np.argsort(part.astype(np.uint16 if parts < 65536 else np.uint32), kind="stable")
            first, width, anchor, context, part, owner, again = (x[order] for x in (first, width, anchor, context, part, owner, again))
            cell = (anchor >> U64(32)).astype(np.uint32)
            begin = runs(part, again, owner)
            per_doc = np.diff(np.append(begin, len(part))).astype(np.uint32)
            heads = runs(part[begin], again[begin])
            rows = []
            for r0, r1 in zip(heads, np.append(heads[1:], len(begin))):
                t0, t1 = begin[r0], begin[r1] if r1 < len(begin) else len(part)
                s = slice(t0, t1)
                none = again[t0]  # a repeat's anchor and context are no longer needed
                rows.append(dict(part=int(part[t0]), **shared.pack(
                    anchor=cell[s][: 0 if none else None], context=context[s][: 0 if none else None], doc=ids[owner[begin[r0:r1]]], per_doc=per_doc[r0:r1],
                    start=(first[s] - begins[owner[s]]).astype(np.uint32), width=width[s].astype(np.uint8))))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in ("anchor", "context", "doc", "per_doc", "start", "width")]))

    return docs.select("doc", "text").mapInArrow(run, ENTRIES)


def packed_marks(bucket, kind, doc, start, width, family) -> list[dict]:
    """Rows of MARKS, one for each bucket."""
    order = np.lexsort((start, doc, bucket))
    bucket, doc, start, width, family = bucket[order], doc[order], start[order], width[order], family[order]
    heads = runs(bucket)
    return [
        dict(bucket=int(bucket[a]), kind=kind, **shared.pack(doc=doc[a:b], start=start[a:b], width=width[a:b], family=family[a:b]))
        for a, b in zip(heads, np.append(heads[1:], len(bucket)))
    ]


MARK_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("doc", "start", "width", "family")])


def meet(entries: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Marks: removed runs (kind 0: start and bytes), and runs whose context a suffix array has to see (kind 1)."""

    def run(whole: pa.Table) -> pa.Table:
        part = whole.column("part")[0].as_py()
        done = pa.compute.equal(pa.compute.binary_length(whole.column("anchor")), 0)
        rows, t = [], whole.filter(done)
        if t.num_rows:
            d = np.repeat(shared.unpack(t, "doc", np.int64), shared.unpack(t, "per_doc", np.uint32))
            s, w = shared.unpack(t, "start", np.uint32).astype(np.int64), shared.unpack(t, "width", np.uint8).astype(np.int64)
            rows += packed_marks(d % parts, 0, d, s, w + length, np.zeros(len(d), np.int64))
        t = whole.filter(pa.compute.invert(done))
        doc = np.repeat(shared.unpack(t, "doc", np.int64), shared.unpack(t, "per_doc", np.uint32))
        anchor, context = shared.unpack(t, "anchor", np.uint32), shared.unpack(t, "context", U64)
        start, width = shared.unpack(t, "start", np.uint32), shared.unpack(t, "width", np.uint8)
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        often = np.zeros(len(order), bool)
        often[1:] |= same
        often[:-1] |= same
        order = order[often]
        order = order[np.lexsort((start[order], doc[order], context[order], anchor[order]))]
        anchor, context, doc, start, width = anchor[order], context[order], doc[order], start[order], width[order]
        once = runs(anchor, context, doc, start)  # repeated rows are one document
        anchor, context, doc, start, width = anchor[once], context[once], doc[once], start[once], width[once]
        first = np.zeros(len(anchor), bool)
        first[runs(anchor, context)] = True
        begin = runs(anchor)
        classes = np.add.reduceat(first.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        several = np.repeat(classes > 1, np.diff(np.append(begin, len(anchor))))
        for kind, chosen in ((0, ~first), (1, first & several)):
            d, s, w = doc[chosen], start[chosen].astype(np.int64), width[chosen].astype(np.int64)
            family = anchor[chosen].astype(np.int64) * parts + part
            rows += packed_marks(d % parts, kind, d, s, w + (length if kind == 0 else 0), family)
        return pa.Table.from_pylist(rows, schema=MARK_SCHEMA)

    return entries.groupBy("part").applyInArrow(run, MARKS)


def union_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each document, touching ones joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    heads = np.zeros(len(doc), bool)
    heads[runs(doc)] = True
    lift = (np.cumsum(heads) - 1) * (int(end.max()) + 2)  # keeps documents apart in one running maximum
    top = np.maximum.accumulate(end + lift)
    new = heads.copy()
    new[1:] |= start[1:] + lift[1:] > top[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], (top - lift)[np.append(at[1:], len(doc)) - 1]


def by_document(marks: DataFrame) -> DataFrame:
    """(doc, spans, wanted): removed spans (start, end) and wanted runs (start, width, family) as int64 triples."""

    def run(t: pa.Table) -> pa.Table:
        parts_ = {0: [], 1: []}
        for kind in (0, 1):
            own = t.filter(pa.compute.equal(t.column("kind"), kind))
            parts_[kind] = [shared.unpack(own, c, np.int64) for c in ("doc", "start", "width", "family")]
        d0, s0, w0, _ = parts_[0]
        d0, s0, e0 = union_spans(d0, s0, s0 + w0)
        d1, s1, w1, f1 = parts_[1]
        order = np.lexsort((s1, d1))
        d1, s1, w1, f1 = d1[order], s1[order], w1[order], f1[order]
        docs = np.unique(np.concatenate([d0, d1]))
        a0, b0 = np.searchsorted(d0, docs), np.searchsorted(d0, docs, side="right")
        a1, b1 = np.searchsorted(d1, docs), np.searchsorted(d1, docs, side="right")
        spans, wanted = np.stack([s0, e0], 1), np.stack([s1, w1, f1], 1)
        return pa.Table.from_arrays([
            pa.array(docs, pa.int64()),
            pa.array([spans[a:b].tobytes() for a, b in zip(a0, b0)], pa.binary()),
            pa.array([wanted[a:b].tobytes() for a, b in zip(a1, b1)], pa.binary()),
        ], names=["doc", "spans", "wanted"])

    return marks.groupBy("bucket").applyInArrow(run, "doc long, spans binary, wanted binary")


def contexts(docs: DataFrame, marks: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """The bytes of the wanted runs, packed by their family's part."""
    wanted = marks.where("octet_length(wanted) > 0").select("doc", "wanted")
    met = docs.select("doc", "text").join(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "text"):
            texts, ids = shared.texts_of(b), b.column("doc").to_pylist()
            docs_, starts, widths, families, bodies = [], [], [], [], []
            for text, i, raw in zip(texts, ids, b.column("wanted").to_pylist()):
                for s, w, f in np.frombuffer(raw, np.int64).reshape(-1, 3).tolist():
                    docs_.append(i)
                    starts.append(s)
                    widths.append(w)
                    families.append(f)
                    bodies.append(text[s : s + w + length])
            part = np.array(families, np.int64) % parts
            order = np.argsort(part, kind="stable")
            part = part[order]
            d, s, w = np.array(docs_, np.int64)[order], np.array(starts, np.int64)[order], np.array(widths, np.int64)[order]
            heads = runs(part)
            rows = [
                dict(part=int(part[x]), body=b"".join(bodies[k] for k in order[x:y]), **shared.pack(doc=d[x:y], start=s[x:y], width=w[x:y].astype(np.uint8)))
                for x, y in zip(heads, np.append(heads[1:], len(part)))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in ("doc", "start", "width", "body")]))

    return met.mapInArrow(run, CONTEXTS)


def suffix_array(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes body[begin:end], and the common-prefix length of each with the one before it.

    Suffixes are short (`end - begin` is bounded by a context), so they are compared as rows of
    big-endian words, padded after their end.
    """
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - begin
    wide = -(-int(size.max()) // 8) * 8
    padded = np.concatenate([body, np.zeros(wide, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = []
    for at in range(0, wide, 8):
        word = view[np.minimum(begin + at, len(padded) - 8)].copy().view(">u8").ravel().astype(U64)
        left = np.clip(size - at, 0, 8)
        cut = np.where(left >= 8, ~U64(0), ~(~U64(0) >> (np.minimum(left, 7).astype(U64) * U64(8))))
        words.append(word & cut)
    order = np.lexsort([size, *words[::-1]])
    common, open_ = np.zeros(n, np.int64), np.ones(n - 1, bool)
    for j, word in enumerate(words):
        w = word[order]
        diff = w[1:] ^ w[:-1]
        hit = open_ & (diff != 0)
        if hit.any():
            x = diff[hit]
            # leading equal bytes of a word, from the highest bit that differs
            top = np.frexp(x.astype(np.float64))[1] - 1
            over = (top < 64) & ((x >> np.minimum(top, 63).astype(U64)) == 0)  # rounded up to the next power of two
            top = top - over
            common[1:][hit] = 8 * j + 7 - top // 8
            open_ &= ~hit
    common[1:][open_] = 8 * len(words)
    common[1:] = np.minimum(common[1:], np.minimum(size[order][1:], size[order][:-1]))
    return order, common


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of `least` or more, children before parents, by a stack scan."""
    out, stack = [], []
    for i, here in enumerate([*common.tolist(), 0]):
        if i == 0:
            continue
        left = i - 1
        while stack and stack[-1][0] > here:
            size, left = stack.pop()
            if size >= least:
                out.append((size, left, i - 1))
        if not stack or stack[-1][0] < here:
            stack.append((here, left))
    return out


def maximal_repeats(body: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray, least: int):
    """(length, members) of the maximal repeats among the suffixes; members index the suffixes.

    `before` is the byte in front of a suffix, or a value of its own (256 and above) at the start of a
    context. An interval whose members all have the same byte before them is not left-diverse: the
    interval of the suffixes one byte to the left has the same occurrences and is longer.
    """
    order, common = suffix_array(body, begin, end)
    front = before[order]
    changes = np.concatenate(([0], np.cumsum((front[1:] != front[:-1]) | (front[1:] >= 256)))) if len(front) else front
    for size, a, b in intervals(common, least):
        if changes[b] != changes[a] or front[a] >= 256:
            yield size, order[a : b + 1]


def repeats(entries: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Marks (kind 0) of every occurrence but the first of the maximal repeats among the contexts of a part."""

    def run(t: pa.Table) -> pa.Table:
        doc, start = shared.unpack(t, "doc", np.int64), shared.unpack(t, "start", np.int64)
        width = shared.unpack(t, "width", np.uint8).astype(np.int64)
        body = shared.unpack(t, "body", np.uint8)
        base = np.concatenate(([0], np.cumsum(width + length)))[:-1]
        once = np.lexsort((start, doc))
        once = once[runs(doc[once], start[once])]
        # every window of every context; those whose bytes are here once can't be in a repeat
        ctx = np.repeat(once, width[once] + 1)
        offset = np.arange(len(ctx)) - np.repeat(np.cumsum(width[once] + 1) - width[once] - 1, width[once] + 1)
        at = base[ctx] + offset
        sums = shared.prefix_hashes(body)
        _, inverse = shared.powers(len(body))
        print_ = (sums[at + length] - sums[at]) * inverse[at]
        by = np.argsort(print_, kind="stable")
        same = print_[by][1:] == print_[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        pick = np.flatnonzero(twice)
        ctx, offset, at = ctx[pick], offset[pick], at[pick]
        # neighbouring windows make one stretch of text; a suffix ends where its stretch does
        new = np.ones(len(at), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(new)
        stretch = np.cumsum(new) - 1
        last = at[np.append(head[1:], len(at)) - 1] + length if len(at) else at
        before = np.where(new, 256 + np.arange(len(at)), body[at - 1] if len(at) else 0)
        end = last[stretch] if len(at) else at
        place = start[ctx] + offset
        gone_d, gone_s, gone_w = [], [], []
        for size, members in maximal_repeats(body, at, end, before, length):
            keep = members[np.lexsort((place[members], doc[ctx[members]]))[1:]]
            gone_d.append(doc[ctx[keep]])
            gone_s.append(place[keep])
            gone_w.append(np.full(len(keep), size, np.int64))
        if not gone_d:
            return MARK_SCHEMA.empty_table()
        d, s, w = np.concatenate(gone_d), np.concatenate(gone_s), np.concatenate(gone_w)
        d, s, e = union_spans(d, s, s + w)
        return pa.Table.from_pylist(packed_marks(d % parts, 0, d, s, e - s, np.zeros(len(d), np.int64)), schema=MARK_SCHEMA)

    return entries.groupBy("part").applyInArrow(run, MARKS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with `doc`, an integer that orders documents as doc_id does and names one text.

    It is the doc_id itself where no doc_id is null or has several rows. Otherwise texts of one
    doc_id are separate documents ordered by their hash, null ids first, and equal rows are one.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("doc", F.col("doc_id").cast("long"))
    key = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    names = key.groupBy("doc_id", "_h").agg(F.count("*").alias("_n")).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_o"), "doc_id", "_h")
    places = shared.materialize(shared.dense_slots(names.withColumn("_all", F.lit(0)), ["_all"], ["_o", "_h"], out="doc").drop("_all", "_o"))
    same = key["doc_id"].eqNullSafe(places["doc_id"]) & (key["_h"] == places["_h"])
    return key.join(places, same).select(*[key[c] for c in docs.columns], places["doc"])


def removed_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, per_part: int = PER_PART) -> DataFrame:
    """(doc, spans): the removed byte spans of the documents that have any."""
    parts = shared.parts_for(rows, "text", per_part)
    first = shared.materialize(by_document(meet(anchors(rows, parts, length, gram), parts, length)))
    more = shared.materialize(by_document(repeats(contexts(rows, first, parts, length), parts, length)))
    both = first.select("doc", "spans").unionByName(more.select("doc", "spans")).where("octet_length(spans) > 0")
    return both.groupBy("doc").agg(F.collect_list("spans").alias("spans"))  # two at most


def spans_in(raw: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """Maximal spans as (start, end), within a text of `size` bytes."""
    if not raw:
        return []
    got = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    _, s, e = union_spans(np.zeros(len(got), np.int64), got[:, 0], got[:, 1])
    return [(a, min(b, size)) for a, b in zip(s.tolist(), e.tolist()) if a < size]


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty. Rows that repeat a document are one document, each with its result;
    different texts under one doc_id are separate documents, ordered by hash; a null doc_id
    comes first. Extra columns are left out; an empty table gives none.
    """
    rows = numbered(docs.select("doc_id", "text"))
    met = rows.join(removed_spans(rows, length), "doc", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = shared.texts_of(b)
            spans = [spans_in(r, len(t)) for r, t in zip(b.column("spans").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                pa.array([len(x) for x in spans], pa.int64()), pa.array([hashlib.sha256(cut_out(t, x)).hexdigest() for t, x in zip(texts, spans)]),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeats cut out of text, and n_chars (if there is one) counted anew.

    A span is narrowed to whole characters. Documents of which nothing is left stay, with an empty text. Null texts stay null. Equal rows of one doc_id are one document
    and are cut alike; different texts of one doc_id, or without any, are documents of their own, in the order of `numbered`. Extra columns go along; an empty table stays empty.
    """
    names = [c if c in ("doc_id", "text", "n_chars") else f"u{i}" for i, c in enumerate(docs.columns)]  # whatever the others are called
    docs, given = docs.toDF(*names), docs.columns
    rows = numbered(docs)
    met = rows.join(removed_spans(rows, length), "doc", "left").select(*names, F.col("spans").alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = shared.texts_of(b), []
            for t, raw in zip(texts, b.column("_spans").to_pylist()):
                whole = []
                for s, e in spans_in(raw, len(t)):
                    while s < e and t[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(t) and t[e] & 0xC0 == 0x80:
                        e -= 1
                    whole.append((s, e))
                out.append(cut_out(t, whole).decode("utf-8", "replace"))
            columns = []
            for c in names:
                old = b.column(c)
                columns.append(pa.array([x if was is not None else None for x, was in zip(out, old.to_pylist())], old.type) if c == "text" else pa.array([len(x) for x in out], old.type) if c == "n_chars" else old)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(run, docs.schema).toDF(*given)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(shared.table(spark, sf_dir, "documents"))
