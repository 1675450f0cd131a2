"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are of documents, so tokens get theirs from them: a token of a toxic document is
labelled toxic if its word or one of its beginnings occurs in far more toxic than clean
documents (log-likelihood ratio over the training documents). The field has two tags and
scores a token by hashed features of its spelling and of its neighbours' tags; training
maximises the likelihood of the labelled tokens. Forward-backward gives every token's
marginal; a document's score comes from the sum and the maximum of its marginals, and
spans are runs of tokens whose marginal reaches one half.

The field is fitted on a bounded sample of labelled rows (`toxic_rows`, `clean_rows`: those
with the smallest hash of their id, of texts up to `longest` bytes). Scoring reads whole texts of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared
from murmuration.llm.shared import U64

BITS = 18
FLOOR = 0.05
TOXIC_ROWS, CLEAN_ROWS, LONGEST = 600, 900, 1 << 16
STEP = 2 << 20  # bytes of texts whose tokens and features are held at once; a longer text comes alone
BLOCK = 1024  # tokens that messages are stepped through one by one
#: Token ends: every ASCII byte that is no letter and no digit.
GAPS = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
HEADS, TAILS = (3, 4, 5, 6), (3, 4)


def tokens(texts: list[bytes]):
    """Byte offsets of every token within its text, first token and count per text, and its features.

    Features are the whole token, its first 3 to 6 bytes and its last 3 and 4, as 64-bit hashes;
    a part that is as long as the token or longer is left out (hash 0).
    """
    joined = b"\n".join(texts)
    s, e, word = shared.words(joined, GAPS)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    first = np.searchsorted(s, begins)
    count = np.diff(np.append(first, len(s)))
    raw = np.frombuffer(joined, np.uint8)
    size = e - s
    features = [word]
    for from_end, lengths in ((False, HEADS), (True, TAILS)):
        for n in lengths:
            part = np.zeros(len(s), U64)
            long_ = np.flatnonzero(size > n)
            at = (e[long_] - n) if from_end else s[long_]
            h = np.zeros(len(long_), U64)
            for j in range(n):
                h = h * U64(0x100000001B3) + shared._LOWER[raw[at + j]].astype(U64) + U64(1)
            part[long_] = shared.mix(h + U64(1000 * n + from_end)) | U64(1)
            features.append(part)
    base = np.repeat(begins, count)
    return s - base, e - base, first, count, features


def slot(f: np.ndarray) -> np.ndarray:
    return ((f >> U64(20)) & U64((1 << BITS) - 1)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Field:
    """keys and weights: a table of the features that the field knows, by slot, and how much each speaks
    for tag 1 against tag 0; bias: what speaks for tag 1 in every token; moves[a, b]: score of tag b after a;
    scale: intercept and weights of the logistic document score."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    scale: np.ndarray

    def known(self, features: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(token, slot) of the known features, by kind of feature."""
        out = []
        for f in features:
            at = slot(f)
            hit = np.flatnonzero((self.keys[at] == f) & (f != 0))
            out.append((hit, at[hit]))
        return out

    def emissions(self, known: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        for hit, at in known:
            out[hit] += self.weights[at]
        return out

    def score(self, texts: list[bytes]):
        """Score per text, and start, end, first, count and marginals of the tokens."""
        s, e, first, count, features = tokens(texts)
        p, _ = marginals(self.emissions(self.known(features), len(s)), first, count, self.moves, pairs=False)
        return sigmoid(np.hstack([np.ones((len(first), 1)), summary(p, first, count)]) @ self.scale), s, e, first, count, p


def _through(x: np.ndarray, place, alive: np.ndarray, step_of) -> np.ndarray:
    """Products of the steps of every block, as 2 x 2 matrices on (odds, 1); steps go through all blocks at once."""
    out = np.tile(np.eye(2), (int(alive[0]), 1, 1))
    for t in range(len(alive) - 1):
        n = alive[t]
        out[:n] = step_of(x[place(t, n)], t, n) @ out[:n]
        out[:n] /= out[:n].max((1, 2))[:, None, None]
    return out


def marginals(e: np.ndarray, first: np.ndarray, count: np.ndarray, moves: np.ndarray, block: int = BLOCK, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(tag 1) of every token by forward-backward, and, where `pairs` are asked for, P(tag 1 at t and t + 1) sums per pair of tags (2, 2).

    Messages are log-odds of the two tags, one number per block of at most `block` tokens, stepped through all
    blocks at once. Of texts of several blocks, what a block does to a message is a product of matrices, which the
    blocks hand on first. So a text of n tokens takes some 4 * block + 2 * n / block steps, not 2 * n.
    """
    parts = -(-count // block)
    base = np.cumsum(parts) - parts
    text = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(text)) - base[text]
    size = np.minimum(block, count[text] - nth * block)
    order = np.argsort(-size, kind="stable")
    size, text, nth = size[order], text[order], nth[order]
    start = first[text] + nth * block
    most = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(most + 1), side="left")  # blocks longer than t
    before, after = np.zeros(len(size)), np.zeros(len(size))  # messages that reach a block from the left and from the right
    long_ = np.flatnonzero(parts > 1)
    if len(long_):
        (oo, ot), (to, tt) = np.exp(moves)
        x = np.exp(np.clip(e, -300, 300))

        def rightward(x: np.ndarray, t: int, n: int) -> np.ndarray:
            m = np.array([[tt, ot], [to, oo]]) * np.stack([x, np.ones(n)], 1)[:, :, None]
            if t == 0:  # the first token of a text has no move before it
                m[nth[:n] == 0] = np.stack([x, np.zeros(n), np.zeros(n), np.ones(n)], 1).reshape(n, 2, 2)[nth[:n] == 0]
            return m

        right = _through(x, lambda t, n: start[:n] + t, alive, rightward)
        left = _through(x, lambda t, n: start[:n] + size[:n] - 1 - t, alive, lambda x, t, n: np.array([[tt, to], [ot, oo]]) * np.stack([x, np.ones(n)], 1)[:, None, :])
        at = np.empty(len(order), np.int64)
        at[base[text] + nth] = np.arange(len(order))
        for matrices, message, ks in ((right, before, range(int(parts.max()))), (left, after, range(int(parts.max()) - 1, 0, -1))):
            u = np.ones((len(long_), 2))
            for k in ks:
                on = np.flatnonzero(parts[long_] > k)
                i = at[base[long_[on]] + k]
                if matrices is right:
                    message[i] = np.log(u[on, 0]) - np.log(u[on, 1])
                u[on] = (matrices[i] @ u[on][:, :, None])[:, :, 0]
                u[on] /= u[on].max(1)[:, None]
                if matrices is left:
                    message[at[base[long_[on]] + k - 1]] = np.log(u[on, 0]) - np.log(u[on, 1])
    f, b = np.empty_like(e), np.zeros_like(e)
    (oo, ot), (to, tt) = moves
    if most:
        f[start] = e[start] + np.where(nth > 0, np.logaddexp(before + tt, ot) - np.logaddexp(before + to, oo), 0.0)
        b[start + size - 1] = after
    for t in range(1, most):
        at = start[: alive[t]] + t
        a = f[at - 1]
        f[at] = e[at] + np.logaddexp(a + tt, ot) - np.logaddexp(a + to, oo)
    for t in range(most - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        a = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(tt + a, to) - np.logaddexp(ot + a, oo)
    p = sigmoid(f + b)
    pair = np.zeros((2, 2))
    if not pairs:
        return p, pair
    has_next = np.ones(len(e), bool)
    has_next[(first + count - 1)[count > 0]] = False
    at = np.flatnonzero(has_next)
    if len(at):
        # joint log scores relative to each other: f is log-odds before the move, the rest after it
        right_of = e[at + 1] + b[at + 1]
        joint = np.stack([np.zeros(len(at)) + oo, ot + right_of, f[at] + to, f[at] + tt + right_of])
        joint -= joint.max(0)
        np.exp(joint, out=joint)
        joint /= joint.sum(0)
        pair = joint.sum(1).reshape(2, 2)
    return p, pair


def ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of document counts, 0 where the share in toxic documents isn't the greater."""
    k, n = toxic + clean, n_toxic + n_clean
    expect_t, expect_c = k * n_toxic / n, k * n_clean / n
    g = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / expect_t) + clean * np.log(np.maximum(clean, 1e-9) / expect_c))
    return np.where(toxic / max(n_toxic, 1) > 4 * clean / max(n_clean, 1), g, 0)


def marked(features: list[np.ndarray], owner: np.ndarray, toxic: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, documents, ratio) of every kind of feature: how many training documents have it and how much it tells."""
    n_toxic, out = int(toxic.sum()), []
    for f in features:
        keep = np.flatnonzero(f)
        order = np.lexsort((owner[keep], f[keep]))
        v, o = f[keep][order], owner[keep][order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        v, o = v[new], o[new]
        values, at, size = np.unique(v, return_index=True, return_counts=True)
        hits = np.add.reduceat(toxic[o].astype(float), at) if len(at) else np.zeros(0)
        out.append((values, size, ratio(hits, size - hits, n_toxic, len(toxic) - n_toxic)))
    return out


def summary(p: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text: log of 1 + expected toxic tokens, greatest marginal, expected share.

    Marginals under FLOOR are what any token has by chance; a long text has many, so they don't count.
    """
    total = np.concatenate(([0.0], np.cumsum(np.where(p >= FLOOR, p, 0.0))))
    expected = total[first + count] - total[first]
    top = np.zeros(len(first))
    full = np.flatnonzero(count)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[full])
    return np.stack([np.log1p(np.maximum(expected, 0)), top, np.sqrt(np.maximum(expected, 0) / np.maximum(count, 1))], 1)


def fit(texts: list[bytes], toxic: list[bool], rounds: int = 25, rate: float = 0.3, decay: float = 1e-4, window: int = 128, least: float = 20.0, support: int = 3) -> Field:
    """A field for labelled texts; without toxic texts it scores everything near 0.

    A token of a toxic text is labelled 1 if its word or one of its heads has a log-likelihood ratio of
    `least`, or of three quarters of what the strongest has where a small sample reaches no more. The
    field knows the features that labelled tokens have in `support` documents.
    """
    y = np.array(toxic, bool)
    size = 1 << BITS
    field = Field(np.zeros(size, U64), np.zeros(size), -6.0, np.log(np.array([[0.99, 0.01], [0.9, 0.1]])), np.array([-6.0, 0.0, 0.0, 0.0]))
    if not len(y) or not y.any() or y.all():
        return field
    s, _, first, count, features = tokens(texts)
    owner = np.repeat(np.arange(len(y)), count)
    told = marked(features, owner, y)
    bar = min(least, 0.75 * max((r.max() for _, _, r in told[: 1 + len(HEADS)] if len(r)), default=0.0))
    tag = np.zeros(len(s), bool)
    for f, (values, _, r) in zip(features[: 1 + len(HEADS)], told):
        tag |= np.isin(f, values[r >= max(bar, 1e-9)])
    tag &= y[owner]
    for f, (values, docs, r) in zip(features, told):
        have = np.intersect1d(values[(docs >= min(support, len(y))) & (r > 0)], np.unique(f[tag]))
        field.keys[slot(have)] = have
    known = field.known(features)
    del features, told, f, values, docs, r, owner  # what the rounds don't read
    cuts = [(a + i, min(window, c - i)) for a, c in zip(first.tolist(), count.tolist()) for i in range(0, c, window)]
    w_first, w_count = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
    has_next = np.ones(len(tag), bool)
    has_next[w_first + w_count - 1] = False
    at = np.flatnonzero(has_next)
    real = np.bincount(2 * tag[at] + tag[at + 1], minlength=4).reshape(2, 2).astype(float)
    field.moves = np.log((real + 1) / (real + 1).sum(1, keepdims=True))
    seen, seen_b, seen_m = np.full(size, 1e-9), 1e-9, np.full((2, 2), 1e-9)
    scale = 1.0 / max(1, int(tag.sum()))
    for _ in range(rounds):
        p, pair = marginals(field.emissions(known, len(s)), w_first, w_count, field.moves)
        diff = (tag - p) * scale
        g = -decay * field.weights
        for hit, where in known:
            g += np.bincount(where, diff[hit], minlength=size)
        seen += g * g
        field.weights += rate * g / np.sqrt(seen)
        seen_b += diff.sum() ** 2
        field.bias += rate * diff.sum() / np.sqrt(seen_b)
        m = (real - pair) * scale
        seen_m += m * m
        field.moves = field.moves + 0.1 * rate * m / np.sqrt(seen_m)
    p, _ = marginals(field.emissions(known, len(s)), first, count, field.moves, pairs=False)
    x = np.hstack([np.ones((len(y), 1)), summary(p, first, count)])
    w, ridge = np.zeros(4), np.diag([1e-3, 1e-1, 1e-1, 1e-1])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = sigmoid(x @ w)
        h = x.T @ (x * (q * (1 - q) + 1e-6)[:, None]) + ridge
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - q) - ridge @ w), -4, 4)
    field.scale = w
    return field


def sample_labels(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text, toxic) of a bounded number of labelled documents that are not held out: at most toxic_rows and clean_rows, one text each.

    An id with several labels is toxic if one says so; of several texts the least is taken. Texts of more than
    `longest` bytes are left out of the sample, so it holds (toxic_rows + clean_rows) * longest bytes at most.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean_rows))
    # At most toxic_rows + clean_rows ids of a few bytes: small enough to broadcast by construction.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, **sizes: int) -> Field:
    """The field, fitted in one task on the bounded sample: neither its texts nor the arrays of the fit are ever held by the driver, to which the known features come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(b.column("doc_id").to_pylist(), shared.texts_of(b), b.column("toxic").to_pylist()))
        field = fit([t for _, t, _ in rows], [y == 1 for *_, y in rows])
        shared.let_go()
        at = np.flatnonzero(field.keys)
        own = (at, field.keys[at], field.weights[at], np.array([field.bias]), field.moves, field.scale)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in own], names=names)

    names = ["at", "keys", "weights", "bias", "moves", "scale"]
    got = sample_labels(docs, labels, **sizes).repartition(1).mapInArrow(run, ", ".join(f"{n} binary" for n in names)).first()
    if got is None:  # without a sample no task may run
        return fit([], [])
    field = Field(np.zeros(1 << BITS, U64), np.zeros(1 << BITS), float(np.frombuffer(got.bias)[0]), np.frombuffer(got.moves).reshape(2, 2), np.frombuffer(got.scale))
    at = np.frombuffer(got["at"], np.int64)
    field.keys[at], field.weights[at] = np.frombuffer(got["keys"], U64), np.frombuffer(got.weights)
    return field


def tag(docs: DataFrame, field: Field, keep_spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and the byte spans (start, end, marginal) of toxic runs.

    Scores depend on the text alone; a null or empty text gets the score of no tokens. A null doc_id counts
    as held out. Repeated rows are each scored, extra columns are left out, an empty table gives none.
    """
    shown = docs.sparkSession.sparkContext.broadcast(field)  # 2 ** BITS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fld = shown.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for b in shared.small_batches(batches, "text", STEP):
            score, s, e, first, count, p = fld.score(shared.texts_of(b))
            ids = b.column("doc_id").to_pylist()
            held = [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else True for i in ids]
            spans: list[list] = [[] for _ in ids]
            if keep_spans:
                hot = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(first + count, hot, side="right")
                for t, o in zip(hot.tolist(), owner.tolist()):
                    if spans[o] and spans[o][-1]["last"] == t - 1:
                        spans[o][-1] |= {"end": int(e[t]), "last": t, "p": max(spans[o][-1]["p"], float(p[t]))}
                    else:
                        spans[o].append({"start": int(s[t]), "end": int(e[t]), "p": float(p[t]), "last": t})
            plain = [[{k: x[k] for k in ("start", "end", "p")} for x in row] for row in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(plain, span)],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the score accepts, all columns; the scoring joins nothing, texts are scored where they are read.

    Null and empty texts have the score of no tokens. Each row is scored by its own text, so repeated rows and rows with a null doc_id are
    judged alike; extra columns go along, an empty table stays empty. Labels of documents that aren't there teach nothing.
    """
    field = train(docs, labels)
    shown = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fld = shown.value
        for b in shared.small_batches(batches, "text", STEP):
            score = fld.score(shared.texts_of(b))[0]
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return tag(docs, train(docs, shared.table(spark, sf_dir, "labels")))
