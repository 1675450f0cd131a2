"""Byte-pair encoding and decoding by a trie of the distinct words.

A word's encoding ends in one token, its last-token state, and what stands before that token is the
encoding of a shorter prefix: an encoding is right if each two neighbouring tokens are, so the token to add is the
suffix whose merges keep apart from the last token of the prefix before it. The distinct words of a batch are inserted into a trie and
the states go down it depth first: what words share in front is encoded once. The last symbol of a word
carries the word's end, so it is an edge of its own.

Works with the vocabularies of the kind BPE with word ends: white space separates words and is dropped, every byte has a symbol, and each merge
makes a token of its own from what earlier merges made. Any other file is an error.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from murmuration.llm import shared

NAME = "word_bpe_49k.json"
SEGMENT = 1 << 19  # characters of one text handled at once
BATCH = 1 << 22  # bytes of text whose words share a trie
CACHED = 1 << 18  # spaced strings whose ids a worker keeps
CACHED_CHARS = 1 << 22
PAIRS = 1 << 19  # judged pairs of tokens that it keeps
FOREVER = 1 << 60
#: What str.split takes for white space, and the vocabulary doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Letters that every version of Unicode reads alike, and the symbols of their two bytes.
LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
KIND = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


def _byte_symbols() -> list[str]:
    """The symbol of each byte: printable characters stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


BYTES = _byte_symbols()
SYMBOLS = {c: "".join(BYTES[b] for b in chr(c).encode()) for c in range(192, 256)}


class Tokens:
    """The tokens of one file by id: all that decoding needs."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        steps = lambda part, key: [x["type"] for x in (spec[part] or {}).get(key, [])]
        found = (steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers"))
        if model["type"] != "BPE" or found != KIND or spec["decoder"] or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("no BPE with word ends")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to stand for exactly their characters")
        ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = np.full(max([*ids.values(), *self.added.values()]) + 1, "", object)
        for name, i in (ids | self.added).items():
            names[i] = name
        self.names = names
        self._prepare(model, content)

    def _prepare(self, model: dict, content: str) -> None:
        pass

    def decode(self, ids: bytes) -> str:
        """The tokens with one space between them: the file names no decoder. An id that it lacks has no token."""
        found = np.frombuffer(ids, "<u4")
        return " ".join(self.names[found[found < len(self.names)]].tolist())


class Vocabulary(Tokens):
    """Tokens and merges of one file, and what is remembered about words between batches."""

    def _prepare(self, model: dict, content: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(content)
        # Cases and classes of rare letters differ between versions of Unicode, so the file's own reading of them is asked.
        self.normal, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.stops = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._merges(model["merges"])
        self._ok: dict[int, bool] = {}
        self.forget()

    def _merges(self, merges: list) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        born = {}
        for r, merge in enumerate(merges):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            if made in self.parts or any(x in self.parts and born[x] >= r for x in (left, right)):
                raise ValueError(f"merge {r} doesn't make a token of its own")
            self.rank[left, right] = r
            self.parts[made] = (left, right, r)
            born[made] = r
        if any(x not in born and x in self.parts for pair in self.rank for x in pair):
            raise ValueError("a merge uses what a later one makes")
        whole: dict[int, bool] = {}
        for made, (left, right, r) in self.parts.items():  # in the order of merges, so both parts are known
            whole[made] = whole.get(left, True) and whole.get(right, True) and self._apart(left, right, r)
        dead = {i for i, good in whole.items() if not good}
        # Tokens that the encoding of their own characters can give, within words and at their end. What only begins one has -1.
        self.starts, self.finals = {}, {}
        for name, i in self.ids.items():
            if i not in dead:
                bare = name.removesuffix(self.end)
                for k in range(1, len(bare)):
                    self.starts.setdefault(bare[:k], -1)
                (self.starts if bare == name else self.finals)[bare] = i

    def _spine(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token, each with the merge that ends it."""
        out = [(token, until)]
        while token in self.parts:
            *both, until = self.parts[token]
            token = both[side]
            out.append((token, until))
        return out

    def _apart(self, left: int, right: int, until: int = FOREVER) -> bool:
        """Whether no merge crosses the border of two tokens: none comes while both of its pieces still stand at the border.

        Of equal pairs the first one merges, so a pair across the border is late where the left token's last pair is the same.
        """
        inner = self._spine(right, 0, until)
        for x, ends in self._spine(left, 1, until):
            for y, stops in inner:
                r = self.rank.get((x, y))
                if r is not None and r < ends and r <= stops:
                    return False
        return True

    def follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self._ok.get(key)
        if ok is None:
            if len(self._ok) >= PAIRS:
                self._ok.clear()
            ok = self._ok[key] = self._apart(left, right)
        return ok

    # ------------------------------------------------------------ words

    def trie(self, words: Iterable[str]) -> tuple[dict[str, int], list[int], list[int]]:
        """The node where every word, given in symbols, ends; the last token of each node and the node before that token (0 is the root).

        Sorted, the words enter the trie in the order of a walk that goes depth first, so a node's state is found as soon as it is there: its last
        token and the node before that token. A word finds the nodes of what it shares with its predecessor on the path.
        """
        token, before = [-1], [0]
        path, reach = [0], [0]  # the nodes from the root, and the longest end of each prefix that begins a token
        starts, ends, follows, known = self.starts, self.finals, self.follows, self._ok
        at_end: dict[str, int] = {}
        last = ""
        for word in sorted(words):
            n = len(word)
            same, most = 0, min(n, len(last)) - 1
            while same < most and word[same] == last[same]:
                same += 1
            del path[same + 1 :], reach[same + 1 :]
            for i in range(same + 1, n):
                k = reach[-1] + 1
                while (t := starts.get(word[i - k : i])) is None:
                    k -= 1
                    if not k:
                        raise ValueError(f"no token ends {word[:i]!r}")
                reach.append(k)
                while t < 0 or (start := path[i - k]) and not (known.get(token[start] << 32 | t) or follows(token[start], t)):
                    k -= 1
                    t = starts.get(word[i - k : i], -1) if k else self._none(word)
                path.append(len(token))
                token.append(t)
                before.append(start)
            k = reach[-1] + 1
            while (t := ends.get(word[n - k :], -1)) < 0 or (start := path[n - k]) and not (known.get(token[start] << 32 | t) or follows(token[start], t)):
                k -= 1
                if not k:
                    self._none(word)
            at_end[word] = len(token)
            token.append(t)
            before.append(start)
            last = word
        return at_end, token, before

    def _none(self, word: str) -> int:
        raise ValueError(f"no encoding of {word[:80]!r}")

    def words_of(self, spaced: str) -> str | list[str | int]:
        """The words, as symbols, of a string without white space: one alone, or a list; an added token is its id."""
        if spaced.isascii():
            if spaced.isalpha():
                return spaced.lower()
        elif LATIN.fullmatch(spaced):
            return spaced.lower().translate(SYMBOLS)
        if self.stops and len(cut := self.stops.split(spaced)) > 1:
            return [w for x in cut if x for w in ([self.added[x]] if x in self.added else self._words(x))]
        return self._words(spaced)

    def _words(self, spaced: str) -> list[str]:
        if spaced.isascii() and spaced.isprintable():
            return PLAIN.findall(spaced.lower())
        return [w for w, _ in self.pieces(self.normal(spaced))]

    # ------------------------------------------------------------ texts

    def forget(self) -> None:
        """Empties the memory of spaced strings; what comes out doesn't depend on it."""
        self._code: dict[str, int] = {}
        self._flat, self._start, self._chars = array("I"), array("Q", [0]), 0

    def _learn(self, strings: set[str]) -> None:
        split = list(map(self.words_of, strings))
        at_end, token, before = self.trie({w for words in split for w in ((words,) if isinstance(words, str) else words) if isinstance(w, str)})
        flat, start, code = self._flat, self._start, self._code
        for s, words in zip(strings, split):
            for w in (words,) if isinstance(words, str) else words:
                if isinstance(w, int):
                    flat.append(w)
                    continue
                node = at_end[w]
                ids = [token[node]]
                while node := before[node]:
                    ids.append(token[node])
                ids.reverse()
                flat.extend(ids)
            code[s] = len(start) - 1
            start.append(len(flat))
        self._chars += sum(map(len, strings))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers."""
        split = [SPACE.split(t) if SEPARATORS.search(t) else t.split() for t in texts]
        if len(self._code) > CACHED or self._chars > CACHED_CHARS:
            self.forget()
        code = self._code
        new = {s for part in split for s in part if s not in code}
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        start = np.frombuffer(self._start, np.uint64).astype(np.int64)
        size = start[codes + 1] - start[codes]
        flat = np.frombuffer(self._flat, np.uint32) if len(self._flat) else np.zeros(0, np.uint32)
        ends = np.cumsum(size)
        all_ids = flat[np.repeat(start[codes] - (ends - size), size) + np.arange(int(size.sum()))].astype("<u4")
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [all_ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """The text in stretches of about `limit` characters that end before white space."""
    at = 0
    while len(text) - at > limit:
        found = SPACE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_KNOWN: dict[tuple[type, int], Tokens] = {}  # the last file of a worker


def _known(kind: type[Tokens], content: str) -> Tokens:
    key = kind, hash(content)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = kind(content)
    return _KNOWN[key]


def encode(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: str | None = None) -> DataFrame:
    """keys, n_tokens and ids (little-endian unsigned 32-bit integers, packed) of every row; with `decoded` also a column of that name, the ids decoded again.

    The driver reads the vocabulary file at `path` and sends its few megabytes along. A null or empty text has no ids,
    repeated rows are each encoded, columns that aren't named are left out, an empty table gives none. One scan, no shuffle; a worker
    keeps the words of one batch and a bounded number of spaced strings. Added tokens in a text are read as tokens, as the library does.
    """
    content = docs.sparkSession.sparkContext.broadcast(load(path))
    kept = [docs.schema[k] for k in keys]
    rows = docs.select(*keys, F.col(text).cast("string").alias(shared.fresh(docs.select(*keys), "text")[0]))
    schema = StructType([*kept, StructField("n_tokens", LongType()), StructField("ids", BinaryType()), *([StructField(decoded, StringType())] if decoded else [])])
    name, names = rows.columns[-1], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _known(Vocabulary, content.value)
        for batch in shared.small_batches(batches, name, BATCH):
            texts = [t or "" for t in batch.column(name).to_pylist()]
            if len(texts) == 1:
                ids = [b"".join(vocabulary.encode([s])[0] for s in segments(texts[0]))]
            else:
                ids = vocabulary.encode(texts)
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            back = [pa.array(map(vocabulary.decode, ids), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n, pa.array(ids, pa.binary()), *back], names=names)

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with the decoded text of its packed ids in place of them; null ids decode to an empty text."""
    content = tokens.sparkSession.sparkContext.broadcast(load(path))
    others = [c for c in tokens.columns if c != ids]
    schema = StructType([*[tokens.schema[c] for c in others], StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _known(Tokens, content.value)
        for batch in shared.small_batches(batches, ids, BATCH // 2):
            texts = [vocabulary.decode(x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, out])

    return tokens.select(*others, ids).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME)
    tokens = encode(shared.table(spark, sf_dir, "documents"), path, decoded="decoded")
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
