"""Byte-pair encoding held against the library, on made-up texts and on the Spark side."""

import hashlib
import random
import struct

import pytest

from murmuration.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(bpe.NAME)
BITS = (
    ["a", "b", "th", "e", "in", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<", "|", "é", "é", "Σ", "ς", "İ", "ß", "ﬁ", " ", "\n", "\x1c", "\x1f", "\x85", "　", "1", "٣", "½", "中", "文", "😀"]
    + ["👩‍👩", "!", "...", "_", "A", "Z", "́", "한", "ᄒ", "ᅡ", "\x00", "Ᲊ", "՘", "\t", "aaaaaaa", "hahaha", "xxxx", "ÿ", "×", "µ"]
)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.load(PATH))


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)


def test_equal_to_the_library(library, vocabulary):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 3000 + " x" * 300, "é" * 999, "", "   ", "the the The THE,the"]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        assert (ids, vocabulary.decode(ids)) == expected(library, text), repr(text)


def test_every_pair_of_a_sample_of_tokens_follows_as_the_library_merges(library, vocabulary):
    rng = random.Random(2)
    inner = [n for n, i in vocabulary.starts.items() if i >= 0 and n.isascii() and n.isalpha() and n.islower()]
    last = [n for n, i in vocabulary.finals.items() if n.isascii() and n.isalpha() and n.islower()]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(last)
        got = library.encode(a + b, add_special_tokens=False).ids
        assert vocabulary.follows(vocabulary.starts[a], vocabulary.finals[b]) == (got == [vocabulary.starts[a], vocabulary.finals[b]])


def test_shared_prefixes_are_encoded_once(vocabulary):
    at_end, token, _ = vocabulary.trie(["abcdefgh", "abcdefgi", "abcdefghk", "abcd"])
    assert len(at_end) == 4 and len(token) == 1 + 8 + 4  # the root, a to h, and one end for each word


def test_memory_is_emptied_without_a_trace(monkeypatch, vocabulary):
    texts = [f"word{i} two{i % 7} Three" for i in range(50)]
    whole = vocabulary.encode(texts)
    monkeypatch.setattr(bpe, "CACHED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    assert [vocabulary.encode([t])[0] for t in texts] == whole


def test_long_texts_in_segments(vocabulary):
    text = " ".join(f"w{i}  é́{i}" for i in range(200)) + "x" * 300
    cut = list(bpe.segments(text, 64))
    assert "".join(cut) == text and len(cut) > 20
    assert b"".join(vocabulary.encode([c])[0] for c in cut) == vocabulary.encode([text])[0]


def test_other_files_are_an_error():
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


def test_rows(spark, library, tmp_path):
    rows = [(1, "The cat's hat"), (2, None), (3, ""), (4, " \n"), (1, "The cat's hat"), (None, "x"), (5, "long " * 3000), (6, "<|endoftext|>a")]
    schema = "doc_id long, text string, ids string, n_tokens int"
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in sorted(got, key=key)] == [
        (i, len(expected(library, t or "")[0]) // 4, expected(library, t or "")[1]) for i, t in sorted(rows, key=key)
    ]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids, decoded = expected(library, t or "")
        assert digest[i] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
