"""Each operator on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from murmuration.llm import decontaminate, html, ngram_join, packing, sharding, shared, suffix_repeats, topk, toxicity, urlfilter, warc

DOCS = "doc_id long, text string"


def text_of(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---------------------------------------------------------------- shared


def test_components_on_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_slots_across_blocks(spark):
    rows = [(k, i) for k in (1, 2) for i in range(0, 90, 3)] + [(1, 3), (1, None)]
    got = shared.dense_slots(spark.createDataFrame(rows, "k int, i long").repartition(4), ["k"], ["i"]).collect()
    for k in (1, 2):
        own = sorted(got, key=lambda r: (r.k, r.slot))
        own = [r for r in own if r.k == k]
        assert [r.slot for r in own] == list(range(len(own)))
    assert [r.i for r in sorted((r for r in got if r.k == 2), key=lambda r: r.slot)] == list(range(0, 90, 3))


def test_dense_slots_of_sparse_equal_and_null_ids(spark):
    """A third of the rows has one id, another none, the rest lies far apart: no task gets many more rows than others."""
    rng = random.Random(1)
    rows = [(1, 7, "x") for _ in range(4000)] + [(1, None, "x") for _ in range(4000)] + [(1, rng.randrange(-(1 << 62), 1 << 62), "x") for _ in range(4000)]
    got = shared.dense_slots(spark.createDataFrame(rows, "k int, i long, at string").repartition(8), ["k"], ["i"])
    assert got.columns == ["k", "i", "at", "slot"]
    own = sorted(got.collect(), key=lambda r: r.slot)
    assert [r.slot for r in own] == list(range(len(rows)))
    assert [r.i for r in own] == sorted((r[1] for r in rows), key=lambda i: (i is not None, i or 0))
    ranged = spark.createDataFrame(rows, "k int, i long, at string").repartition(8).withColumn("t", shared.F.monotonically_increasing_id()).repartitionByRange(8, "k", "i", "t")
    assert max(r["count"] for r in ranged.groupBy(shared.F.spark_partition_id()).count().collect()) < 3000


def test_salted_join_of_a_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 500)], "k long, salt long").repartition(4)
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (900, "d")], "k long, salts string")
    got = shared.salted(left, right, "k", limit=100)
    assert got.columns == ["k", "salt", "salts"]
    assert Counter((r.k, r.salts) for r in got.collect()) == {(1, "a"): 3000, (1, "b"): 3000, (2, "c"): 1}


def test_scratch_tables_go(spark):
    with shared.scratch(spark, kept := []):
        lost = shared.materialize(spark.range(3))
        kept.append(shared.materialize(spark.range(4)))
        paths = lost.inputFiles()
    import os

    assert kept[0].count() == 4 and not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_words_in_pieces(monkeypatch):
    rng = random.Random(3)
    raw = " ".join(rng.choice(["Ab", "ab", "é" * rng.randrange(1, 9), "x" * rng.randrange(1, 60)]) for _ in range(400)).encode()
    whole = shared.words(raw)
    monkeypatch.setattr(shared, "PIECE", 64)
    parts = shared.words(raw)
    assert all((a == b).all() for a, b in zip(whole, parts))
    spans = [raw[s:e] for s, e in zip(*whole[:2])]
    assert spans == re.findall(rb"[^\x20\x09-\x0D]+", raw)
    assert len({h for h in whole[2]}) == len({s.lower() for s in spans})


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b &lt; c", "a\nb < c"), ("<script>never closed", ""),
        ("<body><nav>menu</nav><article><h1>T</h1><p>one\n two<br>three</p><aside>x</aside><p>four</p></article><footer>f</footer></body>", "T\none two three\nfour"),
        ("<div class='cookie-notice'>c</div><main><h1>Head</h1><section><p>Some longer text here</p></section><section class='comments'><article class='comment'><p>no</p></article></section></main>", "Head\nSome longer text here"),
        ("<header>site</header><article><header><h1>Own</h1></header><p>body text</p><form><input>q</form></article>", "Own\nbody text"),
        ("<!-- <p>no</p> --><div class=\"ad>\">x</div><p title='a>b'>yes</p>", "yes"),
    ],
)
def test_main_text(source, text):
    assert html.main_text(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article class='post tag-advertising'><p>main text</p></article>", "main text"), ("<article class='hentry category-social'><p>main text</p></article>", "main text"),
        ("<article class='post sponsored'><p>main text</p></article>", "main text"), ("<div class='content has-sidebar'><p>main text</p></div>", "main text"),
        ("<div id='no-sidebar'><p>main text</p></div>", "main text"), ("<div class='article--promoted'><p>main text</p></div>", "main text"),
        ("<section id='social-impact'><p>main text</p></section>", "main text"),
        ("<article class='tag-ads'><p>main text</p><div class='ad-slot-2'>x</div><div class='share-buttons'>x</div><p>and more</p></article>", "main text\nand more"),
        ("<main><p>main text</p><article class='related'>x</article><div class='sidebar left-sidebar'>x</div></main>", "main text\nx"),
        ("<article><p>main text</p><article class='related'>x</article><section id='comments-list'><article class='comment'>x</article></section></article>", "main text"),
        ("<article><p>main text</p></article><div class='related-posts'><article class='related'>x</article></div><div class='site-footer'>x</div>", "main text"),
    ],
)
def test_main_text_under_hyphenated_classes(source, text):
    assert html.main_text(source) == text


def planted_page(rng):
    """(page, blocks of the article): an article among menus, adverts, a sidebar and a footer, in wrappers."""
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    menu = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(n)) + "</ul>"
    blocks = [words(6)]
    body = [f"<h1>{blocks[0]}</h1>"]
    for _ in range(rng.randrange(1, 5)):
        part = []
        if rng.random() < 0.5:
            blocks.append(words(3))
            part.append(f"<h2>{blocks[-1]}</h2>")
        for _ in range(rng.randrange(2, 6)):
            a, b = words(rng.randrange(15, 60)), words(3)
            blocks.append(f"{a} {b}")
            part.append(f"<p>{a} <a href='/x'>{b}</a></p>")
        body.append(f"<section>{''.join(part)}</section>" if rng.random() < 0.5 else "".join(part))
    core = f"<article>{''.join(body)}</article>"
    for _ in range(rng.randrange(3)):
        core = f"<div class='wrap'>{core}</div>"
    page = f"<header class='site'><div>{words(3)}</div>{menu(5)}</header><nav>{menu(8)}</nav><div class='ad'>{words(9)}</div><main>{core}</main><aside><div>{words(3)}</div>{menu(9)}</aside><footer><div>{words(12)}</div>{menu(4)}</footer>"
    return f"<html><head><title>{words(4)}</title></head><body>{page}</body></html>", blocks


def test_density_alone_finds_the_article(spark):
    """With every element that says what it is renamed to div and no class, only density is left."""
    rng, hit, wrong, lost = random.Random(12), 0, 0, 0
    for _ in range(150):
        page, blocks = planted_page(rng)
        bare = re.sub(r" class='[^']*'", lambda m: f" class='z{rng.randrange(99)}'", re.sub(r"<(/?)(?:article|main|nav|header|footer|aside)\b", r"<\1div", page))
        p = html.Page(bare, lists=False)
        got, want = Counter(p.text(p.main()).split("\n")), Counter(blocks)
        hit, wrong, lost = hit + (got & want).total(), wrong + (got - want).total(), lost + (want - got).total()
        assert html.main_text(page).split("\n") == blocks
    assert hit / (hit + wrong) > 0.95 and hit / (hit + lost) > 0.95


def test_densities_against_a_recursion():
    from xml.etree import ElementTree

    def tally(e, in_link=False):
        """Characters, tags, characters in links, links of an element."""
        in_link = in_link or e.tag == "a"
        own = [x for x in [e.text, *(k.tail for k in e)] if x and not x.isspace()]
        parts = [tally(k, in_link) for k in e]
        c = sum(map(len, own)) + sum(p[0] for p in parts)
        return c, sum(p[1] + 1 for p in parts), (sum(map(len, own)) if in_link else 0) + sum(p[2] for p in parts), sum(p[3] + (k.tag == "a") for p, k in zip(parts, e))

    rng = random.Random(3)
    for _ in range(25):
        source, _ = planted_page(rng)
        root = ElementTree.fromstring(re.sub("<head>.*</head>", "", source))
        page = html.Page(source, lists=False)
        got, all_ = page.densities(), tally(root)
        nodes = [n for n in range(len(page.tag)) if not page.out[n]]
        elements = [e for e in root.iter() if e.tag != "html"]
        assert [page.tag[n] for n in nodes if page.tag[n] != "html"] == [e.tag for e in elements]
        for n, e in zip([n for n in nodes if page.tag[n] != "html"], elements):
            c, t, lc, lt = tally(e)
            if e.tag in ("a", "li", "ul"):  # links above an element count for it too
                continue
            base = np.log(c / max(1, c - lc) * lc + all_[2] / max(1, all_[0]) * c + np.e)
            assert got[n] == pytest.approx(c / max(1, t) * np.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / max(1, np.log(base)) if c else 0)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "<div></section>", "<!-- ", "<b>", "</", "<p><a>x", "<script ", "<script>", "<textarea></b", "<li><ul>", "< ", '<b class="ad">'])
def test_pages_take_time_in_proportion(piece):
    import time

    begin = time.process_time()
    html.main_text("<p>text</p>" + piece * ((1 << 19) // len(piece)))
    assert time.process_time() - begin < 6


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (3, "v", "<p>" + "long " * 50_000 + "</p>", "y")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter({(1, 1): 2, (None, 0): 1, (3, 249_999): 1})
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 2


def labelled(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = text_of(rng, rng.randrange(20, 80)).split()
        bad = i % 4 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "scumlike", "idiot", "Idiot,"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_marginals_against_enumeration(block):
    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    first, count = np.array([0, 4, 4]), np.array([4, 0, 5])
    p, _ = toxicity.marginals(e, first, count, moves, block)
    for a, n in zip(first, count):
        score = {}
        for bits in range(1 << n):
            y = [(bits >> i) & 1 for i in range(n)]
            score[tuple(y)] = np.exp(sum(e[a + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(score.values())
        for i in range(n):
            assert abs(p[a + i] - sum(v for y, v in score.items() if y[i]) / z) < 1e-9


def test_marginals_of_long_texts_in_blocks():
    rng = np.random.default_rng(1)
    count = np.array([5000, 3, 0, 1025, 2048, 900])
    first = np.cumsum(count) - count
    e, moves = rng.normal(size=count.sum()) * 8, np.log(np.array([[0.99, 0.01], [0.3, 0.7]]))
    one, blocks = toxicity.marginals(e, first, count, moves, 1 << 20), toxicity.marginals(e, first, count, moves)
    assert np.allclose(one[0], blocks[0], atol=1e-9) and np.allclose(one[1], blocks[1])


def test_training_sample_is_bounded(spark):
    rows = [(1, "a"), (1, "b"), *[(3, "same text")] * 500, (4, "w " * 50_000), (6, None)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.sample_labels(docs(spark, rows), labels).collect()
    assert {(r.doc_id, r.text, r.toxic) for r in got} == {(i, t, y) for i, t, y in [(1, "a", 1), (3, "same text", 0), (6, "", 0)] if zlib.crc32(str(i).encode()) % 5} and len({r.doc_id for r in got}) == len(got)


def test_toxicity_held_out(spark):
    rows = labelled()
    d, lab = docs(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.tag(d, toxicity.train(d, lab)).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    text = rows[0][1].encode()
    assert any(text[s.start : s.end].lower() in (b"idiot", b"scumbag", b"scumlike") for s in got[0].spans)


def test_toxicity_odd_rows(spark):
    rows = labelled()
    field = toxicity.fit([t.encode() for _, t, _ in rows], [y == 1 for *_, y in rows])
    odd = docs(spark, [(None, "idiot idiot idiot scumbag", 1), (1, None, 2), (1, None, 2), (2, "", 3), (4, "w1 " * 60_000, 4)], DOCS + ", score int")
    got = toxicity.tag(odd, field).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.predicted} == {None} and next(r for r in got if r.doc_id is None).held_out
    kept = toxicity.drop_toxic(docs(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.count() == len(rows)  # nothing is known to be toxic
    assert toxicity.tag(docs(spark, []), field).count() == 0


# ---------------------------------------------------------------- 3


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                up[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return Counter((i, len(s), low.get(find(a))) for a, ((i, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates_against_brute_force(spark):
    rng, rows = random.Random(11), []
    for group in range(14):
        base = text_of(rng, rng.randrange(30, 120)).split()
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w[rng.randrange(3) :])))
    line = text_of(rng, 40)
    rows += [(1000 + i, f"{line} {text_of(rng, 12)}") for i in range(30)]  # one passage, little else
    rows += [(2000, "A b c d"), (2001, "a B c d"), (2002, "a b c"), (2003, ""), (2004, None), (2005, "  \t\n"), (None, "a b c"), (None, "alone indeed"), (5, rows[5][1]), (6, "another text under a taken id entirely new")]
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(docs(spark, [(*r, "x") for r in rows], DOCS + ", n_shingles string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    kept = ngram_join.keep_one(docs(spark, [(2, "a b c d e f", "p"), (1, "A b c d e f", "q"), (3, None, "r")], DOCS + ", source string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "source"]


# ---------------------------------------------------------------- 4


def brute_removal(rows, length=100):
    seen, out = set(), Counter()
    order = sorted({(i if i is not None else -1, t or "") for i, t in rows})
    done = {}
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        fresh = []
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
            fresh.append(w)
        done[i, t] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    for i, t in rows:
        out[(i, *done[i if i is not None else -1, t or ""])] += 1
    return out


def test_suffix_repeats_against_brute_force(spark):
    rng, rows = random.Random(2), []
    passages = [text_of(rng, n) for n in (12, 25, 60, 300)]
    for i in range(60):
        parts = [text_of(rng, rng.randrange(1, 60)) for _ in range(3)]
        parts.insert(1, rng.choice(passages)[rng.randrange(40) :])
        rows.append((i, rng.choice([" ", "\n", "é"]).join(parts)))
    rows += [(100, rows[7][1]), (101, "ab" * 400), (102, "a" * 350), (103, "x" * 99), (104, ""), (105, None), (106, rows[3][1] + "é" + rows[3][1]), (3, rows[3][1]), (None, passages[3])]
    rows += [(200 + i, f"{text_of(rng, 2)} {passages[2]} {text_of(rng, 2)}") for i in range(60)] * 2  # one passage in a third of the rows, each row twice
    got = suffix_repeats.digest(docs(spark, [(*r, 1) for r in rows], DOCS + ", spans int"))
    assert Counter(tuple(r) for r in got.collect()) == brute_removal(rows)


def test_maximal_repeats():
    body = np.frombuffer(b"xabcabcdyabcabcd", np.uint8)
    begin = np.arange(16)
    got = {(size, tuple(sorted(m.tolist()))) for size, m in suffix_repeats.maximal_repeats(body, begin, np.full(16, 16), np.concatenate(([256], body[:-1])), 2)}
    want = set()
    raw = bytes(body)
    for size in range(2, 16):
        for s in {raw[i : i + size] for i in range(17 - size)}:
            at = [i for i in range(17 - size) if raw[i : i + size] == s]
            left, right = {raw[i - 1 : i] for i in at}, {raw[i + size : i + size + 1] for i in at}
            if len(at) > 1 and (len(left) > 1 or 0 in at) and len(right) > 1 or len(at) > 1 and (len(left) > 1 or 0 in at) and any(i + size == 16 for i in at):
                want.add((size, tuple(at)))
    assert got == want


def test_remove_repeats_keeps_characters(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("éüñçàö") for _ in range(80)) + text_of(rng, 20)
    rows = [(1, "aß" + passage, 0, 5, "p"), (2, "bþ" + passage + "ø", 0, 6, "q"), (3, None, 0, 7, "r")]
    cut = suffix_repeats.remove_repeats(docs(spark, rows, DOCS + ", n_chars long, doc int, _h string"))
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == ["doc_id", "text", "n_chars", "doc", "_h"] and {(i, r.doc, r["_h"]) for i, r in got.items()} == {(1, 5, "p"), (2, 6, "q"), (3, 7, "r")}
    assert got[1].text == "aß" + passage and got[1].n_chars == len(got[1].text)
    assert got[2].text.startswith("bþ") and got[2].text.endswith("ø") and len(got[2].text) < 10 and got[3].text is None
    assert suffix_repeats.digest(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 5


def test_sharding(spark):
    tree = sharding.even_tree(8)
    rows = [(i, "x" * (i % 7), "s") for i in range(3000)] + [(5, None, "s"), (5, None, "s"), (None, "é", "s")]
    got = sharding.shard_documents(docs(spark, rows, DOCS + ", shard string"), tree, sharding.with_shard(tree, 8)).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and 250 < len(own) < 500
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(3, zlib.crc32("é".encode()))}
    assert sharding.shard_documents(docs(spark, []), tree).count() == 0


def test_changed_weight_moves_only_into_its_subtree(spark):
    tree = sharding.even_tree(8)
    heavy = {**tree, "region1": {**tree["region1"], "rack3": {6: 1.0, 7: 4.0}}}
    d = docs(spark, [(i, "") for i in range(4000)])
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(d, t).collect()} for t in (tree, heavy))
    assert all(a[i] == b[i] or b[i] in tree["region1"]["rack2"] or b[i] in (6, 7) for i in a)
    assert sum(a[i] != b[i] for i in a) > 100


# ---------------------------------------------------------------- 6


def test_warc_round_trip(spark):
    big = "é" * 200_000
    rows = [(3, "u3", "p" * 120), (1, "u1", "p" * 120), (2, "u\n2", "q"), (4, "u4", "q"), (5, None, None), (6, "u6", big), (7, "u7", big), (None, "n", "p" * 120), (1, "u1", "p" * 120)]
    planned = warc.plan_records(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3))
    got = warc.read_archives(warc.write_archives(planned, roll=2000)).collect()
    assert all(r.digest_ok for r in got)
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        first = {"p" * 120: 1, big: 6}.get(h)
        revisit = first if len(b) >= 100 and i is not None and first < i else None
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if revisit is None else "revisit", revisit] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload) for r in got if r.page_id == 6} == {big.encode()}


def test_warc_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 3}" + "x" * 200) for i in range(30)], "page_id long, url string, html string").repartition(3)
    archives = shared.materialize(warc.write_archives(warc.plan_records(pages), roll=2000))
    told = warc.save_archives(archives, f"{tmp_path}/w").collect()
    assert {r.archive: r.bytes for r in told} == {p.name: p.stat().st_size for p in (tmp_path / "w").glob("*.warc.gz")} and len(told) > 1
    assert all(gzip.decompress((tmp_path / "w" / r.archive).read_bytes()).startswith(b"WARC/1.1\r\n") for r in told)
    read = lambda a: sorted((r.page_id, r.record_type, r.offset, bytes(r.payload or b"")) for r in warc.read_archives(a).collect())
    assert read(warc.saved_archives(spark, f"{tmp_path}/w")) == read(archives) and len(read(archives)) == 30


def test_warc_archives_of_partitions_that_begin_alike(spark, tmp_path):
    """Equal rows in several partitions, with and without a page_id: every record is read back, under an id of its own."""
    for i in range(3):
        spark.createDataFrame([(1, "u", "<p>same"), (None, "u", "<p>same"), (i, "v", "x" * 200)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    pages = spark.read.parquet(*(f"{tmp_path}/in/part{i}" for i in range(3)))
    archives = shared.materialize(warc.write_archives(warc.plan_records(pages)))
    assert warc.save_archives(archives, f"{tmp_path}/w").count() == archives.count()
    assert warc.read_archives(warc.saved_archives(spark, f"{tmp_path}/w")).count() == 9
    ids = [f["warc-record-id"] for r in archives.collect() for _, f, _ in warc.members(bytes(r.content))]
    assert len(set(ids)) == len(ids) == 9


def test_warc_reader_refuses_broken_members():
    good = warc.record(1, "u", b"abc", "00", None, None, "n")
    assert len(list(warc.members(good + good))) == 2
    for broken in (good[:-5], good + good[:20]):
        with pytest.raises(ValueError):
            list(warc.members(broken))


PROSE_PARAGRAPH = "<p>" + "Words of a long article go here and on, sentence after sentence. " * 6 + "</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body><svg class="i"/><article>{p}</article>', "{t}"), ("<body><nav><svg /></nav><article>{p}</article>", "{t}"), ("<body><svg><path d=1><g><article>{p}</article>", "{t}"),
        ("<body><svg><title>no</title><text>no</text></svg><article>{p}</article>", "{t}"), ("<body><article><svg><text>no{p}</article>", "{t}"), ("<body><iframe src=a /><article>{p}</article>", "{t}"),
        ("<body><div><iframe src=a></div><article>{p}</article>", "{t}"), ("<body><form id=aspnetForm><nav>menu</nav><div>{p}{p}</div><input></form>", "{t}\n{t}"), ("<body><form><article>{p}</article></form>", "{t}"),
        ("<body><form><div>{p}{p}</div><select><option>no</select></form>", "{t}\n{t}"), ("<body><article>{p}<p>So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds.</p></article>", "{t}\nSo x = 2 holds."),
        ("<body><article>{p}</article><form><p>Send us a line</p><label>Name</label><input></form>", "{t}"), ("<body><article>{p}<template>no</article>", "{t}\nno"),
    ],
)
def test_pages_with_foreign_elements_and_forms(page, want):
    text = " ".join(PROSE_PARAGRAPH[3:-4].split())
    assert html.main_text(page.replace("{p}", PROSE_PARAGRAPH)) == want.replace("{t}", text)


def test_many_raw_elements_without_an_end():
    import time

    began = time.time()
    assert html.main_text("<iframe>" * 50_000 + "<textarea>" * 50_000 + PROSE_PARAGRAPH)
    assert time.time() - began < 20


# ---------------------------------------------------------------- 7


def test_decontamination(spark):
    rng = random.Random(4)
    item, short = text_of(rng, 30, 10**6).split(), text_of(rng, 10, 10**6).split()
    swapped = list(item)
    swapped[5], swapped[14], swapped[23] = "other", "words", "here"
    fill = lambda: text_of(rng, 50, 10**6)
    rows = [
        (1, f"{fill()} {' '.join(item)} {fill()}"), (2, f"{fill()} {' '.join(swapped).upper()}"), (3, " ".join(item[3:18])), (4, " ".join(item[:9])), (5, fill()), (6, None), (7, ""),
        (8, " ".join(short) + "."), (9, f"{fill()} {', '.join(item)}"), (1, f"{fill()} {' '.join(item)} {fill()}"), (None, " ".join(item)),
    ]
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(short)), (12, None), (13, "too short"), (None, fill())], "item_id long, text string")
    got = decontaminate.report(docs(spark, [(*r, 1) for r in rows], DOCS + ", item_id int"), items).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.contaminated} == {1, 2, 3, 8, 9} and {r.item_id for r in got if r.doc_id == 8} == {11}
    assert {r.overlap_words for r in got if r.doc_id in (1, 2, 9)} == {30}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), items).collect()} == {4, 5, 6, 7, None}
    assert decontaminate.report(docs(spark, rows), items.where("item_id < 0")).where("contaminated").count() == 0
    assert decontaminate.report(docs(spark, []), items).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Every document against every item at every offset, by the rule alone; also in several passes of small bitmaps."""
    rng = random.Random(21)
    items = {i: text_of(rng, rng.randrange(8, 40), 60).split() for i in range(25)}
    rows = []
    for i in range(120):
        w = text_of(rng, rng.randrange(0, 60), 60).split()
        if i % 2:
            own = list(rng.choice(list(items.values())))
            a = rng.randrange(len(own) // 2 + 1)
            own = own[a : a + rng.randrange(6, 41)]
            for _ in range(rng.randrange(0, 1 + len(own) // 4)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(99)}"
            w[rng.randrange(len(w) + 1) : 0] = own
        rows.append((i, " ".join(w)))
    want = set()
    for i, t in rows:
        d = t.split()
        for k, own in items.items():
            least, best = max(decontaminate.SPAN, min(decontaminate.LEAST, len(own))), 0
            for shift in range(1 - len(own), len(d)):
                same = [0 <= j + shift < len(d) and d[j + shift] == own[j] for j in range(len(own))]
                if 5 * sum(same) < 4 * least:
                    continue
                for x in range(len(own)):
                    if same[x] and x + shift >= 0:
                        for y in range(x + least, len(own) + 1):
                            if y + shift <= len(d) and same[y - 1] and decontaminate.EVERY * same[x:y].count(False) <= y - x:
                                best = max(best, y - x)
            if best:
                want.add((i, k, best))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert len(want) > 30
    assert {(r.doc_id, r.item_id, r.words) for r in decontaminate.overlaps(docs(spark, rows), table).collect()} == want
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 14)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 14)
    assert decontaminate.passes_for(2000) == (14, 3)
    assert {(r.doc_id, r.item_id, r.words) for r in decontaminate.overlaps(docs(spark, rows), table).collect()} == want


def test_masks_hit_every_permitted_stretch():
    span = decontaminate.SPAN
    marks = [sum(1 << j for j in mask) for mask in decontaminate.MASKS]
    for n in range(span, 31):
        # fewer replaced words are hit wherever more are
        places = np.array(list(itertools.combinations(range(1, n - 1), n // decontaminate.EVERY)), np.int64)
        replaced = (1 << places).sum(1)
        hit = np.zeros(len(replaced), bool)
        for at in range(n - span + 1):
            for m in marks:
                hit |= (replaced >> at) & m == 0
        assert hit.all(), (n, places[~hit][:5].tolist())


def test_decontamination_of_close_replacements(spark):
    cases = [(10, (3, 5)), (10, (2, 6)), (11, (3, 7)), (13, (5, 7)), (15, (1, 7, 9)), (16, (5, 7, 9)), (20, (5, 7, 9, 11))]
    rows, items = [], []
    for k, (n, places) in enumerate(cases):
        own = [f"k{k}x{j}" for j in range(n)]
        items.append((k, " ".join(own)))
        rows.append((k, " ".join(["before", "it", *["other" if j in places else w for j, w in enumerate(own)], "and", "after"])))
    got = decontaminate.overlaps(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.words, r.equal) for r in got} == {(k, k, n, n - len(p)) for k, (n, p) in enumerate(cases)}


def test_best_stretch_against_all_pairs():
    rng = random.Random(0)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randrange(0, 30))], bool)
        a, b = decontaminate.best_stretch(same, 8, 5)
        fits = [(y - x) for x in range(len(same)) for y in range(x + 8, len(same) + 1) if same[x] and same[y - 1] and 5 * (~same[x:y]).sum() <= y - x]
        assert b - a == max(fits, default=0)


# ---------------------------------------------------------------- 8


def pack_one_by_one(lengths, sizes, overhead):
    """Best fit, decreasing, a piece at a time on a plain list of bins: [opened size, contents]."""
    bins, left = [], sorted(lengths, reverse=True)
    while left:
        n = left[0]
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - sum(b[1]))
        else:
            best = None
            for size in sorted((s for s in sizes if s >= n), reverse=True):
                own = min(size // n, left.count(n)) * n
                more = min(size - own, sum(x for x in left if x < n and x <= size - own))
                ends = min(s for s in sizes if s >= own + more)
                cost = (ends + overhead) / (own + more)
                if best is None or cost < best[0]:
                    best = cost, size
            b = [best[1], []]
            bins.append(b)
        b[1].append(left.pop(0))
    return bins


def test_plan_against_packing_one_by_one():
    rng = random.Random(5)
    for _ in range(150):
        sizes = rng.choice([(16, 32, 64), (10, 25, 40, 100), (64,)])
        kinds = rng.choice([4, 20, 100])
        lengths = [min(max(sizes), 1 + rng.randrange(kinds) * max(sizes) // kinds) for _ in range(rng.randrange(1, 120))]
        want = pack_one_by_one(lengths, sizes, 2)
        got = packing.bins_of(dict(Counter(lengths)), sizes, 2)
        # pieces of a size are alike and so are bins of a space: which of them is taken is left open
        spaces = Counter()
        for _, many, size, used, contents in got:
            assert used == sum(n * each for n, _, each, _ in contents)
            spaces[size - used] += many
        assert spaces == Counter(size - sum(own) for size, own in want)
        opened = Counter()
        for _, many, size, _, _ in got:
            opened[size] += many
        assert opened == Counter(size for size, _ in want)


def planned(lengths, sizes, overhead):
    """The plan's bins as lists of (start, length)."""
    opened = {}
    for n, _, count, first, each, start, _ in packing.plan(dict(Counter(lengths)), sizes, overhead):
        for k in range(count):
            opened.setdefault(first + k // each, []).append((start + k % each * n, n))
    return opened


def test_plan_fills_bins_without_gaps_or_loss():
    rng = random.Random(1)
    for _ in range(60):
        sizes = (16, 32, 64)
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 200))]
        bins = planned(lengths, sizes, 2)
        assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
        for b in bins.values():
            at = 0
            for start, n in sorted(b):
                assert start == at
                at += n
            assert at <= 64
            assert [n for _, n in sorted(b)] == sorted((n for _, n in b), reverse=True)  # long before short


def test_pack(spark):
    rows = [(1, "a " * 100), (2, "b " * 30), (3, None), (4, ""), (5, "c " * 7), (5, "c " * 7), (None, "d " * 20), (6, "e " * 64)]
    got = packing.pack(docs(spark, [(*r, 1) for r in rows], DOCS + ", start int"), (16, 32, 64), 2).collect()
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == Counter({(1, 0, 64): 1, (1, 1, 36): 1, (2, 0, 30): 1, (3, 0, 0): 1, (4, 0, 0): 1, (5, 0, 7): 2, (None, 0, 20): 1, (6, 0, 64): 1})
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in got)
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault((r.bin_id, r.bin_size), []).append((r.start, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins) and {b for b, _ in bins} == set(range(len(bins)))
    for (_, size), own in bins.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert size == min(s for s in (16, 32, 64) if s >= at)
    assert packing.pack(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 9


def brute_top(rows, k=5, step=50):
    good = {(i, tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = set()
    for q in {i for i, _ in good if i % step == 0}:
        best = {}
        for i, v in good:
            for j, w in good:
                if i == q and j != q:
                    s = sum(a * b for a, b in zip(v, w))
                    best[j] = max(s, best.get(j, s))
        for rank, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, j, s))
    return out


@pytest.mark.parametrize("annulus", [8, 1024])
def test_top_k(spark, monkeypatch, annulus):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (50, rows[50][1]), (350, [2.0] * 3), (400, [0.0] * 6)]
    monkeypatch.setattr(topk, "RING_ROWS", (annulus, 4 * annulus))
    monkeypatch.setattr(topk, "PACK", 3)
    monkeypatch.setattr(topk, "TILE", 1)
    got = topk.top_k(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3), annulus=annulus, near=2)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)


@pytest.mark.parametrize("annulus", [8, 1024])
def test_top_k_of_ids_with_several_vectors(spark, monkeypatch, annulus):
    rng = random.Random(7)
    rows = [(rng.choice([0, 50, 50, 50, 100, *range(1, 12)]), [rng.gauss(0, 1) for _ in range(4)]) for _ in range(150)]
    rows += [(50, [9.0, 9.0, 9.0, 9.0]), (50, [9.0, 9.0, 9.0, 8.0]), *[(20 + j, [3.0 - j / 8] * 4) for j in range(5)], *[(20, [3.0 + j / 64] * 4) for j in range(8)]]
    monkeypatch.setattr(topk, "RING_ROWS", (annulus, 4 * annulus))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), annulus=annulus, near=2)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)


def test_top_k_with_a_sample_of_few(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(3)]) for i in range(120)] + [(i, [1.0, 1.0, 1.0]) for i in range(120, 180)]
    monkeypatch.setattr(topk, "SAMPLE", 64)
    monkeypatch.setattr(topk, "RING_ROWS", (8, 16))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), annulus=4, near=1, pivots=3)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)


def rows_asked(spark, rows, k=5):
    """The share of (query, row) pairs in the rings that a search over all rings would read, by the sample's bounds."""
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    index = topk.build(vectors)
    asked = topk.queries_of(vectors, index, topk.F.col("id") % 50 == 0)
    packs = topk.wanted(asked.withColumn("bound", topk.F.lit(None).cast("long")), index, k, 0, None)
    size = dict(zip(index.ring.tolist(), index.size.tolist()))
    read = sum(r.n * size[r.ring] for r in packs.select("ring", "n").collect())
    return read / (asked.count() * len(rows))


def test_rings_are_ruled_out_before_the_join(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(topk, "RING_ROWS", (64, 64))
    centres = rng.normal(size=(20, 16)) * 10
    tight = [(i, (centres[i % 20] + rng.normal(size=16) / 2).tolist()) for i in range(4000)]
    assert rows_asked(spark, tight) < 0.2
    got = topk.top_k(spark.createDataFrame(tight, "vec_id long, embedding array<double>").repartition(3)).collect()
    x = np.floor(np.array([v for _, v in tight]) * 256)
    for q in range(0, 4000, 50):
        s = (x @ x[q]).astype(np.int64)
        want = sorted((i for i in range(4000) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, s[i]) for i in want]


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 256 * 5)]
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_scores_beyond_doubles():
    a = np.array([[2.0**40, 3.0]])
    assert topk.scores(a, np.array([[2.0**20 + 1, 5.0]]))[0, 0] == 2**40 * (2**20 + 1) + 15


# ---------------------------------------------------------------- 10


def test_url_rules_and_aliases(spark):
    urls = {
        1: "https://WWW.Example.com/en/x?a#b", 2: "http://shop.example.com/en/", 3: "http://a.net/fr/1", 4: "http://alias.org/x", 5: "http://far.org/y", 6: "http://ok.com/z", 7: None,
        8: "no scheme", 9: "http://net/es/", 10: "http://xnet/es/", 11: "http://alias.org/x#part", 12: "http://lonely.org?x=1/en/",
    }
    links = [("http://a.net/fr/1", "http://alias.org/x"), ("http://alias.org/x", "http://far.org/y"), ("http://far.org/y", "http://ok.com/z"), (None, "q"), ("q", None)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in urls.items()] + [(3, urls[3], 1)], "page_id long, url string, host int")
    got = {r.page_id: r for r in urlfilter.judge(pages, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("net/fr/", "block"), 4: (None, "block"), 5: (None, "block"), 6: ("com/", "allow"), 7: (None, "allow"),
        8: (None, "allow"), 9: ("net/es/", "block"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "allow"),
    }
    assert (got[1].host, got[1].path, got[12].host, got[12].path, got[8].host, got[7].path) == ("www.example.com", "/en/x", "lonely.org", "", "", "")
    assert urlfilter.judge(pages.where("page_id < 0"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_page_links(spark):
    rows = [
        ("http://a.org/x?1#f", "<LINK href='/main' rel='canonical'><link rel=stylesheet href=/s.css>"), ("http://b.org/", '<meta http-equiv="Refresh" content="0; url=https://c.org/p?a=1&amp;b=2">'),
        ("http://d.org/", '<link rel="canonical" href="//e.org/#top">'), (None, '<link rel="canonical" href="/x">'), ("http://g.org/", None),
        ("http://h.org/", '<!-- <link rel="canonical" href="/no"> --><p>refresh</p>'),
        ("http://i.org/a/b", '<base target=_top><base href="http://root.org/x/y"><link rel=canonical href="z"><base href="http://no.org/">'), ("http://j.org/a/b", '<link rel=canonical href="z"><base href="../c/">'),
        ("http://k.org/", "<script>var s = '<link rel=\"canonical\" href=\"http://no.org/\">';</script><style><link rel=canonical href=/no></style><template><link rel=canonical href=/no></template>"),
        ("http://l.org/", '<link title="a > b" rel="canonical" href="/yes">'), ("http://m.org/", "<link rel=canonical href='&#47;deep&#x2F;er?a=1&amp;b=&quot;'>"),
        ("http://n.org/", "<meta http-equiv=refresh content='0.5; URL=\"/late\"'>"), ("http://o.org/", "<meta content='.5,/soon' http-equiv=REFRESH>"), ("http://p.org/", "<meta http-equiv=refresh content=30>"),
        ("http://q.org/", '<link data-href="/no" rel="canonical" href="/q">'), ("http://r.org/", "<script>open('canonical'); <link rel=canonical href=/no>"),
    ]
    got = {tuple(r) for r in urlfilter.page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {
        ("http://a.org/x?1", "http://a.org/main"), ("http://b.org/", "https://c.org/p?a=1&b=2"), ("http://d.org/", "http://e.org/"), ("http://i.org/a/b", "http://root.org/x/z"), ("http://j.org/a/b", "http://j.org/c/z"),
        ("http://l.org/", "http://l.org/yes"), ("http://m.org/", 'http://m.org/deep/er?a=1&b="'), ("http://n.org/", "http://n.org/late"), ("http://o.org/", "http://o.org/soon"), ("http://q.org/", "http://q.org/q"),
    }


def test_links_of_planted_pages_as_in_sql(spark, tmp_path):
    """Components that hold pages of every link form, the query against its SQL."""
    import duckdb

    from murmuration.llm import queries

    base, block = "http://Site.org/a/b/page", "http://x.example.com/en/1"
    hrefs = ["other.html", "../x", "../../../x/./y", "./", "..", "?id=3", "/main/../top", "//Other.ORG/Path", "sub/z?u=/../v", "#top", "mailto:a@b.c", "http://X.Example.com/en/1#p"]
    rows = [(f"{base}{i}", f'<link data-rel=x rel="alternate Canonical" href="{h}">') for i, h in enumerate(hrefs)] + [(f"http://site.org{p}", "") for p in ("/a/b/other.html", "/a/x", "/x/y", "/a/b/", "/a/", "/top", "/a/b/page5?id=3")]
    rows += [("http://other.org/Path", f"<meta http-equiv=refresh content='0.5; url={block}'>"), ("http://site.org/a/x", f'<link title="a > b" rel=canonical href="{block}">'), (None, "<link rel=canonical href=/>"), ("http://site.org/none", None)]
    rows += [("http://c.org/1", '<base href="http://x.example.com/en/"><link rel=canonical href="1">'), ("http://c.org/2", f"<script>'<link rel=canonical href=\"{block}\">'</script>"), ("http://c.org/3", f"<!-- <link rel=canonical href={block}> -->")]
    rows += [("http://c.org/4", "<link rel=canonical href='http:&#47;&#47;x.example.com/en/1'>"), ("http://c.org/5", "<link rel=canonical href='http://c.org/4'>"), ("http://c.org/6", "")]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in urlfilter.query(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == Counter(db.execute(queries.oracle_sql()["op10_url_filter"]).fetchall())
    verdicts = {rows[k[0]][0]: k[4] for k in got}
    assert [verdicts[f"http://c.org/{i}"] for i in range(1, 7)] == ["block", "allow", "allow", "block", "block", "allow"]
    assert verdicts[f"{base}1"] == "block" and verdicts[f"{base}7"] == "block" and verdicts[f"{base}0"] == "allow"


def test_page_links_of_every_form(spark):
    base = "HTTP://Site.org/a/b/page.html?q=1#f"
    hrefs = ["other.html", "../x", "../../../x/./y", "./", "..", "?id=3", "/main/../top", "//Other.ORG/Path", "HTTPS://Else.Net/Q?A=1", "sub/z?u=/../v", "#top", "", "mailto:a@b.c"]
    rows = [(f"{base}{i}", f'<link data-rel=x rel="alternate Canonical" href="{h}">') for i, h in enumerate(hrefs)]
    rows += [("http://bare.org", "<meta http-equiv=refresh content='0;url=in/side'>"), ("no scheme", "<link rel=canonical href=x>"), ("http://n.org/", "<link rel='canonicals not' href=/x>")]
    got = {tuple(r) for r in urlfilter.page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    site = "http://site.org"
    wanted = ["/a/b/other.html", "/a/x", "/x/y", "/a/b/", "/a/", "/a/b/page.html?id=3", "/top", "http://other.org/Path", "https://else.net/Q?A=1", "/a/b/sub/z?u=/../v"]
    edges = {(f"{site}/a/b/page.html?q=1", w if "://" in w else site + w) for w in wanted}
    assert got == edges | {("http://bare.org", "http://bare.org/in/side")}


def test_alias_of_a_blocked_page_by_a_relative_link(spark):
    rows = [(1, "http://a.net/fr/1", ""), (2, "http://A.net/other/2", '<link rel="alternate canonical" href="../fr/1">'), (3, "http://a.NET/other/2#x", None), (4, "http://a.net/other/4", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urlfilter.judge(pages, urlfilter.page_links(pages)).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "allow"}


# ---------------------------------------------------------------- memory of a worker


def _most_held(work) -> float:
    """MB that the work holds at its peak."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
        shared.let_go()


def test_worker_memory():
    """Executors hold several workers beside their heap: hashing some 2 MB of text took 75 MB."""
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(names) for _ in range(300)).encode() for _ in range(1000)]
    shared.let_go()
    joined = b"\n".join(texts)
    assert _most_held(lambda: shared.words(joined)) < 40
    valid = np.ones(len(joined) + 1, bool)
    assert _most_held(lambda: [None for _ in suffix_repeats.window_runs(joined, valid, 100, 32)]) < 40
    labels = [i % 3 == 0 for i in range(len(texts))]
    marked = [t + b" badword" * 2 if y else t for t, y in zip(texts, labels)]
    assert _most_held(lambda: toxicity.fit(marked, labels, rounds=2)) < 130


def test_marginals_without_pairs():
    e = np.random.default_rng(2).normal(size=50)
    first, count = np.array([0, 20, 20]), np.array([20, 0, 30])
    moves = np.log(np.array([[0.9, 0.1], [0.4, 0.6]]))
    p, pair = toxicity.marginals(e, first, count, moves)
    alone, none = toxicity.marginals(e, first, count, moves, pairs=False)
    assert (p == alone).all() and pair.sum() > 40 and not none.any()
