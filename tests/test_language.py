"""Text functions on literal cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from murmuration.functions import normal, parsing, sounds
from murmuration.functions import text as T
from murmuration.operators import scoring


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("¿Qué tal, Señor?", "es", "qué tal señor"), ("en dos mil veintiuno", "es", "en 2021"), ("treinta y cinco años", "es", "35 años"), ("1.000 euros", "es", "1000 euros"), ("mil euros", "es", "1000 euros"),
        ("uno", "es", "uno"), ("tres cuatro", "es", "3 4"), ("un millón doscientos mil", "es", "1200000"), ("cien mil", "es", "100000"), ("un perro", "es", "un perro"), ("dos mil millones tres mil uno", "es", "2000003001"), ("mil y uno", "es", "1000 y uno"), ("doscientos cinco treinta y dos", "es", "205 32"), ("ciento un mil", "es", "100 1000"), ("cero cinco", "es", "0 5"), ("0,125 y 2,5", "es", "0 125 y 2 5"),
        ("twenty twenty one", "en", "2021"), ("We sold twenty five units", "en", "we sold 25 units"), ("300 dollars", "en", "$300"), ("one hundred and five", "en", "105"), ("two thousand twenty one", "en", "2021"),
        ("Um, I can't go, uh, there.", "en", "i can not go there"), ("It's the third time", "en", "it is the 3rd time"), ("fifty percent", "en", "50%"), ("three point one four", "en", "3.14"), ("[music] Hello (laughs) world", "en", "hello world"),
        ("Grüße, 1.000 Mal!", "de", "grüße 1000 mal"), (None, "en", ""), ("", "es", ""),
    ],
)
def test_normalize(text, lang, want):
    assert normal.normalize(text, lang) == want


def test_normalize_without_accents_and_tokens():
    assert normal.normalize("¿Qué tal, Señor?", "es", strip=True) == "que tal senor"
    assert [normal.norm_token(w, "en") for w in ("Twenty", "—", "Émile's", "Привет!", "ﬁne")] == ["20", "", "emiles", "привет", "fine"]
    assert [normal.norm_token(w, "es") for w in ("Dieciséis", "veintiuno", "twenty")] == ["16", "veintiuno", "twenty"]


def test_entities():
    assert normal.entities("Yesterday Maria paid 300 dollars in Madrid, said Bob.", "en") == ["maria", "300", "madrid", "bob"]
    assert normal.entities("We sold twenty five units", "en") == ["25"] and normal.entities("HE WENT HOME", "en") == []
    assert normal.entities("Tengo treinta y cinco años. Hoy viene Ana", "es") == ["35", "ana"] and normal.entities("Then I saw that I'm late", "en") == []


def test_flags_of_tokens():
    tokens, flags = normal.flagged(["twenty", "five", "um", "cats"], [True, False, True, False], "en")
    assert (tokens, flags.tolist()) == (["25", "cats"], [True, False])
    tokens, flags = normal.flagged(["it's", "x", "fine"], [True, False, False], "en")
    assert (tokens, flags.tolist()) == (["it", "is", "x", "fine"], [True, True, False, False]) and normal.flagged([], [], "en")[0] == []


def test_scores(spark):
    rows = [
        ("The cat sat on the mat.", "the cat sat on the mat", "en"), ("a b c d", "a x c", "en"), ("", "thanks for watching", "en"), ("¿Qué tal, Señor?", "que tal senor", "es"),
        ("Yesterday Maria paid 300 dollars in Madrid, said Bob.", "yesterday mario paid 400 dollars in madrid said bob", "en"), (None, None, "en"),
    ]
    got = {r.ref: r for r in scoring.text_scores(spark.createDataFrame(rows, "ref string, hyp string, lang string")).collect()}
    assert [(got[r[0]]["sub"], got[r[0]]["del"], got[r[0]]["ins"], got[r[0]]["words"]) for r in rows] == [(0, 0, 0, 6), (1, 1, 0, 4), (0, 0, 3, 0), (2, 0, 0, 3), (2, 0, 0, 8), (0, 0, 0, 0)]
    assert (got[rows[4][0]].entities, got[rows[4][0]].missed) == (4, 2) and got[""].empty_ref and got[rows[1][0]].char_errors == 3 and got[rows[1][0]].chars == 7


def test_unclear_counts(spark):
    say = lambda *w: [(t, u) for t, u in w]
    rows = [("a b c e", "en", say(("a", False), ("x", True), ("c", True), ("d", False))), ("a b", "en", []), ("a b c d", "en", say(("a", False), ("X", True), ("c", False), ("d", True)))]
    got = scoring.unclear_counts(spark.createDataFrame(rows, "ref string, lang string, words array<struct<text:string,unclear:boolean>>")).collect()
    assert [(r.flagged, r.flagged_errors, r.errors, r.hyp_words) for r in got] == [(2, 1, 2, 4), (0, 0, 0, 0), (2, 1, 1, 4)]


def test_records_of_items(spark):
    items = spark.createDataFrame([("i1", "s", "dev", "en", "black cat", 30.0), ("i2", "nospeech", "dev", "en", "", 30.0), ("i3", "s", "dev", "fr", "un deux", 5.0)], "id string, slice string, split string, lang string, ref string, duration double")
    systems = spark.createDataFrame([("x", ["en"]), ("y", None)], "system string, langs array<string>")
    outputs = spark.createDataFrame([("x", "i1", "black hat", [("black", False), ("hat", True)], None), ("x", "i2", "thanks for watching", [], None), ("y", "i1", None, None, "failed")], "system string, id string, text string, words array<struct<text:string,unclear:boolean>>, error string")
    got = {(r.system, r.id): r for r in scoring.score_items(scoring.with_language_support(items, systems), outputs).collect()}
    assert len(got) == 6 and got["x", "i1"].wer == 0.5 and got["x", "i1"].flagged_errors == 1
    assert got["x", "i2"].ins_per_min == 6.0 and got["x", "i2"].wer is None and got["x", "i3"].skipped == "language" and got["x", "i3"].error is None
    assert got["y", "i1"].error == "failed" and got["y", "i3"].error == "no output" and got["y", "i1"].wer is None


# ---------------------------------------------------------------- sounds


def heard(spark, pairs, lang):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [r.d for r in df.select(sounds.phonetic_distance(F.col("a"), F.col("b"), F.lit(lang)).alias("d")).collect()]


def test_spanish_sounds(spark):
    same = [("casa", "caza"), ("vaca", "baca"), ("hola", "ola"), ("llave", "yave"), ("queso", "keso"), ("gente", "jente"), ("cero", "sero"), ("a plazar", "aplazar"), ("Árbol", "arbol"), ("perro", "pero"), ("hacha", "acha"), ("examen", "eksamen"), ("", "")]
    assert heard(spark, same, "es") == [0.0] * len(same)
    apart = heard(spark, [("cana", "caña"), ("examen", "ejamen"), ("aplazar", "mañana"), ("", "casa")], "es")
    assert apart[0] > 0 and apart[1] > 0 and apart[2] > 0.6 and apart[3] == 1.0
    words = spark.createDataFrame([("guerra",), ("examen",), ("guitarra gente",), ("chico 4",), ("Mañana",), (None,), ("ghe",), ("lluvia-ella",)], "w string")
    assert [r.s for r in words.select(sounds.spanish(F.col("w")).alias("s")).collect()] == ["gera", "eksamen", "gitara xente", "Ciko 4", "mañana", "", "ge", "yubia eya"]


def test_spanish_sounds_against_a_scan(spark):
    """All short words over the letters with rules, against the rules read off one letter at a time."""

    def scan(w):
        out, i = "", 0
        while i < len(w):
            two, one, then = w[i : i + 2], w[i], w[i + 1 : i + 2]
            if two in ("ch", "qu", "ll", "rr"):
                out, i = out + {"ch": "C", "qu": "k", "ll": "y", "rr": "r"}[two], i + 2
            elif two == "gu" and w[i + 2 : i + 3] in ("e", "i"):
                out, i = out + "g", i + 2
            else:
                soft = then in ("e", "i") and then != ""
                out += {"h": "", "c": "s" if soft else "k", "z": "s", "q": "k", "g": "x" if soft else "g", "j": "x", "v": "b", "x": "ks"}.get(one, one)
                i += 1
        return out

    words = ["".join(w) for w in itertools.product("cghluqreixz", repeat=4)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", sounds.spanish(F.col("w")).alias("s")).collect()
    assert [r.w for r in got if r.s != scan(r.w)] == []


def test_other_sounds(spark):
    assert heard(spark, [("hallo", "hallo"), ("hallo", "hello"), ("Ñandú", "nandu")], "de") == [0.0, 0.2, 0.0]
    en = heard(spark, [("hello world", "Hello, world!"), ("", ""), ("gpt 4", "gpt 4"), ("gpt 4", "gpt 5"), ("Karpathy", "car pathy"), ("attention", "banana"), ("night", "knight"), ("phone", "fone")], "en")
    assert en[:3] == [0.0, 0.0, 0.0] and en[3] > 0 and en[4] < 0.5 and en[5] >= 0.6 and en[6:] == [0.0, 0.0]


def test_english_with_a_dictionary(spark):
    lexicon = spark.createDataFrame([("self", "S EH1 L F"), ("tension", "T EH1 N SH AH0 N"), ("attention", "AH0 T EH1 N SH AH0 N"), ("don't", "D OW1 N T"), ("bob", "B AA1 B"), ("banana", "B AH0 N AE1 N AH0")], "word string, phones string")
    pairs = [("self tension", "self attention"), ("attention", "banana"), ("Don't!", "don't"), ("Bob's", "bob"), ("Karpathy", "car pathy"), ("", "")]
    got = {(r.a, r.b): r.distance for r in sounds.with_dictionary(spark.createDataFrame(pairs, "a string, b string"), lexicon).collect()}
    assert got["self tension", "self attention"] == pytest.approx(1 / 11) and got["attention", "banana"] > 0.6 and got["Don't!", "don't"] == 0.0
    assert got["Bob's", "bob"] == pytest.approx(1 / 4) and got["Karpathy", "car pathy"] < 0.5 and got["", ""] == 0.0


# ---------------------------------------------------------------- links


def test_platforms(spark):
    urls = {"https://x.com/a/status/1": "x", "http://mobile.twitter.com/a": "x", "https://www.instagram.com/p/1": "instagram", "https://instagr.am/p/1": "instagram", "https://youtu.be/ab": "youtube", "https://m.youtube.com/watch?v=ab": "youtube", "https://vimeo.com/1": None, "https://notx.com/": None, "ftp://x.com/": None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", T.platform(F.col("u")).alias("p"), T.cache_slug(F.col("u")).alias("s")).collect()
    assert {r.u: r.p for r in rows} == urls
    from urllib.parse import quote

    assert all(r.s == quote(r.u, safe="").replace("~", "%7E") for r in rows)


# ---------------------------------------------------------------- terms and answers

PROSE = "Last week Grace Hopper showed compilers to her team. They wrote TestBench with FPGAs and measured it on VAX-11. Notes: www.museum.org/notes?p=2 #CS @hopper"
TERMS = [
    (PROSE, False, ["Grace Hopper", "TestBench", "FPGAs", "VAX-11"]), ("Compilers Are Everywhere (Still)", True, []), ("Grace Hopper: Compilers Are Everywhere", True, ["Grace Hopper"]), (None, True, []), ("Meeting Linus Torvalds", True, ["Linus Torvalds"]),
    ("Yesterday it rained. Nobody came along. Model 1999 sold 10:15 in 2001. Monday Evening", False, []), ("Hello Ada Lovelace and friends.", False, ["Ada Lovelace"]), ("Ada Lovelace came. Then Ada Lovelace left.", False, ["Ada Lovelace"]),
    ("They saw Alan Kay and Niels Henrik Abel there, also Royal Swedish Academy Members.", False, ["Alan Kay", "Niels Henrik Abel"]), ("Vimos a Luis Cernuda en La Mancha y El Prado con la ONU.", False, ["Luis Cernuda", "ONU"]),
    ("It has USB-4x and Model3 by 7am, on the 2nd of June, 30k users, x9 and MP3.", False, ["USB-4x", "Model3", "x9", "MP3"]), ("Ask @OtherName or http://q.io/ABC or write Joe@Mail.net or #BigTag www.y.com/DeF", False, []),
    ("EVERY WORD IS LOUD", False, []), ("y" * 100_000, False, []), ("See Jean-Luc O'Neil's NASA's labs\nOld Marie Curie", False, ["NASA", "Marie Curie"]),
]


def test_terms(spark):
    rows = [(i, 0, text, title, "x") for i, (text, title, _) in enumerate(TERMS)]
    got: dict = {}
    for r in parsing.extract_terms(spark.createDataFrame(rows, "file_id int, part int, text string, title boolean, _x string")).orderBy("file_id", "pos").collect():
        got.setdefault(r.file_id, []).append(r.term)
    assert [got.get(i, []) for i in range(len(TERMS))] == [want for *_, want in TERMS]


CHOICES = [
    ('{"choices": [{"id": 1, "choice": "1"}, {"id": "2", "choice": 2}, {"id": 3, "choice": "maybe"}]}', {1: "1", 2: "2", 3: "unclear"}), ('Sure {id}: ```{"choices":[{"id":4,"choice":" Unclear "}]}``` done', {4: "unclear"}),
    ('{"choices": [{"id": 1, "choice": "1"}, {"id": 2, "cho', {1: "1"}), ('{"choices": [{"id": 1, "choice": "1"}, {"id": 1, "choice": "1"}]}', {1: "unclear"}), ("no json", {}), (None, {}), ("", {}),
    ('{"choices": [{"id": true, "choice": "1"}, 5, {"choice": "2"}]}', {}), ('{"a": "}"} {"choices": [{"id": 9, "choice": "2", "why": "a } in it"}]}', {9: "2"}), ('{"choices": [{"id": 5}]}', {5: "unclear"}),
    ('As in {"id": 5, "choice": "1"}: {"choices":[{"id":4,"choice":"2"}]}', {4: "2"}), ('{"id": -3, "choice": 1} {"id": "-4", "choice": 1}', {-3: "1"}), ('{"a":' * 100_000, {}), ('{"choices":' + "[" * 50_000, {}),
    ('{"id": 1, "choice": "' + "x" * 100_000 + '"}', {1: "unclear"}), ('{"choices": "none"} {"id": 7, "choice": true}', {7: "unclear"}), ('{"id": 99999999999999999999, "choice": 1}', {}),
]


def test_choices(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CHOICES)]
    got: dict = {}
    for r in parsing.parse_choices(spark.createDataFrame(rows, "k int, text string")).collect():
        got.setdefault(r.k, {})[r.span_id] = r.answer
    assert [got.get(i, {}) for i in range(len(CHOICES))] == [want for _, want in CHOICES]


def test_contexts(spark):
    rows = [("youtube", {"youtube_title": " T ", "youtube_description": "d" * 1600}, "given", "en", ""), (None, {}, "given", None, None)]
    df = spark.createDataFrame(rows, "platform string, meta map<string,string>, title string, language string, notes string")
    got = [r.c for r in df.select(parsing.refine_context(*map(F.col, ("platform", "meta", "title", "language", "notes"))).alias("c")).collect()]
    assert got == [{"title": "T", "description": "d" * 1500 + " ...", "language": "en"}, {"title": "given"}]
    info = spark.createDataFrame([(" c ", "a, b,,"), (None, "a"), ("c", None), (None, " , ")], "c string, h string").select(parsing.context_info(F.col("c"), F.col("h")).alias("x")).collect()
    assert [r.x for r in info] == ["c\nHotwords: a, b", "Hotwords: a", "c", None]
    slides = spark.createDataFrame([("NOT_A_SLIDE",), (" **`NOT_A_SLIDE`**. ",), ("NOT_A_SLIDE: a camera shot",), (None,)], "a string").select(parsing.not_a_slide(F.col("a")).alias("x")).collect()
    assert [r.x for r in slides] == [True, True, False, False]


def test_number_words_never_crash():
    rng = random.Random(2)
    for lang, pool in (("es", [*normal.ES_WORDS, "y", "un", "x"]), ("en", [*normal.EN_WORDS, *normal.EN_ORDINALS, "and", "point", "percent", "dollars", "x", "7"])):
        for _ in range(400):
            normal.normalize(" ".join(rng.choice(pool) for _ in range(rng.randrange(9))), lang)


def test_stretches_give_what_the_whole_text_gives():
    """Words between which the rules look, in all orders: only stretches around them go through the rules."""
    rng = random.Random(3)
    pool = "the cat twenty five hundred and point percent dollars um uh Mr. Mrs dr. she'd been gone it's can't won't 'tis rock 'n roll $5 5% 1,000 1.000 3.14 e.g. U.S. word, word. (x y) [a] <b c> ¿qué señor uno dos treinta y cinco mil un millón café's “quoted” st. let's y'all gonna ½ naïve ﬁne Ümlaut third twenty-five i'm I, one".split(" ")
    for _ in range(6000):
        text, lang = " ".join(rng.choice(pool) for _ in range(rng.randrange(9))), rng.choice(["en", "es", "de", None])
        assert normal.tokens_of(text, lang) == normal._whole(text, lang), (lang, text)
