"""How words sound, as column expressions, and how far two sounds are apart (FN-12).

Every rule of a language is one pass over the text; what a pass has decided is in capitals, so that no later pass
reads it again.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phonemes of the pronunciation dictionary, in its own order; each stands as one character.
ARPABET = tuple("AA AE AH AO AW AY B CH D DH EH ER EY F G HH IH IY JH K L M N NG OW OY P R S SH T TH UH UW V W Y Z ZH".split())
ACCENTED = [(chr(c), base[0]) for c in range(0xC0, 0x250) if len(base := unicodedata.normalize("NFD", chr(c).lower())) > 1 and base[0].isascii()]
GAP = r"[\s_/-]+"

#: Spanish by sound (seseo, b = v, ll = y, silent h, rr = r).
SPANISH = (
    ("ch", "C"), ("qu|q", "K"), ("c(?=[ei])", "S"), ("[ck]", "K"), ("gu(?=[ei])", "G"), ("g(?=[ei])", "X"), ("g", "G"), ("j", "X"), ("ll|y", "Y"), ("rr?", "R"), ("[zs]", "S"), ("[vb]", "B"), ("x", "KS"), ("h", ""),
)
#: English letters to consonant codes (metaphone); 0 is th, X is sh. Vowels stay only at the beginning of a word.
ENGLISH = (
    (r"([abd-fh-z])\1", "$1"), (r"\b[kgp](?=n)|\bw(?=r)|\ba(?=e)|(?<=m)b\b|t(?=ch)|gh(?![aeiou])|g(?=n(?:ed)?\b)", ""), (r"sch", "sk"), (r"\bx", "s"), (r"ch|sh|c(?=ia)|[st](?=i[ao])", "X"), (r"th", "0"),
    (r"ph", "f"), (r"s?c(?=[iey])", "s"), (r"ck", "k"), (r"d?g(?=[eiy])", "j"), (r"gh", "k"), (r"[hwy](?![aeiou])", ""), (r"x", "ks"), (r"\B[aeiou]", ""),
)
ENGLISH_LETTERS = ("cqvdzg", "kkftsk")


def folded(text: Column, keep: str = "") -> Column:
    """Lower case without accents but for the letters of `keep`; null gives empty."""
    pairs = [(a, b) for a, b in ACCENTED if a.lower() not in keep]
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def _passes(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, text)


def _words(text: Column, drop: str, gap: str = GAP) -> Column:
    """Words by one space, without the characters of `drop`."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, gap, " "), drop, ""), " +", " "))


def spanish(text: Column) -> Column:
    """Spanish words by sound; ñ is a sound of its own, digits stay, C is the sound of ch."""
    done = _passes(_words(folded(text, keep="ñ"), "[^a-zñ0-9 ]"), SPANISH)
    return F.trim(F.regexp_replace(F.translate(done, "KSGXYRB", "ksgxyrb"), " +", " "))


def plain(text: Column) -> Column:
    """Words of any other language by their letters without accents."""
    return _words(folded(text), "[^a-z0-9 ]", gap=r"\s+")


def english_words(text: Column) -> Column:
    """Words for the dictionary: lower case, letters, digits and inner apostrophes."""
    return F.regexp_replace(_words(folded(F.translate(text, "’", "'")), "[^a-z0-9' ]"), r"(?<= |^)'+|'+(?= |$)", "")


def metaphone(text: Column) -> Column:
    """English words by consonant codes; digits stay."""
    return F.upper(F.trim(F.regexp_replace(F.translate(_passes(F.translate(english_words(text), "'", ""), ENGLISH), *ENGLISH_LETTERS), " +", " ")))


def phonemes(text: Column, lang: Column) -> Column:
    """Words by sound, by language; English by consonant codes (with a dictionary: `with_dictionary`)."""
    code = F.substring(F.lower(F.trim(F.coalesce(lang, F.lit("")))), 1, 2)
    return F.when(code == "es", spanish(text)).when(code == "en", metaphone(text)).otherwise(plain(text))


def sound_distance(a: Column, b: Column) -> Column:
    """Edits between two sounds over the longer one's length, word boundaries ignored; 0 for two empty ones."""
    x, y = F.replace(a, F.lit(" ")), F.replace(b, F.lit(" "))
    return F.coalesce(F.try_divide(F.levenshtein(x, y), F.greatest(F.length(x), F.length(y))), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def phonetic_distance(a: Column, b: Column, lang: Column) -> Column:
    return sound_distance(phonemes(a, lang), phonemes(b, lang))


def with_dictionary(pairs: DataFrame, lexicon: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds `distance` of English texts: by the phonemes of `lexicon` (word, phones) if it has every word of both, else by consonant codes.

    A word with an apostrophe that isn't found is looked up without it, then without a final 's, which adds Z.
    Digits stand for themselves. Words meet the lexicon in ordinary joins.
    """
    key = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))  # equal pairs are one, and nulls in a struct are equal
    rows = pairs.select(a, b).distinct().withColumn("_row", key)
    side = lambda c, n: rows.select("_row", F.lit(n).alias("_side"), F.posexplode(F.regexp_extract_all(english_words(F.col(c)), F.lit(r"([a-z']+|\d)"), F.lit(1))).alias("_i", "w"))
    words = side(a, 0).unionByName(side(b, 1))
    one = F.array(*[F.lit(p) for p in ARPABET])
    coded = F.transform(F.split(F.regexp_replace("phones", r"\d", ""), " "), lambda p: F.char(F.array_position(one, p) + 64))
    known = lexicon.groupBy("word").agg(F.min("phones").alias("phones")).select("word", F.array_join(coded, "").alias("code"))
    tried = words.select("_row", "_side", "_i", "w", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("w").alias("word"), F.lit("").alias("tail")),
        F.struct(F.lit(1).alias("k"), F.replace("w", F.lit("'")).alias("word"), F.lit("").alias("tail")),
        F.struct(F.lit(2).alias("k"), F.regexp_extract("w", "^(.+)'s$", 1).alias("word"), F.lit(chr(65 + ARPABET.index("Z"))).alias("tail")),
    )).alias("t")).select("_row", "_side", "_i", "w", "t.*")
    found = tried.join(known, "word", "left").withColumn("code", F.when(F.col("w").rlike(r"^\d$"), F.col("w")).otherwise(F.concat("code", "tail")))
    best = found.groupBy("_row", "_side", "_i").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("k"))).alias("code"))
    sounds = best.groupBy("_row", "_side").agg(F.bool_and(F.col("code").isNotNull()).alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("code", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("s"))
    by_row = sounds.groupBy("_row").agg(F.bool_and("all").alias("_all"), F.max(F.when(F.col("_side") == 0, F.col("s"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("s"))).alias("_b"))
    met = pairs.withColumn("_row", key).join(by_row, "_row", "left")
    said = sound_distance(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit("")))
    return met.withColumn("distance", F.when(F.coalesce("_all", F.lit(True)), said).otherwise(sound_distance(metaphone(F.col(a)), metaphone(F.col(b))))).drop("_row", "_all", "_a", "_b")
