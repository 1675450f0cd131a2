"""Scalar functions on text, URLs and names. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of the supported video platforms.
PLATFORMS = {"youtube": ("youtube.com", "youtu.be"), "x": ("x.com", "twitter.com"), "instagram": ("instagram.com", "instagr.am")}
SPACE = r"(?U)\s"


def squeeze(text: Column) -> Column:
    """Unicode white space to one space, trimmed; null gives empty (PRJ-1)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "), r"^ | $", "")


def has_markup(text: Column) -> Column:
    """Whether a tag-like run <...> occurs (PRJ-2)."""
    return F.coalesce(text, F.lit("")).rlike(r"<[^<>\s][^<>]*>")


def unusable(text: Column, marker: str = "IGNORE_TIME_SEGMENT") -> Column:
    """Why a reference can't be used, null if it can: markup, the ignore marker, or nothing left (PRJ-2)."""
    return F.when(has_markup(text), "markup").when(F.instr(F.coalesce(text, F.lit("")), marker) > 0, "ignored").when(squeeze(text) == "", "empty")


def tokens(text: Column) -> Column:
    """Words of the squeezed text, none for an empty one."""
    clean = squeeze(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def strip_edges(word: Column) -> Column:
    """Lower-cased word without punctuation at its edges."""
    return F.regexp_replace(F.lower(word), r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def letters(word: Column) -> Column:
    """Lower-cased letters and digits of a word."""
    return F.regexp_replace(F.lower(word), r"(?U)[^\p{L}\p{N}]+", "")


def slug(name: Column) -> Column:
    """Runs outside A-Z a-z 0-9 . _ - become one underscore, edges lose . and _ (PRJ-10)."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) url without port and user, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def platform(url: Column) -> Column:
    """The platform whose host, or a subdomain of it, an http(s) url has; else null (PRJ-7)."""
    h, out = host(url), F.lit(None).cast("string")
    for name, hosts in PLATFORMS.items():
        for x in hosts:
            out = F.when((h == x) | h.endswith(f".{x}"), name).otherwise(out)
    return out


def unescape_url(url: Column) -> Column:
    """In http(s) urls a backslash before / ? = & is removed (PRJ-8)."""
    return F.when(url.rlike(r"(?i)^https?:"), F.regexp_replace(url, r"\\([/?=&])", "$1")).otherwise(url)


def video_id(url: Column) -> Column:
    """Video id of a watch, short or embedded link, else null (PRJ-9)."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    short = F.when(h == "youtu.be", F.regexp_extract(url, r"(?i)^https?://[^/?#]+/([^/?#]+)", 1))
    query = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+/(?:shorts|embed|live)/([^/?#]+)", 1)
    return F.nullif(F.coalesce(F.nullif(short, F.lit("")), F.nullif(query, F.lit("")), path), F.lit(""))


def assign_split(key: Column) -> Column:
    """dev where the SHA-256 of the id is even, else test (FN-22)."""
    return F.when(F.conv(F.right(F.sha2(key, 256), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


def cache_slug(name: Column) -> Column:
    """File name that can be undone: every UTF-8 byte outside A-Z a-z 0-9 . _ - as %XX (PRJ-10)."""
    byte = lambda b: F.when(b.rlike("^(?:2D|2E|5F|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"), F.char(F.conv(b, 16, 10).cast("long"))).otherwise(F.concat(F.lit("%"), b))
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(name, "UTF-8")), F.lit("(..)"), F.lit(1)), byte), "")


def watch_url(source: Column, seconds: Column) -> Column:
    """The watch link of an http(s) source's video at whole seconds, null without a video id (FN-26)."""
    return F.when(source.rlike("^https?://"), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(source), F.lit("&t="), F.floor(seconds).cast("string"), F.lit("s")))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as a JSON object with sorted keys, nulls among them (FN-23)."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def ngrams(words: Column, longest: int = 3) -> Column:
    """All runs of 1 to `longest` words, joined by a space, in order of place and length (FN-27)."""
    size = F.size(words)
    at = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[at(n) for n in range(1, longest + 1)])


def mmss(seconds: Column) -> Column:
    """Whole seconds as mm:ss (FN-26)."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of the seconds rounded to milliseconds, not below 0 (FN-26, SRC-9)."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    part = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3))
