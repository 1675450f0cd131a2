"""Decision tables: each is one CASE expression over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def should_chunk(mode: Column, backend: Column, duration: Column, size_mb: Column, minutes: float = 20, limit_mb: float = 24) -> Column:
    """Whether a medium is split before recognition (PRJ-11)."""
    return (
        F.when(mode == "off", False).when(mode == "force", True).when(backend == "eg2", False)
        .when(duration >= minutes * 60, True).when((backend == "openai") & (size_mb >= limit_mb), True).otherwise(False)
    )


def routing_key(lang: Column, switching: Column, phone: Column, snr: Column, override: Column | None = None) -> Column:
    """Language or `other`, then -phone, then -noisy under 10 dB; an override replaces the language only (PRJ-12)."""
    base = F.when(lang.isin("en", "es") & ~switching, lang).otherwise("other")
    if override is not None:
        base = F.coalesce(override, base)
    return F.concat(base, F.when(phone, "-phone").otherwise(""), F.when(snr < 10, "-noisy").otherwise(""))


def slice_profile(slice_: Column) -> Column:
    """The profile key that a slice of the corpus calibrates, null for other languages (PRJ-13)."""
    lang = F.split_part(slice_, F.lit("_"), F.lit(1))
    return (
        F.when(slice_ == "nospeech", "*").when(~lang.isin("en", "es"), None)
        .when(slice_.endswith("_phone"), F.concat(lang, F.lit("-phone"))).when(slice_.endswith("_noise"), F.concat(lang, F.lit("-noisy"))).otherwise(lang)
    )


def word_confidence(kind: Column, pa: Column, pb: Column) -> Column:
    """Confidence of an aligned slot (FN-11)."""
    known = F.when(pa.isNotNull() & pb.isNotNull(), (pa + pb) / 2).otherwise(F.coalesce(pa, pb))
    return F.when(kind == "agree", F.coalesce(known, F.lit(0.9))).when(kind == "substitute", 0.3 * F.coalesce(F.greatest(pa, pb), F.lit(0.9))).otherwise(0.2)


def window_reason(start: Column, end: Column, duration: Column, pad: float = 0.3) -> Column:
    """Why a window can't be used, null if it can (FN-24)."""
    return (
        F.when(start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end), "no time").when(end < start, "ends before it begins")
        .when(F.least(duration, end + pad) <= F.greatest(F.lit(0.0), start - pad), "outside the file")
    )


def window_bounds(start: Column, end: Column, duration: Column, pad: float = 0.3, cap: float = 30.0) -> tuple[Column, Column]:
    """A padded window within the file, at most `cap` long around its centre; nulls where nothing is left (FN-24)."""
    lo, hi = F.greatest(F.lit(0.0), start - pad), F.least(duration, end + pad)
    mid = (lo + hi) / 2
    a = F.when(hi - lo > cap, mid - cap / 2).otherwise(lo)
    b = F.when(hi - lo > cap, mid + cap / 2).otherwise(hi)
    good = (hi > lo) & (end >= start)
    return F.when(good, a), F.when(good, b)


def decide(pick: Column, sa: Column, sb: Column, margin: Column, default: Column, guarded: Column) -> Column:
    """What a span becomes, as struct(side, source, unclear, confidence) (FN-18).

    A picked side stands unless the other scores more than the margin above it. Without a pick the
    better score wins, unsure within the margin. A guarded empty side has to lead by twice the margin. Without
    scores the pick or the default stands, unsure, but never the guarded empty side; without a pick the side is its own source.
    """
    picked = F.coalesce(pick.isin("a", "b"), F.lit(False))
    other = lambda side: F.when(side == "a", "b").otherwise("a")
    score = lambda side: F.when(side == "a", sa).otherwise(sb)
    beaten = picked & (score(other(pick)) > score(pick) + margin)
    win = F.when(picked, F.when(beaten, other(pick)).otherwise(pick)).otherwise(F.when(sa > sb, "a").when(sa < sb, "b").otherwise(default))
    short = F.coalesce((win == guarded) & (score(guarded) - score(other(guarded)) < 2 * margin), F.lit(False))
    side = F.when(short, other(win)).otherwise(win)
    unsure = (~picked & (F.abs(sa - sb) <= margin)) | (short & ~picked)
    source = F.when(unsure, "verify").when(picked & (side == pick), "pick").otherwise("verify")
    scored = F.struct(side.alias("side"), source.alias("source"), unsure.alias("unclear"), F.when(unsure, 0.3).when(source == "pick", 0.7).otherwise(0.6).alias("confidence"))
    plain = F.when(picked, pick).otherwise(default)
    kept = F.when(F.coalesce(plain == guarded, F.lit(False)), other(plain)).otherwise(plain)
    blind = F.struct(kept.alias("side"), F.when(picked, "pick").otherwise(kept).alias("source"), F.lit(True).alias("unclear"), F.lit(0.3).alias("confidence"))
    return F.when(sa.isNull() | sb.isNull(), blind).otherwise(scored)


def trust_score(agreement: Column, unclear: Column, skipped: Column, fitted: Column | None = None) -> tuple[Column, Column]:
    """Estimated error rate from features and its level (FN-21): every skipped stage adds 0.05, and any lowers the level by one.

    `fitted` is an intercept and weights applied to the features, where a profile has them.
    """
    plain = 0.5 * (1 - agreement) + unclear
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (plain if fitted is None else F.coalesce(fitted, plain)) + 0.05 * skipped))
    rank = F.when(raw < 0.08, 0).when(raw < 0.2, 1).otherwise(2) + F.when(skipped > 0, 1).otherwise(0)
    return raw, F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("low")), rank + 1)


def uncalibrated(spearman: Column, engines: Column, has_probs: Column) -> Column:
    """Whether a trust score rests on nothing measured: no or a weak rank correlation, or one engine without probabilities (FN-21)."""
    return spearman.isNull() | (spearman < 0.7) | ((engines < 2) & ~has_probs)
