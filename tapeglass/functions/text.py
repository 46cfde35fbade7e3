"""URLs, tiers, keywords, tone strings and model answers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..schemas import TONE_FIELDS

DOMAIN = r"https?://(?:www\.)?([^/]+)"
URL_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def folded(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    """Whether the folded text has any of the parts; an OR of substring tests, which stops at the first."""
    out = F.lit(False)
    low = folded(c)
    for p in parts:
        out = out | low.contains(p)
    return out


def source_domain(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, DOMAIN, 1))
    return F.when(found != "", found)


def source_tier(url: Column, tiers: Iterable[tuple[Iterable[str], int]] | None = None, default: int = 2) -> Column:
    """1, 2 or 3 by the first list that has a part of the URL; unknown sources are in the middle."""
    tiers = tiers or ((config.TIER1_DOMAINS, 1), (config.TIER2_DOMAINS, 2), (config.TIER3_DOMAINS, 3))
    out = None
    for parts, tier in tiers:
        hit = contains_any(url, parts)
        out = F.when(hit, F.lit(tier)) if out is None else out.when(hit, F.lit(tier))
    return out.otherwise(F.lit(default))


def is_pr_wire(url: Column, wires: Iterable[str] = config.TIER3_DOMAINS[: config.PR_WIRES]) -> Column:
    return contains_any(url, wires)


def promo_ratio(url: Column, words: tuple[str, ...] = config.PROMO_KEYWORDS) -> Column:
    """Share of the words that occur; overlapping words count each."""
    low = folded(url)
    hits = sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
    return hits / F.lit(float(len(words)))


def risk_flag(url: Column, words: Iterable[str] = config.RISK_KEYWORDS) -> Column:
    return contains_any(url, words).cast("int")


def tone_parts(raw: Column) -> dict[str, Column]:
    """The seven fields of a comma-separated tone string; missing or malformed ones are 0."""
    parts = F.split(F.coalesce(raw, F.lit("")), ",")
    return {f: F.coalesce(F.nanvl(F.get(parts, F.lit(i)).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for i, f in enumerate(TONE_FIELDS)}


def keyword_pattern(keywords: Iterable[str], quirk: bool = False) -> str:
    """An alternation of the distinct lower-cased keywords in their order; ``quirk`` escapes ``&`` so that it never matches."""
    distinct = list(dict.fromkeys(k.lower() for k in keywords))
    return "|".join(k.replace("&", r"\\&") if quirk else re.escape(k).replace(r"\ ", " ") for k in distinct)


def url_title(url: Column) -> Column:
    """A headline guessed from a URL's last path segment; NULL if it is short or only digits.

    A segment of digits (or ``articleshow``) gives way to the last earlier one of four or more characters that is neither.
    """
    path = F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATH, 1), F.lit("/"))
    path = F.regexp_replace(path, r"(?i)\.(?:html?|cms|php|asp|aspx|jsp|xml|json)$", "")
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    is_id = lambda s: s.rlike(r"^\d+$") | (F.lower(s) == "articleshow")
    other = F.get(F.filter(F.reverse(parts), lambda s: ~is_id(s) & (F.length(s) > 3)), F.lit(0))
    slug = F.when(is_id(last), F.coalesce(other, last)).otherwise(last)
    slug = F.regexp_replace(slug, r"[-_]?\d{5,}$", "")
    slug = F.regexp_replace(slug, r"(?i)^(?:article|story|news|post|blog)[-_]", "")
    title = F.trim(F.regexp_replace(slug, r"[-_]+", " "))
    return F.when((F.length(url) >= 10) & (F.length(title) >= 8) & ~title.rlike(r"^[\d ]+$"), title)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once however often it is named: the optimiser does not copy it into each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_block(answer: Column) -> Column:
    """The first innermost braced block of a model's answer, without code fences."""
    bare = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), "```(?:json)?", ""))
    return once(F.regexp_extract(bare, r"(?s)\{[^{}]*\}", 0), lambda found: F.when(found != "", found))


#: Confidence is read as text: a quoted number is accepted.
ANSWER = "sentiment string, confidence string, rationale string, entities array<string>"


def checked_answer(answer: Column) -> Column:
    """struct(valid, message, sentiment, confidence, score, entities) of a model's answer, which is parsed once."""

    def fields(a: Column, confidence: Column, message: Column) -> Column:
        ok, sentiment = message == "OK", a["sentiment"]
        sign = F.when(sentiment == "bullish", 1.0).when(sentiment == "bearish", -1.0).otherwise(0.0)
        return F.struct(ok.alias("valid"), message.alias("message"), F.when(ok, sentiment).alias("sentiment"), F.when(ok, confidence).alias("confidence"), F.when(ok, sign * confidence).alias("score"), F.when(ok, F.to_json(a["entities"])).alias("entities"))

    def checked(a: Column, confidence: Column) -> Column:
        message = F.when(a.isNull(), "Not a dict")
        for field in ("sentiment", "confidence", "rationale", "entities"):
            message = message.when(a[field].isNull(), f"Missing field: {field}")
        message = message.when(~a["sentiment"].isin("bullish", "bearish", "neutral"), "Invalid sentiment")
        message = message.when(confidence.isNull() | F.isnan(confidence), "Invalid confidence").when((confidence < 0) | (confidence > 1), "Confidence out of range").otherwise("OK")
        return once(message, lambda m: fields(a, confidence, m))

    return once(F.from_json(json_block(answer), ANSWER), lambda a: once(a["confidence"].try_cast("double"), lambda confidence: checked(a, confidence)))


def prompt(title: Column, repair: Column | None = None) -> Column:
    """The instruction for a headline, with the complaint about the last answer on a retry."""
    ask = 'Classify the financial headline. Answer with one JSON object with the keys "sentiment" (bullish, bearish or neutral), "confidence" (0 to 1), "rationale" and "entities" (list).\nHeadline: '
    base = F.concat(F.lit(ask), title)
    return base if repair is None else F.concat(base, F.lit("\nThe last answer was rejected: "), repair)
