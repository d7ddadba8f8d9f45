"""Promotional language: phrase hits, density, and whether a text is an advert or live speech."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of promotional language, one hit each; the first list counts three times.
STRONG = [
    "support for the show comes from", "support for this show comes from",
    "support for this podcast comes from", "support for the podcast comes from",
    "brought to you by", "sponsored by", "paid for by", "is supported by",
    "promo code", "use code", "coupon code", "discount code", "offer code",
    "percent off", "free shipping", "free trial", "money back guarantee",
    "terms apply", "terms and conditions", "restrictions apply",
    "see terms", "offer ends", "new members only", "for a limited time",
    "available on amazon", "at participating", "while supplies last",
    "member finra", "not financial advice", "results may vary",
    "always drive responsibly", "for feature availability",
    "visit capella.edu", "cancel anytime", "no purchase necessary",
    "bonus bets", "responsible gaming", "gambling problem",
    "minimum odds", "21 and over", "must be 21", "void in ontario",
    "void where prohibited", "limited time offer", "new customers",
    "this week on", "on the iheartradio app", "on the iheart radio app",
    "wherever you get your podcasts", "wherever you listen to podcasts",
    "listen and subscribe", "new episodes every", "an iheart original",
    "from iheart podcasts", "this is an iheart podcast",
    "is a production of cool zone media", "for more podcasts from cool zone media",
    "check us out on the iheartradio app",
]
WEAK = [
    "subscribe", "download the app", "app store", "google play",
    "our website", "learn more at", "go to", "visit", "sign up",
    "apple podcasts", "spotify", "iheartradio", "episodes",
    "save", "deal", "offer", "discount", "delivery", "customers",
]
# Patterns and phrases of addresses, of the end of a show and of breaks.
DOTCOM = r"\b[a-z0-9]+\s?\.\s?com\b|\bdot com\b"
OUTRO = ["is a production of cool zone media", "is a production of"]
BREAK = (
    r"\b(we('| a)?re back|we are back|welcome back|back to the (show|episode)|and now back to|when we (come|get) back"
    r"|we('|w)?ll be (right )?back|be right back|after (the|this) break|after these messages"
    r"|(go|going|let's go)( on| to)? a break|take a (quick )?break|return for (a few )?more|right after this)\b"
)


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the lower-case text contains: a sum of plain searches, which are compiled."""
    return reduce(add, (F.contains(text, F.lit(p)).cast("int") for p in phrases))


def strong_hits(text: Column) -> Column:
    low = F.lower(text)
    return hits(low, STRONG) + F.when(F.contains(low, F.lit("com")), F.regexp_count(low, F.lit(DOTCOM))).otherwise(0)


def weak_hits(text: Column) -> Column:
    return hits(F.lower(text), WEAK)


def word_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))


def density_of(strong: Column, weak: Column, words: Column) -> Column:
    return (strong * 3 + weak) / words * 100


def density(text: Column) -> Column:
    return density_of(strong_hits(text), weak_hits(text), word_count(text))


def is_ad(text: Column) -> Column:
    return (strong_hits(text) >= 1) & (density(text) >= 1.5)


def is_strong_ad(text: Column) -> Column:
    return (strong_hits(text) >= 2) & (density(text) >= 2.0)


def scored(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The ``keep`` columns with strong, weak, words, ad and strong_ad of a text; each text is searched once."""
    counted = df.select(*keep, strong_hits(text).alias("strong"), weak_hits(text).alias("weak"), word_count(text).alias("words"))
    strong, dense = F.col("strong"), density_of(F.col("strong"), F.col("weak"), F.col("words"))
    return counted.select(*keep, "strong", "weak", "words", ((strong >= 1) & (dense >= 1.5)).alias("ad"), ((strong >= 2) & (dense >= 2.0)).alias("strong_ad"))


def is_annotation(text: Column) -> Column:
    return F.trim(text).rlike(r"(?s)^[\(\[♪].*[\)\]♪]$")


def is_break(text: Column) -> Column:
    return (word_count(text) <= 20) & F.lower(text).rlike(BREAK)
