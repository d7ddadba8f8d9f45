"""Scalar expressions on text, durations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings of audio.
AUDIO = (".mp3", ".m4a", ".wav", ".ogg", ".aac")


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))


def shingles(words: Column, n: int) -> Column:
    """Space-joined runs of n words. The inner lambda binds the words, so they are computed once a row."""
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return F.get(F.transform(F.array(words), of), F.lit(0))


def duration_seconds(text: Column) -> Column:
    """HH:MM:SS, MM:SS or SS in whole seconds; anything else is null."""
    parts = F.split(F.trim(text), ":")
    n = F.transform(parts, lambda p: p.try_cast("int"))
    value = (
        F.when(F.size(parts) == 3, n[0] * 3600 + n[1] * 60 + n[2])
        .when(F.size(parts) == 2, n[0] * 60 + n[1])
        .when(F.size(parts) == 1, n[0])
    )
    whole = F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    return F.when(whole, value)


def feed_date(text: Column) -> Column:
    """RFC 822 or ISO dates as UTC timestamps; anything else is null."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", "")
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX")]
    return F.coalesce(*tries)


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def file_name(item_id: Column, url: Column) -> Column:
    """Id, the first 8 digits of the url's md5 and the url's ending if it is one of audio."""
    path = F.lower(F.split_part(url, F.lit("?"), F.lit(1)))
    end = F.regexp_extract(path, r"(\.[a-z0-9]+)$", 1)
    return F.concat(item_id.cast("string"), F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 8), F.when(end.isin(*AUDIO), end).otherwise(".mp3"))


def or_default(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 1)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two whole numbers; 32 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(32)).cast("int")


def whole_minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60).cast("long")


def eta_text(minutes: Column) -> Column:
    """What is shown of a time left: nothing, under a minute, or the rounded minutes."""
    about = F.concat(F.lit("ETA: ~"), F.floor(minutes + 0.5).cast("string"), F.lit(" min"))
    return F.when(minutes <= 0, "").when(minutes < 1, "ETA: <1 min").otherwise(F.coalesce(about, F.lit("")))


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the others as they are."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def excerpt(text: Column, most: int = 300) -> Column:
    """The text, or its first characters and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def address(base: Column, kind: str, item_id: Column, ending: str = "") -> Column:
    """Where a feed or an item's audio is served: base/kind/id."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit(f"/{kind}/"), item_id.cast("string"), F.lit(ending))
