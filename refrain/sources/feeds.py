"""Feed and transcript sources, and the feed sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.scalar import duration_seconds, feed_date, or_default

LINKS = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>"
ITEM = (
    f"title string, guid struct<_VALUE:string,_isPermaLink:string>, link {LINKS}, `atom:link` {LINKS}, description string, summary string, "
    "pubDate string, updated string, enclosure array<struct<_url:string,_type:string>>, `itunes:duration` string"
)
ENTRY = f"title string, id string, link {LINKS}, summary string, published string, updated string, `itunes:duration` string"
CHANNEL = (
    "title string, description string, author string, `itunes:author` string, "
    "image struct<url:string>, `itunes:image` struct<_VALUE:string,_href:string>, item array<struct<title:string>>"
)
FEED = "title string, subtitle string, author array<struct<name:string>>, logo string, entry array<struct<title:string>>"
TRANSCRIPT = "transcription array<struct<offsets:struct<`from`:bigint,`to`:bigint>,text:string>>"


def _first(links, kept, part: str):
    return F.get(F.filter(links, lambda x: F.coalesce(kept(x), F.lit(False)) & x[part].isNotNull()), F.lit(0))[part]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """guid, title, description, pub_date, audio_url, duration_s of RSS items and Atom entries.

    Audio is the first enclosure of an audio type, else the first link of one; entries without audio are dropped.
    """
    return _entries(*(spark.read.format("xml").option("rowTag", tag).schema(kind).load(path) for tag, kind in (("item", ITEM), ("entry", ENTRY))))


def stream_feed(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The same as a stream: files of feeds that come into the folder, ``most`` at a time."""

    def source(tag: str, kind: str) -> DataFrame:
        s = spark.readStream.format("xml").option("rowTag", tag).schema(kind)
        return (s.option("maxFilesPerTrigger", most) if most else s).load(path)

    return _entries(source("item", ITEM), source("entry", ENTRY))


def _entries(items: DataFrame, entries: DataFrame) -> DataFrame:
    none = F.array().cast(LINKS)

    def sounds(x):
        return F.startswith(x["_type"], F.lit("audio/"))

    def page(links):
        return F.coalesce(_first(links, lambda x: F.lit(True), "_VALUE"), _first(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate", "_href"))

    links = F.concat(F.coalesce("link", none), F.coalesce("atom:link", none))
    url = F.coalesce(_first(F.col("enclosure"), sounds, "_url"), _first(links, sounds, "_href"))
    rss = items.select(
        F.coalesce(F.col("guid._VALUE"), page(links), url).alias("guid"), "title", F.coalesce("description", "summary").alias("description"),
        F.coalesce(feed_date(F.col("pubDate")), feed_date(F.col("updated"))).alias("pub_date"), url.alias("audio_url"), "itunes:duration",
    )
    # An entry's enclosures are links too; they come first.
    own = F.coalesce("link", none)
    url = F.coalesce(_first(own, lambda x: (x["_rel"] == "enclosure") & sounds(x), "_href"), _first(own, sounds, "_href"))
    atom = entries.select(
        F.coalesce("id", page(own), url).alias("guid"), "title", F.col("summary").alias("description"),
        F.coalesce(feed_date(F.col("published")), feed_date(F.col("updated"))).alias("pub_date"), url.alias("audio_url"), "itunes:duration",
    )
    return rss.unionByName(atom).where("audio_url is not null").select(
        "guid", or_default(F.col("title"), "Unknown Episode").alias("title"), F.coalesce("description", F.lit("")).alias("description"),
        "pub_date", "audio_url", duration_seconds(F.col("itunes:duration")).alias("duration_s"),
    )


def read_channel(spark: SparkSession, path: str) -> DataFrame:
    """file, title, description, image_url, author, n_entries of each RSS channel and Atom feed.

    The image is the channel's own, else that of its iTunes tag, else empty. A feed without entries is a row with
    n_entries 0, which is how a caller tells it from one whose entries hold no audio.
    """
    xml = spark.read.format("xml")
    rss = xml.option("rowTag", "channel").schema(CHANNEL).load(path).select(
        "title", "description", F.coalesce("image.url", F.col("`itunes:image`._href"), F.col("`itunes:image`._VALUE")).alias("image_url"),
        F.coalesce("author", "itunes:author").alias("author"), F.size(F.coalesce("item", F.array())).alias("n_entries"),
    )
    atom = spark.read.format("xml").option("rowTag", "feed").schema(FEED).load(path).select(
        "title", F.col("subtitle").alias("description"), F.col("logo").alias("image_url"), F.get("author", F.lit(0))["name"].alias("author"),
        F.size(F.coalesce("entry", F.array())).alias("n_entries"),
    )
    both = rss.unionByName(atom).withColumn("file", F.input_file_name())
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("description", "image_url", "author")]
    return both.select("file", or_default(F.col("title"), "Unknown Podcast").alias("title"), *texts, "n_entries")


def _transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, start, end, text: seconds from milliseconds; blank segments are dropped. ``transcript_files`` has the files without any."""
    seg = _transcripts(spark, path).select("file", F.posexplode("transcription").alias("idx", "s"))
    out = seg.select("file", "idx", (F.col("s.offsets.from") / 1000.0).alias("start"), (F.col("s.offsets.to") / 1000.0).alias("end"), F.trim("s.text").alias("text"))
    return out.where("text <> ''")


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """file, n_segments: every file of a transcript, 0 where nothing is said in it. An item without a row here has no transcript."""
    said = F.filter("transcription", lambda s: F.trim(s["text"]) != "")
    return _transcripts(spark, path).groupBy("file").agg(F.sum(F.size(F.coalesce(said, F.array()))).alias("n_segments"))


def _escaped(c: str):
    text = F.col(c).cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _element(items: DataFrame, c: str, tag: str) -> list:
    """The column's element, nothing where it is null or empty, and no part at all where the table lacks it."""
    if c not in items.columns:
        return []
    held = F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    return [F.when(held, F.concat(F.lit(f"<{tag}>"), _escaped(c), F.lit(f"</{tag}>"))).otherwise("")]


def _attribute(items: DataFrame, c: str, before: str, after: str) -> list:
    """An element that carries the column in an attribute, under the same rule."""
    if c not in items.columns:
        return []
    held = F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    return [F.when(held, F.concat(F.lit(before), _escaped(c), F.lit(after))).otherwise("")]


def feed_items(items: DataFrame, dated: bool = False) -> DataFrame:
    """Adds xml: an item element per row (guid, title, audio_url, duration_s), escaped.

    Also written where the table has them: description and length (the audio's bytes), and with ``dated`` pub_date.
    """
    date = []
    if dated:
        # Times without a zone are UTC.
        zoned = dict(items.dtypes)["pub_date"] == "timestamp"
        utc = F.to_utc_timestamp("pub_date", F.current_timezone()) if zoned else F.col("pub_date").cast("timestamp")
        at = F.date_format(utc, "EEE, dd MMM yyyy HH:mm:ss")
        date = [F.coalesce(F.concat(F.lit("<pubDate>"), at, F.lit(" +0000</pubDate>")), F.lit(""))]
    parts = [
        F.lit("<item><title>"), _escaped("title"), F.lit("</title>"), *_element(items, "description", "description"),
        F.lit("<guid>"), _escaped("guid"), F.lit("</guid>"), *date, F.lit("<itunes:duration>"),
        F.coalesce(F.col("duration_s").cast("string"), F.lit("0")), F.lit('</itunes:duration><enclosure url="'), _escaped("audio_url"),
        F.lit('"'), *_attribute(items, "length", ' length="', '"'), F.lit(' type="audio/mpeg"/></item>'),
    ]
    return items.withColumn("xml", F.concat(*parts))


def feeds(groups: DataFrame, items: DataFrame, dated: bool = False) -> DataFrame:
    """group, xml: a channel per group (group, name), its items newest first and undated ones last; groups without items too.

    The channel's description, self_url, link, language, author and image_url are written where the table has them.
    """
    newest = F.array_sort(F.collect_list(F.struct((-F.col("pub_date").cast("timestamp").cast("double")).alias("age"), "guid", "xml")))
    listed = feed_items(items, dated).groupBy("group").agg(F.array_join(F.transform(F.filter(newest, lambda x: x["age"].isNotNull()), lambda x: x["xml"]), "").alias("dated"), F.array_join(F.transform(F.filter(newest, lambda x: x["age"].isNull()), lambda x: x["xml"]), "").alias("undated"))
    about = [
        *_element(groups, "description", "description"), *_attribute(groups, "self_url", '<atom:link href="', '" rel="self"/>'),
        *_element(groups, "link", "link"), *_element(groups, "language", "language"), *_element(groups, "author", "itunes:author"),
        *_attribute(groups, "image_url", '<itunes:image href="', '"/>'),
    ]
    head = F.concat(F.lit('<rss version="2.0"><channel><title>'), _escaped("name"), F.lit("</title>"), *about)
    body = F.concat(F.coalesce("dated", F.lit("")), F.coalesce("undated", F.lit("")))
    joined = groups.select("group", head.alias("head")).join(listed, "group", "left")
    return joined.select("group", F.concat("head", body, F.lit("</channel></rss>")).alias("xml"))


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"value": ["<feeds>"]})
    for b in batches:
        yield pd.DataFrame({"value": b["xml"]})
    yield pd.DataFrame({"value": ["</feeds>"]})


def write_feeds(made: DataFrame, path: str) -> None:
    """Write feeds (xml) to the folder: a file for each partition, with one root around its feeds, as readers of XML ask for."""
    made.select("xml").mapInPandas(_bundled, "value string").write.mode("overwrite").text(path)
