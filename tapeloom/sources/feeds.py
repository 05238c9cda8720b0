"""Disclosure feeds: RSS files, announcement JSON and raw entry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.functions import text as X

RSS_SCHEMA = "title string, link string, pubDate string, description string"
ANNOUNCEMENT_SCHEMA = (
    "attchmntFile string, seq_id string, symbol string, sm_isin string, desc string, "
    "attchmntText string, an_dt string, smIndustry string"
)


def read_rss(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """RSS files to raw entries of one feed; ``corrupt`` holds the text of an item that does not parse."""
    reader = spark.read.format("xml").schema(RSS_SCHEMA + ", corrupt string").option("rowTag", "item").option("columnNameOfCorruptRecord", "corrupt")
    return reader.load(path).select(F.lit(feed).alias("feed"), "title", "link", F.col("pubDate").alias("pub"), "description", "corrupt")


def split_corrupt(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable entries and the texts of those that do not parse."""
    good = entries.where(F.col("corrupt").isNull()).drop("corrupt")
    return good, entries.where(F.col("corrupt").isNotNull()).select("feed", "corrupt")


def _trimmed(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def entry_link() -> Column:
    """Link of a raw entry, its natural key within the feed; null when blank."""
    return F.nullif(_trimmed("link"), F.lit(""))


def entry_hash() -> Column:
    """Content hash of a raw entry."""
    return X.content_hash(F.col("feed"), *[_trimmed(c) for c in ("title", "link", "pub", "description")])


def entries_to_filings(entries: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Raw entries (feed, title, link, pub, description) to typed filings.

    ``keep`` names extra columns carried through, such as ids and observation times.
    """
    df = entries.withColumns({c: _trimmed(c) for c in ("title", "link", "pub", "description")})
    df = df.withColumn("fields", X.summary_fields(F.col("description")))
    stated = lambda k: F.nullif(F.try_element_at("fields", F.lit(k)), F.lit(""))
    link = entry_link()
    return df.select(
        *keep, "feed",
        F.col("title").alias("company_title"),
        link.alias("link"),
        X.symbol_from_link(F.col("link")).alias("symbol_hint"),
        F.coalesce(X.published_at(F.col("pub")), X.time_from_link(F.col("link"))).alias("event_at"),
        F.coalesce(stated("SUBJECT"), stated("_text"), F.col("title")).alias("subject"),
        F.nullif("description", F.lit("")).alias("description"),
        "fields",
        entry_hash().alias("content_hash"),
        link.alias("dedup_key"),
        X.attachment_url(link).alias("attachment_url"),
        F.lit("rss").alias("source"),
    )


def read_announcements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOUNCEMENT_SCHEMA).json(path, multiLine=True)


def announcements_to_filings(rows: DataFrame) -> DataFrame:
    """Announcement rows to filings; rows with neither attachment nor sequence id are refused.

    The attachment URL is the natural key, the same as in the RSS feed, so both routes meet
    in one filing.
    """
    b = lambda c: X.blank_to_null(F.col(c))
    key = F.coalesce(b("attchmntFile"), F.concat(F.lit("seq:"), b("seq_id")))
    df = rows.withColumn("dedup_key", key).where(F.col("dedup_key").isNotNull())
    return df.select(
        F.lit("announcements").alias("feed"), F.upper(b("symbol")).alias("symbol"), b("sm_isin").alias("isin"),
        b("desc").alias("subject"), b("attchmntText").alias("description"), b("attchmntFile").alias("link"),
        b("attchmntFile").alias("attachment_url"), "dedup_key",
        F.sha2(F.concat(F.lit("api|announcements|"), F.col("dedup_key")), 256).alias("content_hash"),
        F.create_map(F.lit("smIndustry"), F.col("smIndustry")).alias("raw"),
        X.published_at(F.col("an_dt")).alias("event_at"), F.lit("api_backfill").alias("source"),
    )


def industry_statement() -> Column:
    return F.try_element_at("raw", F.lit("smIndustry"))


def outbox_rows(df: DataFrame, topic: str, *columns: str) -> DataFrame:
    """(topic, payload) rows to append beside the facts."""
    return df.select(F.lit(topic).alias("topic"), F.to_json(F.struct(*columns)).alias("payload"))
