"""News feeds: RSS 2.0 and Atom, a row an item, from landed files or from texts in a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrow, text as X, values as V

#: The feeds known by name.
CATALOGUE: Mapping[str, str] = {"espn": "espn/*.xml", "cbs": "cbs/*.xml", "yahoo": "yahoo/*.xml", "r/nba": "reddit/*.xml"}


def _blank_to_null(name: str):
    return F.nullif(X.stripped(F.col(name)), F.lit(""))


def rss_items(raw: DataFrame, source: str) -> DataFrame:
    """Articles of RSS items (schema RSS_ITEM, and pos). Items without guid, title, link or a readable date are left out, one by one."""
    creator = _blank_to_null("`dc:creator`") if "dc:creator" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(F.concat(F.lit(source + ":"), _blank_to_null("guid")).alias("article_id"), _blank_to_null("title").alias("title"), _blank_to_null("link").alias("url"), F.coalesce(_blank_to_null("description"), F.lit("")).alias("summary"), X.rfc822(_blank_to_null("pubDate")).alias("published_at"), creator.alias("author"), F.lit(source).alias("source"), "pos")
    return rows.where("article_id IS NOT NULL AND title IS NOT NULL AND url IS NOT NULL AND published_at IS NOT NULL")


def atom_entries(raw: DataFrame, source: str) -> DataFrame:
    """Articles of Atom entries (schema ATOM_ENTRY, and pos): `updated` before `published`, the first link, and a summary only if it says something."""
    visible = F.regexp_replace(arrow.html_text(F.col("content")), V.SUBMITTED_BY, "")
    summary = F.when(F.length(X.collapsed(visible)) >= V.MIN_SUMMARY_CHARS, X.collapsed(visible)).otherwise("")
    rows = raw.select(F.concat(F.lit(source + ":"), _blank_to_null("id")).alias("article_id"), _blank_to_null("title").alias("title"), F.nullif(X.stripped(F.try_element_at("link", F.lit(1))["_href"]), F.lit("")).alias("url"), F.coalesce(summary, F.lit("")).alias("summary"), X.rfc822(F.coalesce(_blank_to_null("updated"), _blank_to_null("published"))).alias("published_at"), _blank_to_null("author.name").alias("author"), F.lit(source).alias("source"), "pos")
    return rows.where("article_id IS NOT NULL AND title IS NOT NULL AND url IS NOT NULL AND published_at IS NOT NULL")


def parse_feed(texts: DataFrame, source: str, column: str = "xml") -> DataFrame:
    """Articles of whole feed documents: RSS items, or Atom entries where a document has no item. pos is the place within the document."""
    rss = "channel struct<item: array<struct<guid: string, title: string, link: string, description: string, pubDate: string, `dc:creator`: string>>>"
    atom = "entry array<struct<id: string, title: string, updated: string, published: string, link: array<struct<_href: string>>, author: struct<name: string>, content: string>>"
    bare = F.regexp_replace(F.col(column), r"<(/?)(guid|content)(\s[^>]*)?>", "<$1$2>")  # attributes of plain-text elements are not read
    items = texts.select(F.posexplode(F.from_xml(bare, rss)["channel"]["item"]).alias("pos", "item")).select("item.*", F.col("pos").cast("long"))
    entries = texts.where(~F.contains(F.col(column), F.lit("<item"))).select(F.posexplode(F.from_xml(bare, atom)["entry"]).alias("pos", "entry")).select("entry.*", F.col("pos").cast("long"))
    return rss_items(items, source).unionByName(atom_entries(entries, source))


def read_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A landed feed, in the encoding that a byte order mark or the prolog names; UTF-8 where neither does or where it is not known."""
    return parse_feed(spark.read.format("binaryFile").load(path).select(decoded(F.col("content")).alias("xml")), source)


def decoded(content: Column) -> Column:
    """Text of an XML document's bytes."""
    start = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    told = F.upper(F.regexp_extract(start, r"""^[^<]*<\?xml[^>]*?encoding\s*=\s*["']([^"']+)["']""", 1))
    wide = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    latin = told.isin("ISO-8859-1", "LATIN1", "LATIN-1", "ISO8859-1", "US-ASCII")
    return F.when(wide, F.decode(content, "UTF-16")).when(latin, F.decode(content, "ISO-8859-1")).otherwise(F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", ""))


def fetch_all(spark: SparkSession, folder: str, names=V.FEEDS, catalogue: Mapping[str, str] = CATALOGUE) -> tuple[DataFrame, list[str]]:
    """All feeds, one after another in catalogue order, and the names of those that could not be read."""
    unknown = [n for n in names if n not in catalogue]
    if unknown:
        raise ValueError(f"unknown feed: {', '.join(unknown)}")
    found, failed = None, []
    for place, name in enumerate(names):
        try:
            feed = read_feed(spark, f"{folder}/{catalogue[name]}", name).withColumn("pos", F.col("pos") + (place << 32))
            feed.schema  # an unreadable path shows here
        except AnalysisException:  # one source's failure is a line in the report, not the end of the run
            failed.append(name)
            continue
        found = feed if found is None else found.unionByName(feed)
    from ..schemas import ARTICLE

    return (spark.createDataFrame([], ARTICLE) if found is None else found), failed
