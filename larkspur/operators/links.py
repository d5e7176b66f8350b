"""Links: those of pages and of markdown files that lead nowhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def is_external(link: Column) -> Column:
    """Anchors, mail and other sites: not for checking here."""
    return link.rlike("^(#|mailto:)") | (link.rlike("^https?://") & ~F.contains(link, F.lit("/blob/")))


def markdown_links(text: Column) -> Column:
    """Targets of markdown links, without what follows a #."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), lambda x: x)


def read_markdown(spark: SparkSession, root: str, skipped: Iterable[str] = (".git", ".venv", "node_modules", "__pycache__", ".pytest_cache", "site")) -> DataFrame:
    """(path, text) of the .md files below a folder, but for those in the folders skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    inside = F.lit(False)
    for name in skipped:
        inside = inside | F.contains("path", F.lit(f"/{name}/"))
    return files.where(~inside).select("path", F.decode("content", "UTF-8").alias("text"))


def _resolved(path: Column, link: Column) -> Column:
    """The path that a link from a file leads to: dots and parents worked out."""
    joined = F.when(F.startswith(link, F.lit("/")), link).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), link))
    parts = F.split(F.regexp_replace(joined, "^file:/+", "/"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == ".") | (p == ""), acc).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def broken_markdown_links(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, link) of links to files that aren't there; `existing` has the paths that are. Folders count where a file lies in them."""
    links = files.select("path", F.explode(markdown_links(F.col("text"))).alias("link")).where(~is_external(F.col("link")))
    wanted = links.withColumn("target", _resolved(F.col("path"), F.split_part("link", F.lit("#"), F.lit(1))))
    plain = F.regexp_replace("path", "^file:/+", "/")
    parts = F.split(plain, "/")
    there = existing.select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("target")).distinct()
    return wanted.join(there, "target", "left_anti").select("path", "link")


def broken_wiki_links(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, link) of links to repository files (…/blob/<branch>/<path>) or pages (by name) that aren't there; `blobs` has the repository's paths."""
    links = files.select("path", F.explode(markdown_links(F.col("text"))).alias("link"))
    blob = links.withColumn("target", F.regexp_extract("link", r"/blob/[^/]+/([^#)\s]+)", 1)).where("target <> ''")
    gone = blob.join(blobs.select(F.col("path").alias("target")), "target", "left_anti")
    page = links.where(~is_external(F.col("link")) & ~F.contains("link", F.lit("/"))).withColumn("target", F.split_part("link", F.lit("#"), F.lit(1)))
    stems = files.select(F.regexp_extract("path", r"([^/]*?)(\.md)?$", 1).alias("target"))
    return gone.unionByName(page.withColumn("target", F.regexp_replace("target", r"\.md$", "")).join(stems, "target", "left_anti")).select("path", "link")


def broken_page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): local links of pages for which no page of any host has the path."""
    links = pages.select("page_id", F.explode(hrefs(F.col("html"))).alias("link")).where("link LIKE '/%'").distinct()
    paths = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)).alias("link")).distinct()
    return links.join(paths, "link", "left_anti").select("page_id", "link")
