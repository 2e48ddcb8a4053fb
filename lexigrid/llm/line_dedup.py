"""Boilerplate lines by their frequency within a site.

A page's lines are the texts between block-level tags and line ends. For each host, the pages that contain a line are
divided by the host's pages; lines whose share exceeds `ratio` are boilerplate and go from every page of that host, whatever its
number of pages: where that is under 1 / ratio, all lines do. least_pages, 1 unless given, spares lines on fewer pages. A host has at most (mean lines a page) / ratio such lines, so they travel as one
small array a host; nothing else of a host is ever gathered.

Lines count once a page and are named by their md5 (128 bits). Nulls: a null or odd url has the host '' and a null
html no lines. Repeated rows are pages of their own. Empty tables give empty results; other columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import hot_salts, salted_join, written

#: Elements whose content is not text, and tags that end a line.
UNSEEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>"
BREAKS = r"(?i)<(/?(p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|table|tr|td|th|title|head|body|html|blockquote|pre|form|main|aside)|br)\b[^>]*>"


def host(url: Column) -> Column:
    """The host of a url, without user and port, in lower case; an address in brackets with them."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), F.lit("")))


def lines(html: Column) -> Column:
    """Trimmed lines of a page's text that are not empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), "<[^>]*>", "")
    split = F.transform(F.split(text, "[\n\r]+"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.filter(split, lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """host and names: the md5 of its boilerplate lines. pages: host and names of all lines."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode(F.array_distinct("names")).alias("name")).groupBy("host", "name").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= least_pages).join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("name").alias("boilerplate"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.1, least_pages: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, lines and kept (the lines that stay, in order)."""
    cut = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), lines(F.col(html_col)).alias("lines"))
    cut = written(cut.withColumn("names", F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary"))))), "lines")
    sites = boilerplate(cut.select("host", "names"), ratio, least_pages)
    # A hot host's pages are dealt over as many tasks as its number of pages asks for.
    hot, _ = hot_salts(cut.groupBy("host").agg(F.count("*").alias("pages")), "host", "pages")
    spread = F.struct("page_id", F.hash("names").alias("names"))
    joined = salted_join(cut, sites, hot, "host", spread, "left").withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<binary>")))
    pairs = F.arrays_zip("lines", "names")
    kept = F.transform(F.filter(pairs, lambda x: ~F.array_contains(F.col("boilerplate"), x["names"])), lambda x: x["lines"])
    return joined.select("page_id", "host", "lines", F.when(F.size("boilerplate") == 0, F.col("lines")).otherwise(kept).alias("kept"))


def report(cleaned: DataFrame) -> DataFrame:
    """Numbers of lines, and a digest of the text that stays."""
    return cleaned.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.md5(F.concat_ws("\n", "kept").cast("binary")).alias("kept_md5")
    )
