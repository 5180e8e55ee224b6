"""Line deduplication by site-relative frequency.

A page's text is cut at ``\\n``.  Lines are compared after lower-casing,
trimming and collapsing white space, by a 64-bit hash within their host.  For
each host the pages that contain a line are divided by the host's pages; lines
whose share exceeds ``ratio`` (and which are on ``min_pages`` pages at least)
are boilerplate and leave every page of that host.

A host has at most (lines of an average page) / ``ratio`` boilerplate lines, so
they travel as one array for each host: the counts are pre-aggregated map-side,
and the pages are joined to one row per host, which Spark broadcasts when the
written table is small and otherwise joins with skewed hosts split.

Defined results: a null text counts as empty; a null host is a host of its own;
lines without a word are kept and never counted; every row counts as one page,
repeated rows too; a line repeated within a page counts once and leaves
everywhere; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, Scratch, free_name, quoted, whole_text

RATIO = 0.05
MIN_PAGES = 3


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def line_key(line: Column) -> Column:
    """64-bit hash of the normalised line."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), SPACE, " ")))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, keys): the hashes of each host's boilerplate lines."""
    lines = pages.select(
        F.col(quoted(host_col)).alias("host"),
        F.array_distinct(F.transform(F.filter(F.split(whole_text(text_col), "\n"), has_word), line_key)).alias("keys"),
    )
    totals = lines.groupBy("host").agg(F.count("*").alias("pages"))
    counted = lines.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    frequent = counted.where(F.col("n") >= min_pages).join(
        totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))
    )
    return frequent.where(F.col("n") > F.col("pages") * ratio).groupBy("host").agg(F.collect_set("key").alias("keys"))


def drop_site_lines(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with cleaned text, and two columns more: lines and lines dropped.

    The counts are named n_lines and n_dropped, with underscores added where
    ``pages`` has such columns already.
    """
    host, keys = free_name(pages, "_host"), free_name(pages, "_keys")
    scratch = Scratch(pages.sparkSession, "lines")
    found = scratch.keep(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    found = found.select(F.col("host").alias(host), F.col("keys").alias(keys))
    joined = pages.join(found, F.col(quoted(host_col)).eqNullSafe(F.col(host)), "left")
    lines = F.split(whole_text(text_col), "\n")
    kept = F.filter(lines, lambda x: ~(has_word(x) & F.array_contains(F.col(keys), line_key(x))))
    rest = F.when(F.col(keys).isNull(), lines).otherwise(kept)
    before, after = free_name(pages, "n_lines"), free_name(pages, "n_dropped")
    out = joined.withColumn(before, F.size(lines).cast("long")).withColumn(keys, rest)
    out = out.withColumn(after, F.col(before) - F.size(keys)).withColumn(text_col, F.array_join(F.col(keys), "\n"))
    return out.select(*[quoted(c) for c in pages.columns], before, after)
