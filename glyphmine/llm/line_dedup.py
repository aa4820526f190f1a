"""Boilerplate lines of web sites: lines on a large share of a host's pages are dropped.

All of it is DataFrame algebra. Only (host, 128-bit hash of a line) pairs are shuffled, counted before the exchange; a host's
boilerplate is bounded by its average lines a page over the ratio, so it is joined back as one row a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line goes if it is on more than this share of its host's pages ...
RATIO = 0.3
#: ... and on at least this many of them: a line that no other page has isn't repeated, whatever its share.
LEAST_PAGES = 2
#: A host is hot if it has more than one in ``HOT`` of all pages; its pages meet its boilerplate in ``SPREAD`` parts.
HOT, SPREAD = 1000, 256

#: What separates lines of HTML: scripts, styles and comments as a whole, any tag, and line ends.
_BREAK = r"(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>|[\r\n]+"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The trimmed, non-empty lines of HTML or plain text."""
    return F.filter(F.transform(F.split(html, _BREAK), lambda x: F.trim(x)), lambda x: x != "")


def _mark(line: Column) -> Column:
    """What stands for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def drop_boilerplate(df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, clean) for each page; ``clean`` has the lines that stay, joined by line ends.

    A page counts once for a line however often it has it. Pages without a host (a null or odd URL) are one site
    named ''. A null text has no lines and a null ``clean``; an empty one has no lines and an empty ``clean``.
    Repeated rows are pages of their own. A line on exactly ``ratio`` of the pages stays. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    pages = df.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(text_col).cast("string")).alias("line_list"))
    total = df.select(host_of(F.col(url_col)).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    # hosts of more than a thousandth of all pages are fewer than a thousand, however much there is: their rows are spread
    hot = F.broadcast(total.crossJoin(F.broadcast(total.agg(F.sum("pages").alias("every")))).where(F.col("pages") > F.col("every") / HOT).select("host", F.col("pages").alias("hot_pages")))
    seen = pages.select("host", F.explode(F.transform(F.array_distinct("line_list"), _mark)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    seen = seen.join(hot, "host", "left").where(F.col("hot_pages").isNull() | (F.col("n") > F.lit(ratio) * F.col("hot_pages"))).drop("hot_pages")
    common = seen.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("common"))
    parts = F.when(F.col("hot_pages").isNull(), 0).otherwise(SPREAD - 1)
    common = common.join(hot, "host", "left").select("host", "common", F.explode(F.sequence(F.lit(0), parts)).alias("part"))
    salt = F.when(F.col("hot_pages").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "line_list"), F.lit(SPREAD))).cast("int")
    both = pages.join(hot, "host", "left").select("page_id", "host", "line_list", salt.alias("part")).join(common, ["host", "part"], "left").withColumn("stay", F.when(F.col("common").isNull(), F.col("line_list")).otherwise(F.filter("line_list", lambda x: ~F.array_contains(F.col("common"), _mark(x)))))
    n = F.coalesce(F.size("line_list"), F.lit(0))
    return both.select("page_id", "host", F.when(F.col("line_list").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col("line_list").isNull(), 0).otherwise(n - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("clean"))


def boilerplate_sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """DuckDB SQL for ``drop_boilerplate`` over ``pages``."""
    return rf"""
WITH p AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
         list_filter(list_transform(string_split_regex(html, '{_BREAK}'), lambda x: trim(x)), lambda x: x <> '') AS line_list
  FROM pages),
total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(line_list)) AS line FROM p) GROUP BY host, line),
common AS (SELECT seen.host, list(line) AS common FROM seen JOIN total USING (host) WHERE n >= {least_pages} AND n > CAST({ratio} AS DOUBLE) * pages GROUP BY seen.host),
both_ AS (SELECT p.*, CASE WHEN common IS NULL THEN line_list ELSE list_filter(line_list, lambda x: NOT list_contains(common, x)) END AS stay FROM p LEFT JOIN common USING (host))
SELECT page_id, host, coalesce(len(line_list), 0) AS n_lines, coalesce(len(line_list) - len(stay), 0) AS n_dropped,
       CASE WHEN stay IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS clean
FROM both_
"""
