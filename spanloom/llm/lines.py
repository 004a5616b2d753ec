"""Boilerplate lines of web pages by their frequency within the site, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of a site's line list that its pages are dealt over.
SALTS = 32
#: Tags that end a line of a page; all other tags count as none.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
SPACE = r"[ \t\n\r\x0b\x0c]+"


def host(url: Column) -> Column:
    """The lower-case host of a URL without user and port; '' where there is none or the URL is null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_lines(html: Column) -> Column:
    """The lines of visible text of a page: scripts, styles, comments and tags removed, spaces joined, no empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.filter(lines, lambda x: x != "")


def site_lines(pages: DataFrame, ratio: float = 0.5, min_pages: int = 3) -> DataFrame:
    """host and `boilerplate`: hashes of the lines on more than `ratio` of the host's pages and on `min_pages` at least.

    pages has host and lines. A line counts once for each page. Lines are summed by (host, two hashes of the
    line), with sums before the shuffle. A host's list holds fewer than its mean lines a page / ratio entries.
    """
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("__pages"))
    each = pages.select("host", F.explode(F.transform(F.array_distinct("lines"), line_id)).alias("__line"))
    counts = each.groupBy("host", "__line").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_pages)
    often = counts.join(totals, "host").filter(F.col("__n") > F.col("__pages") * F.lit(float(ratio)))
    return often.groupBy("host").agg(F.collect_set("__line").alias("boilerplate"))


def line_id(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.crc32(F.encode(line, "UTF-8")).alias("b"))


def dedup_lines(pages: DataFrame, ratio: float = 0.5, min_pages: int = 3, salts: int = SALTS) -> DataFrame:
    """Pages without the boilerplate lines of their sites.

    Returns page_id, host, n_lines, n_kept and text (the lines that stay, in their order, joined by newlines).
    Pages without a host form a site of their own, named ''. A null or empty page has no lines and text ''.
    Repeated rows count as pages each; long pages are read whole; an empty table gives an empty one. Extra columns are not read. A site with few pages keeps all its lines, as
    a line must be on `min_pages` pages. Only the lists of sites that have boilerplate are joined; each is
    copied for `salts` parts of the site's pages, so that a large site does not meet in one task.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    lists = site_lines(rows, ratio, min_pages)
    lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(salts)).cast("int"))
    joined = salted.join(lists, ["host", "__salt"], "left")
    keep = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("boilerplate"), line_id(x)), F.lit(False)))
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(keep)
    out = joined.withColumn("__kept", kept)
    return out.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("__kept").cast("long").alias("n_kept"), F.array_join("__kept", "\n").alias("text")
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
        '(?i)</?(?:BLOCKS)\b[^>]*>', chr(10), 'g'),
        '<[^>]*>', '', 'g'), chr(10)),
      lambda x: trim(regexp_replace(x, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))), lambda x: x <> '') AS lines,
    row_number() OVER () AS r
  FROM pages),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
b AS (SELECT c.host, c.line FROM c JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t USING (host)
      WHERE n >= 3 AND n > pages * 0.5),
l AS (SELECT r, p.host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM p),
k AS (SELECT r, count(*) AS n_kept, string_agg(l.line, chr(10) ORDER BY i) AS text
      FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line WHERE b.line IS NULL GROUP BY r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, coalesce(text, '') AS text
FROM p LEFT JOIN k USING (r)
""".replace("BLOCKS", BLOCKS)
