"""Dropping boilerplate lines by their frequency on a site, in DataFrame operations only.

A page's lines are the texts between its block tags. For each host the pages that contain a line are divided by the
host's pages; lines above `max_ratio` go, if they repeat and are above it by more than chance explains (a score test, so
that one rule holds for hosts of every size: two of two pages are enough, two of twenty are not). Counting is by (host, digest of the line), combined before the shuffle, so a
line that every page has is no hot key. A host has at most (mean lines of a page) / max_ratio lines to drop: that bounds
the set of digests which joins the pages again, and pages never leave their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialised

#: Digests (32 bytes each) that are broadcast at most; beyond it the pages are joined by shuffling on their host.
BROADCAST_DIGESTS = 400_000
_HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>|head\b[^>]*>|/?html\b[^>]*>)"
_BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"
_TAG = r"<[A-Za-z/!][^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user and port; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.lower(found)


def lines_of(html: Column) -> Column:
    """The lines of a page: trimmed, white space made single, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), _TAG, "")
    for name, letter in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    text = F.regexp_replace(F.regexp_replace(text, r"[\x09\x0B-\x0D]", " "), r"\x20{2,}", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_ratio: float = 0.05, deviations: float = 1.96
) -> DataFrame:
    """One row for each row of pages: page_id, host, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A line counts once a page, and must be on two pages at least. It goes if its pages are above max_ratio of the host's by
    `deviations` standard deviations of what that ratio would give. Pages without a host keep all their lines. Null html
    has no lines. Repeated rows are pages of their own. Further columns are
    ignored; an empty table gives an empty result.
    """
    digest = lambda line: F.md5(line.cast("binary"))
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    sized = split.where("host <> ''")
    totals = sized.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    held = sized.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line"))
    counted = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = F.sqrt(F.col("pages") * max_ratio * (1 - max_ratio)) * deviations
    above = counted.join(totals, "host").where(F.col("n") - F.col("pages") * max_ratio > spread)
    drops = materialised(above.groupBy("host").agg(F.collect_list("line").alias("drops")))
    size = drops.agg(F.sum(F.size("drops"))).first()[0] or 0
    keyed = drops.select(F.col("host").alias("of"), "drops")
    joined = split.join(F.broadcast(keyed) if size <= BROADCAST_DIGESTS else keyed, F.col("host") == F.col("of"), "left")
    # By hash: a host may have many lines to drop, of which a page holds few.
    joined = joined.withColumn("own", F.array_intersect(F.transform("lines", digest), "drops"))
    kept = F.when(F.size("own") > 0, F.filter("lines", lambda x: ~F.array_contains("own", digest(x)))).otherwise(F.col("lines"))
    return joined.withColumn("kept", kept).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


ORACLE = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b[^>]*>|</?html\b[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT r, page_id, host, regexp_replace(regexp_replace(t,
    '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>',
    chr(10), 'g'), '<[A-Za-z/!][^>]*>', '', 'g') AS t FROM a),
c AS (SELECT r, page_id, host, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
d AS (SELECT r, page_id, host, list_filter(string_split(trim(
    regexp_replace(regexp_replace(t, '[\x20\x09\x0B\x0C\x0D]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' '), chr(10)), lambda x: x <> '') AS lines FROM c),
h AS (SELECT host, count(*) AS pages FROM d WHERE host <> '' GROUP BY host HAVING count(*) > 1),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM d WHERE host <> '') GROUP BY host, line),
x AS (SELECT l.host, list(line) AS drops FROM l JOIN h USING (host) WHERE n > 1 AND n - pages * 0.05::DOUBLE > sqrt(pages * 0.05::DOUBLE * (1 - 0.05::DOUBLE)) * 1.96::DOUBLE GROUP BY l.host),
k AS (SELECT page_id, d.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), x)) AS kept FROM d LEFT JOIN x USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""
