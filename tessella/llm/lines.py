"""Line dedup by site-relative frequency, in DataFrame functions only.

A page is a distinct text of a host: exact copies of a page count once, so that
copying a page does not turn its content into boilerplate. For each line, cut of
blanks at both ends, the pages of the host that contain it are divided by the
host's pages; lines above the ratio, on at least ``least_pages`` pages, go.

Defined results: null and empty texts pass, as do blank lines; a null host is a
host of its own (a host named by the character 0 alone is that one too); a page that consists of boilerplate alone stays whole, since its
host cannot tell boilerplate from a page copied with small changes (the near
dedup decides on it); repeated rows and extra columns pass, but for columns named
n_lines and n_dropped, which are replaced; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO, LEAST_PAGES = 0.1, 5
#: A table of boilerplate, or of hosts, up to this size is broadcast; beyond, hosts are salted so often.
BROADCAST_BYTES, SALTS = 8 << 20, 32


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """(h, bad): hashes of each host's boilerplate lines; at most lines-a-page / ratio of them for a host."""
    named = pages.select(F.coalesce(F.col(host), F.lit("\0")).alias("h"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    hashed = named.select("h", F.xxhash64("t").alias("page"), F.array_distinct(F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), _key)).alias("lines"))
    totals = common.staged(hashed.select("h", "page").distinct().groupBy("h").agg(F.count("*").alias("pages")), "hosts")
    seen = hashed.select("h", "page", F.explode("lines").alias("line")).distinct()
    counts = seen.groupBy("h", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    if common.stored_bytes(totals) <= broadcast:
        both = counts.join(F.broadcast(totals), "h")
    else:  # a host's lines are dealt over SALTS tasks
        both = counts.withColumn("_line_salt", F.pmod("line", F.lit(SALTS))).join(totals.withColumn("_line_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["h", "_line_salt"])
    over = both.where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("h").agg(F.sort_array(F.collect_list("line")).alias("bad"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """pages with cleaned text, and n_lines and n_dropped."""
    bad = common.staged(boilerplate(pages, host, text, ratio, least_pages, broadcast), "boilerplate")
    own = pages.withColumn("_line_h", F.coalesce(F.col(host), F.lit("\0")))
    bad = bad.withColumnsRenamed({"h": "_line_h", "bad": "_line_bad"})
    bad._staged_path = None
    if _size(bad) <= broadcast:
        own = own.join(F.broadcast(bad), "_line_h", "left")
    else:
        own = own.withColumn("_line_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        bad = bad.withColumn("_line_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.join(bad, ["_line_h", "_line_salt"], "left").drop("_line_salt")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_line_bad"), _key(x)))
    own = own.withColumn("_line_kept", F.when(F.col("_line_bad").isNotNull(), kept).otherwise(split))
    full = F.exists("_line_kept", lambda x: F.trim(x) != "")
    own = own.withColumn("_line_kept", F.when(full, F.col("_line_kept")).otherwise(split))
    out = own.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(split) - F.size("_line_kept"), F.lit(0)).cast("long"))
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_line_kept", "\n")).otherwise(F.col(text)))
    return out.select(*(c for c in pages.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


def _size(bad: DataFrame) -> int:
    # 8 bytes a line and the host's name; counted, not estimated.
    return bad.agg(F.sum(F.lit(8) * F.size("_line_bad") + F.length("_line_h") + 40)).first()[0] or 0


#: The same on documents, with source as host, in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS h, text FROM documents),
p AS (SELECT h, count(DISTINCT text) AS pages FROM d GROUP BY h),
l AS (SELECT DISTINCT h, text, trim(x, ' ') AS line FROM (SELECT h, text, unnest(string_split(text, chr(10))) AS x FROM d WHERE text IS NOT NULL) WHERE trim(x, ' ') <> ''),
c AS (SELECT h, line, count(*) AS n FROM l GROUP BY h, line),
b AS (SELECT h, list(line) AS bad FROM c JOIN p USING (h) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY h),
k AS (SELECT doc_id, text, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(bad, []), trim(x, ' '))) AS f FROM d LEFT JOIN b USING (h)),
r AS (SELECT doc_id, text, a, CASE WHEN len(list_filter(f, lambda x: trim(x, ' ') <> '')) > 0 THEN f ELSE a END AS f FROM k)
SELECT doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(a) - len(f), 0) AS BIGINT) AS n_dropped,
  CAST(length(array_to_string(f, chr(10))) AS BIGINT) AS n_chars, md5(array_to_string(f, chr(10))) AS text_md5
FROM r
"""
