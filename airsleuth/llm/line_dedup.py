"""Operator 8: dropping boilerplate lines by their frequency within a site.

A line is boilerplate of a host if the host's pages prove that more than a given share of
its pages contain it: the pages at hand are taken for a sample, and their number must be more
deviations above the share than chance brings. Counting moves hashes only, aggregated
before the shuffle; the lines to drop are at most (lines of a page / share) for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept, table, whole_text

#: A line is dropped if more than this share of the host's pages contain it, one page in twenty,
RATIO = 0.05
#: by so many standard deviations of a count of pages that each contain it with that chance,
SIGMAS = 2.0
#: and at least so many pages: a few copies on a small host are no boilerplate. Hosts of fewer pages keep all lines.
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def _proven(count: Column, total: Column, ratio: float, sigmas: float) -> Column:
    """Whether ``count`` of ``total`` pages is more than ``sigmas`` deviations above the share."""
    above = count - ratio * total
    return (above > 0) & (above * above > sigmas * sigmas * ratio * (1 - ratio) * total)


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                sigmas: float = SIGMAS) -> DataFrame:
    """Hosts with the hashes of their boilerplate lines: ``host``, ``dropped``."""
    site = F.coalesce(F.col(host).cast("string"), F.lit("\0"))
    # Hash 0 stands for the page itself, so that one aggregate counts pages and lines.
    hashes = F.transform(F.filter(F.array_distinct(_lines(whole_text())), lambda x: ~_is_blank(x)), lambda x: F.xxhash64(x))
    counts = (
        pages.select(site.alias("host"), F.explode(F.concat(F.array(F.lit(0).cast("long")), hashes)).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    )
    kept = Kept(counts, "lines")
    totals = kept.df.filter("line = 0").select("host", F.col("pages").alias("total"))
    found = (kept.df.filter("line <> 0").join(totals, "host").filter(_proven(F.col("pages"), F.col("total"), ratio, sigmas))
             .groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("dropped")))
    result = Kept(found, "boilerplate")
    kept.free()
    return result.df


def drop_boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, sigmas: float = SIGMAS) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` beside it.

    Lines end with a line feed; blank ones are never dropped and keep their place.
    A null text counts as empty, a null host is a host of its own. A page counts
    once for a line that it repeats; all its copies of a dropped line go. Rows are
    never dropped: a page of nothing but boilerplate keeps an empty text. Columns
    named ``n_lines`` or ``n_dropped`` are replaced.
    """
    found = boilerplate(pages, host, ratio, min_pages, sigmas).select(
        F.col("host").alias("__host"), F.col("dropped").alias("__dropped"))
    lines, dropped = _lines(whole_text()), F.col("__dropped")
    # The table of hosts is read from files of a known size: Spark broadcasts it only if it is small.
    left = pages.withColumn("__site", F.coalesce(F.col(host).cast("string"), F.lit("\0"))).join(
        found, F.col("__site") == F.col("__host"), "left")
    rest = F.when(dropped.isNull(), lines).otherwise(
        F.filter(lines, lambda x: _is_blank(x) | ~F.array_contains(dropped, F.xxhash64(x))))
    return (
        left.withColumn("__rest", rest)
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", (F.size(lines) - F.size("__rest")).cast("long"))
        .withColumn("text", F.array_join("__rest", "\n"))
        .drop("__host", "__dropped", "__site", "__rest")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "n_lines", "n_dropped", "text")


OP8_SQL = f"""
WITH pages AS (
  SELECT doc_id, source, coalesce(source, chr(1)) AS host, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
counts AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages)
  WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY ALL),
dropped AS (
  SELECT host, list(line) AS gone FROM counts JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * total
    AND (n - {RATIO}::DOUBLE * total) * (n - {RATIO}::DOUBLE * total) > {SIGMAS * SIGMAS * RATIO * (1 - RATIO)}::DOUBLE * total
  GROUP BY ALL),
rest AS (
  SELECT doc_id, source, lines, CASE WHEN gone IS NULL THEN lines
    ELSE [x for x in lines if NOT list_contains(gone, x)] END AS kept
  FROM pages LEFT JOIN dropped USING (host))
SELECT doc_id, source, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM rest
"""
