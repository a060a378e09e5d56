"""Operator 12: which filter removes what, under every order of five filters.

A document's outcome under all 120 orders depends only on its mask, the set of filters
that it fails. So each mask maps to one big integer with a field for every step of every order (600 of them,
for each of three outcomes); adding such integers adds all counters at once.

Spark counts documents by part and mask, combined before the shuffle, so a part that holds a third of all
rows arrives as at most 128 rows. A part's integers are multiplied by these counts and added
up; a field is as wide as the largest count it could hold, so none runs over into the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept, table, whole_text

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
OUTCOMES = ("kept", "removed", "redundant")
#: Bytes of a field: counts are 64-bit, so a sum of them that fits its column fits its field.
FIELD = 8


# --- masks and integers --------------------------------------------------------------


def outcomes(mask: int) -> np.ndarray:
    """One row for each outcome, and in it 1 for each step (order by order) at which a document of this mask has it."""
    found = np.zeros((len(OUTCOMES), STEPS), "u8")
    for i, order in enumerate(ORDERS):
        gone = False
        for j, letter in enumerate(order):
            fails = bool(mask >> FILTERS.index(letter) & 1)
            at = i * len(FILTERS) + j
            found[:, at] = not (gone or fails), fails and not gone, fails and gone
            gone = gone or fails
    return found


@cache
def packed(mask: int) -> int:
    """All steps and outcomes of a mask as fields of one integer."""
    return int.from_bytes(outcomes(mask).astype(f"<u{FIELD}").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Fields of a sum of such integers: outcomes x steps."""
    size = len(OUTCOMES) * STEPS * FIELD
    return np.frombuffer(total.to_bytes(size, "little"), f"<u{FIELD}").reshape(len(OUTCOMES), STEPS).astype("i8")


def step_table(counts: pd.DataFrame) -> pd.DataFrame:
    """600 rows of counters from one part's rows of ``mask``, ``good``, ``toxic``, ``n``."""
    def total(rows: pd.DataFrame) -> np.ndarray:
        return unpacked(sum(int(n) * packed(int(mask)) for mask, n in zip(rows["mask"], rows["n"])))

    every = dict(zip(OUTCOMES, total(counts)))
    letters = [letter for order in ORDERS for letter in order]
    alone = {letter: int(counts.loc[counts["mask"] == 1 << i, "n"].sum()) for i, letter in enumerate(FILTERS)}
    removed_in_all = {letter: int(every["removed"][[x == letter for x in letters]].sum()) for letter in FILTERS}
    removed = OUTCOMES.index("removed")
    return pd.DataFrame({
        "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), **every,
        "unique_fails": [alone[x] for x in letters],
        "good_lost": total(counts[counts["good"]])[removed], "toxic_lost": total(counts[counts["toxic"]])[removed],
        "shapley": [removed_in_all[x] for x in letters], "filter": letters,
    })


# --- masks of documents --------------------------------------------------------------


def failures(text: Column) -> Sequence[Column]:
    """Whether the text alone fails the filters A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic`` and the number ``n`` of documents with them.

    E needs the smallest id of each text. Rows travel as hashes of texts (SHA-256), one for each text, id and part;
    a text's smallest id comes from an aggregate, and its row is found by text and id together, so
    that thousands of copies never meet at one key.
    """
    # A row without an id counts as larger than any with one.
    no_id = F.lit((1 << 63) - 1)
    text = whole_text()
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(failures(text))), F.lit(0))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = Kept(
        slim.select(F.unhex(F.sha2(text, 256)).alias("content"), F.coalesce("doc_id", no_id).alias("id"), "part", bits.alias("bits"))
        .groupBy("content", "id", "part", "bits").agg(F.count("*").alias("n")), "masks")
    first = rows.df.groupBy("content").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("__q"), F.col("toxic").alias("__t")).groupBy("id").agg(
        F.max(F.coalesce(F.col("__q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("__t") == 1, F.lit(False))).alias("toxic")
    ).filter("id is not null and (good or toxic)")
    marked = rows.df.join(first, ["content", "id"], "left").select(
        "id", "part", "n", (F.col("bits") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))).alias("mask"))
    # Rows without an id have no label; they are many at one key, if any, and stay out of the join.
    labelled = marked.filter(F.col("id") != no_id).join(known, "id", "left").unionByName(
        marked.filter(F.col("id") == no_id).withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    return labelled.groupBy(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost``, ``shapley`` and the step's ``filter``.

    Null texts and null parts count as empty. Every row counts, also if it repeats an id; rows of the same id are no
    copies of each other, and a row without an id is a copy of every equal text with one. A document is good or toxic
    if any of its labels says so; null labels say nothing. No documents give no rows. Other columns than ``doc_id``, ``text`` and
    ``part`` are ignored, so their names may be any.
    """
    # At most 128 rows of a part: 32 masks by two flags.
    return masks(docs, labels, part).groupBy("part").applyInPandas(
        lambda key, rows: step_table(rows).assign(part=key[0]),
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long, filter string")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
words AS (SELECT t.*, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS w, doc_id > f.first AS e FROM texts t JOIN firsts f USING (text)),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(e, false)] AS f,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (
  SELECT part, o, step, n, good, toxic, f[o[step]] AS fails, list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])) AS gone_or_null,
    list_sum(list_transform(f, lambda v: v::INT)) = 1 AS alone
  FROM counts, steps),
told AS (SELECT * EXCLUDE (gone_or_null), coalesce(gone_or_null, false) AS gone FROM met),
summed AS (
  SELECT part, o, step, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL),
named AS (SELECT *, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, 'ABCDE'[o[step]] AS filter FROM summed)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter
FROM named
"""
