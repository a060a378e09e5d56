"""Operator 7: document fingerprints from closed syncmers.

A text is a row of words. Of every ``K`` words in a row, the run is an anchor if the
smallest hash of its words is that of the first or the last. Whether a run is an anchor
depends on its own words only, so an edit elsewhere neither makes nor unmakes it. Words
too long to be words give way to their overlapping pieces of a few characters. Behind its
last word every text goes on with ``K`` - 1 ends, smaller than any word, so that the shortest
text has anchors by the same rule as the longest. A fingerprint is all anchors with
their places. Two are as alike as the share of all their anchors that both
have, in places that agree with one another. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsleuth.llm.tables import shuffle_parts, table

#: Words of a run; its inner parts are the words. Half of all runs are anchors.
K = 4
#: Anchors that are printed, those of smallest hash; all are matched.
PRINTED = 64
#: An anchor holds 39 bits of hash, then the place, then one bit that tells two texts apart when they are matched.
HASH_SHIFT, PLACE_BITS = 24, 23
#: Anchors agree if the offsets between their places in both texts lie in a window of so many words.
SLACK = 8
#: A word of more characters than this is a text without spaces: its pieces of ``PIECE`` characters, one from
#: each character on, stand for it.
LONG, PIECE = 12, 4
#: The hash of an end: no word's is smaller.
_END = -(1 << 63)


def pieces(text: Column) -> Column:
    """The overlapping pieces of a text; a shorter text is its own only one."""
    # The characters are an element of an array, so that the inner lambda does not split anew for each.
    return F.flatten(F.transform(F.array(F.split(text, "")), lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(c) - PIECE + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(c, i, PIECE), ""))))


def tokens(words: str) -> Column:
    """A column of words with the pieces of long ones in their place; depends on each word only."""
    long = lambda w: F.char_length(w) > LONG
    return F.when(F.exists(words, long), F.flatten(F.transform(
        words, lambda w: F.when(long(w), pieces(w)).otherwise(F.array(w))))).otherwise(F.col(words))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column: packed hashes and places of all anchors, smallest hash first.

    Equal texts have equal fingerprints. Of runs that repeat in a text the first counts.
    Any text with a word has an anchor; an empty or blank text has none. Places of
    ``2 ** PLACE_BITS`` words and more count as one place.
    """
    df = df.withColumn("__w", F.array_remove(F.split(text, r"\s+", -1), ""))
    df = df.withColumn("__t", tokens("__w"))
    ends = F.array_repeat(F.lit(_END), K - 1)
    df = df.withColumn("__p", F.concat(F.transform("__t", lambda w: F.xxhash64(w)), ends))
    p = lambda i: F.get("__p", i)
    top = (1 << PLACE_BITS) - 1
    # A negative number marks runs that are no anchors.
    packed = F.transform(F.slice("__p", F.lit(1), F.size("__t")), lambda x, i: F.when(
        F.least(x, p(i + 3)) <= F.least(p(i + 1), p(i + 2)),
        F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, p(i + 1), p(i + 2), p(i + 3)), HASH_SHIFT + 1), HASH_SHIFT).bitwiseOR(
            F.shiftleft(F.least(i, F.lit(top)).cast("long"), 1))).otherwise(F.lit(-1).cast("long")))
    df = df.withColumn("__a", F.sort_array(F.array_remove(packed, F.lit(-1).cast("long"))))
    same = lambda x, i: F.shiftright(x, HASH_SHIFT) == F.shiftright(F.get("__a", i - 1), HASH_SHIFT)
    return df.withColumn(out, F.filter("__a", lambda x, i: (i == 0) | ~same(x, i))).drop("__w", "__t", "__p", "__a")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with how alike two fingerprint columns are, 0 to 1; 1 for two without anchors.

    Anchors of both are sorted together, so equal hashes are neighbours. The offsets between their
    places are sorted too, and one pass finds the most that lie within ``SLACK`` words; their share of all different
    anchors is the likeness. Work and memory grow with the texts' lengths, not their product. Each
    step is a column of its own, so that no lambda computes it anew for each element.
    """
    df = df.withColumn("__m", F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1).cast("long"))))))
    none = F.lit(-(1 << 62))
    place = lambda x: F.shiftright(x.bitwiseAND(F.lit((1 << HASH_SHIFT) - 1)), 1)

    def offset(x: Column, i: Column) -> Column:
        y = F.get("__m", i + 1)
        ahead = place(y) - place(x)
        return F.when(F.shiftright(x, HASH_SHIFT) == F.shiftright(y, HASH_SHIFT), F.when(
            x.bitwiseAND(F.lit(1)) == 0, ahead).otherwise(-ahead)).otherwise(none)

    df = df.withColumn("__o", F.sort_array(F.array_remove(F.transform("__m", offset), none)))
    # The state is (offsets seen, size of the biggest window so far): a window grows by an offset or moves on by it.
    one, low = 1 << 32, (1 << 32) - 1
    most = F.aggregate("__o", F.lit(0).cast("long"), lambda s, o: s + F.lit(one) + F.when(
        o - F.get("__o", (F.shiftright(s, 32) - s.bitwiseAND(F.lit(low))).cast("int")) <= SLACK, 1).otherwise(0),
        lambda s: s.bitwiseAND(F.lit(low)))
    union = F.size("__m") - F.size("__o")
    return df.withColumn(out, F.when(union == 0, 1.0).otherwise(most / union)).drop("__m", "__o")


def as_text(anchors: str) -> Column:
    """The anchors of smallest hash, then a hash of all, which keeps texts that differ elsewhere apart."""
    few = F.concat(F.slice(anchors, 1, PRINTED), F.array(F.xxhash64(anchors)))
    return F.when(F.size(anchors) > 0, F.array_join(F.transform(few, lambda x: F.lower(F.hex(x))), "-")).otherwise("")


def with_next(docs: DataFrame, columns: list[str], then=lambda df: df, more: list[str] = []) -> DataFrame:
    """``docs`` with ``next_<column>`` from the row that follows in descending ``doc_id``; the first follows the last.

    Rows go by ranges of ids, in one shuffle; each range is joined by a copy of
    the following range's first row. Null ids come last, equal ids go by ``columns``, descending.
    ``then`` adds columns ``more`` behind that shuffle, which have a next one, too.
    """
    parts = shuffle_parts(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), 10_000).alias(
        "c")).head().c if parts > 1 else None
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts or [])))).cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda b: F.coalesce(F.col("doc_id") <= b, F.lit(True))))
    own = docs.withColumns({"__part": part, "__guest": F.lit(False)})
    # At most a row for each range: the ranges' number is that of the shuffle's partitions. Ids first, then
    # only the texts of those ids.
    tops = own.groupBy(F.col("__part").alias("__in")).agg(F.max("doc_id").alias("__top"))
    heads = own.join(F.broadcast(tops), (F.col("__part") == F.col("__in")) & F.col("doc_id").eqNullSafe(F.col("__top"))).groupBy(
        "__part").agg(F.max(F.struct("doc_id", *columns)).alias("__head"))
    order = Window.orderBy("__part")
    names = tops.select(F.col("__in").alias("__part")).withColumns({
        "__to": F.lag("__part").over(order),
        "__last": F.max("__part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    guests = heads.join(names, "__part").select(
        F.col("__head.doc_id").alias("doc_id"), *(F.col(f"__head.{c}").alias(c) for c in columns),
        F.coalesce("__to", "__last").alias("__part"), F.lit(True).alias("__guest"))
    both = then(own.unionByName(guests, allowMissingColumns=True).repartition("__part"))
    following = Window.partitionBy("__part").orderBy(
        "__guest", F.desc_nulls_last("doc_id"), *(F.desc(c) for c in columns))
    return both.withColumns({f"next_{c}": F.lead(c).over(following) for c in [*columns, *more]}).filter("not __guest").drop(
        "__part", "__guest")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """All anchors of every text and of its edited text, and how alike they are.

    The edited text has its last third replaced by the beginning of the next document's.
    Null texts count as empty. Rows that repeat are documents of their own. The only
    document is its own next one. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, ["text"], lambda df: with_anchors(df, "text", "anchors"), ["anchors"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = with_anchors(rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited", "anchors", "next_anchors"), "edited", "edited_anchors")
    rows = with_likeness(rows, "anchors", "edited_anchors", "near_edited")
    rows = with_likeness(rows, "anchors", "next_anchors", "near_next")
    return rows.select("doc_id", "n_chars", "edited", "anchors", "edited_anchors", "near_edited", "near_next")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next")
