"""Operator 1: benchmark items in documents, by SimHash of item-sized windows.

Windows have the size of an item; a document smaller than that is one window. Only windows that can reach the similarity are
fingerprinted: those in which enough runs of words occur in some item of that size. Their
64-bit SimHash is looked up by blocks: fingerprints within ``RADIUS`` bits differ in at
most ``FLIPS`` bits of one of ``BLOCKS`` blocks, and items are listed under every
value that near, so the lookup by equal block values finds all of them.
Candidates are verified by the similarity of the weighted runs: shared
occurrences over all occurrences. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept, table, whole_text

WORDS = 5
SIMILARITY = 0.8
#: Bits of a block, low to high.
BLOCKS = (11, 11, 11, 11, 10, 10)
FLIPS = 2
#: Guaranteed: beyond it every block differs in more than ``FLIPS`` bits. At a similarity of 0.8 the
#: fingerprints of two windows differ in 9.7 bits in the mean, and in over 17 once in 300 pairs.
RADIUS = (FLIPS + 1) * len(BLOCKS) - 1
#: Runs of all items up to which they are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_RUNS = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def runs_of(words: Column, size: Column | int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(words) >= size, F.transform(
        F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.slice(words, i + 1, size))
    )).otherwise(F.array().cast("array<bigint>"))


def simhash(runs: Column) -> Column:
    """For every bit, whether it is set in more than half of the hashes."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(runs, F.lit(0).cast("long"), lambda n, h: n + F.call_function(
            "shiftrightunsigned", h, b).bitwiseAND(F.lit(1)))
        return F.when(2 * ones > F.size(runs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(
            F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"),
                       lambda x, y: x.bitwiseOR(y))


def _blocks() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    return [(sum(BLOCKS[:i]), width) for i, width in enumerate(BLOCKS)]


def _block_values(fingerprint: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, at).bitwiseAND(
        F.lit((1 << width) - 1)).alias("value")) for i, (at, width) in enumerate(_blocks())))


def _near_values(fingerprint: Column) -> Column:
    """All block values within ``FLIPS`` bits of the fingerprint's."""
    def near(i: int, at: int, width: int) -> Column:
        masks = [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(
            F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))
    return F.concat(*(near(i, at, width) for i, (at, width) in enumerate(_blocks())))


def shared_runs(a: Column, b: Column) -> Column:
    """Occurrences that two lists of hashes share."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda x, g: F.size(F.filter(x, lambda h: h == g))
    weighted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighted)


def find_items(docs: DataFrame, items: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Documents with a window that is an item: ``doc_id``, ``item_id``, ``similarity``, ``first_word``, ``n_words``,
    and ``content``, a hash of the text.

    One row per document and item, with the best window, the first of equals. A document of fewer runs
    than the item is its one window; ``n_words`` are the window's.
    Items of fewer than ``words`` words are one run of all their words. Null
    or wordless texts of either table match nothing; items that repeat an id and a text count once,
    as do rows of ``docs``; a null id of either is an id like any other. Other columns are ignored.
    """
    k = F.least(F.size("words"), F.lit(words))
    wanted = Kept(
        items.select(F.col("item_id").cast("long"), words_of(whole_text()).alias("words")).distinct()
        .filter(F.size("words") > 0)
        .select("item_id", F.size("words").alias("n"), k.alias("k"), runs_of(F.col("words"), k).alias("item_runs"))
        .withColumn("m", F.size("item_runs"))
        .withColumn("fingerprint", simhash(F.col("item_runs"))), "items")
    runs = Kept(wanted.df.select("k", "n", "m", F.explode("item_runs").alias("run")).distinct(), "item-runs")
    few = runs.df.count() <= BROADCAST_RUNS
    sizes = [r.k for r in wanted.df.select("k").distinct().collect()]  # 1 to ``words``

    docs = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    docs = docs.withColumn("content", F.xxhash64("text"))
    key = ["doc_id", "content"]
    hits = []
    # "Outer" explodes are on purpose: for others Spark infers a filter on the array's size, pushes it down to
    # the scan and computes the runs twice, splitting the text anew for each.
    for size in sizes:
        mine = runs.df.filter(F.col("k") == size)
        hits.append(
            docs.select(*key, words_of(F.col("text")).alias("words"))
            .select(*key, runs_of(F.col("words"), size).alias("runs"))
            .select(*key, F.size("runs").alias("total"), F.posexplode_outer("runs").alias("at", "run"))
            .join(F.broadcast(mine) if few else mine, "run").drop("run"))
    if not hits:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, similarity double, first_word long, n_words long, content long")
    places = reduce(DataFrame.unionByName, hits).groupBy(*key, "k", "n", "m").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_set("at")).alias("at")).withColumn(
        "width", F.least("m", "total")).withColumn(
        # shared / (m + width - shared) >= similarity
        "need", F.ceil((F.col("m") + F.col("width")) * (similarity / (1 + similarity)) - 1e-9).cast("int"))
    # Starts of windows with enough such runs: the first and the last of ``need`` of them lie in the window.
    starts = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("at") - F.col("need")),
        lambda i: F.filter(F.sequence(
            F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("width") + 1),
            F.greatest(F.get("at", i), F.get("at", i + F.col("need") - 1) - F.col("width") + 1)),
            lambda s: (s <= F.get("at", i)) & (s + F.col("width") <= F.col("total"))))))
    windows = Kept(places.filter(F.size("at") >= F.col("need")).select(
        *key, "k", "n", "m", F.explode(starts).alias("start")), "windows")
    # The runs of the windows, from the texts of the documents that have some.
    named = windows.df.groupBy(*key).agg(F.collect_set("k").alias("sizes"))
    named = Kept(named, "window-docs")
    again = (
        docs.withColumnRenamed("doc_id", "__doc").withColumnRenamed("content", "__content")
        .join(named.df, F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__content") == F.col("content")))
        .select(*key, words_of(F.col("text")).alias("words"), F.explode("sizes").alias("k"))
        .select(*key, "k", runs_of(F.col("words"), F.col("k")).alias("runs")))
    filled = windows.df.withColumnsRenamed({"doc_id": "__doc", "content": "__content", "k": "__k"}).join(
        again, F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__content") == F.col("content"))
        & (F.col("__k") == F.col("k")))
    prints = Kept(filled.select(*key, "k", "n", "start", F.slice("runs", F.col("start") + 1, F.col("m")).alias("runs"))
                  .distinct().withColumn("fingerprint", simhash(F.col("runs"))), "fingerprints")
    probes = wanted.df.select("item_id", "n", "item_runs", F.explode(_near_values(F.col("fingerprint"))).alias("b")).select(
        "item_id", "n", "b.block", "b.value", F.xxhash64("item_runs").alias("item"))
    looked = (
        prints.df.select(*key, "n", "start", F.explode(_block_values(F.col("fingerprint"))).alias("b"))
        .select(*key, "n", "start", "b.block", "b.value").join(probes, ["n", "block", "value"])
        .select(*key, "n", "start", "item_id", "item").distinct())
    both = Kept(looked, "candidates").df.alias("c")
    text = prints.df.select(*(F.col(c).alias(f"p_{c}") for c in (*key, "n", "start")), "runs")
    about = wanted.df.select(F.col("item_id").alias("w_item"), F.xxhash64("item_runs").alias("w_hash"), "item_runs", "m")
    pairs = both.join(text, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("content") == F.col("p_content"))
                      & (F.col("c.n") == F.col("p_n")) & (F.col("c.start") == F.col("p_start"))).join(
        about, F.col("item_id").eqNullSafe(F.col("w_item")) & (F.col("item") == F.col("w_hash")))
    shared = shared_runs(F.col("runs"), F.col("item_runs"))
    scored = pairs.select("doc_id", "content", "item_id", F.col("c.n").alias("n"), F.col("c.start").alias("start"), "m",
                          F.size("runs").alias("width"), shared.alias("shared")).withColumn(
        "similarity", F.col("shared") / (F.col("m") + F.col("width") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    return scored.groupBy("doc_id", "content", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), (F.col("width") + F.least("n", F.lit(words)) - 1).alias("n"))).alias("best")).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.back")).cast("long").alias("first_word"),
        F.col("best.n").cast("long").alias("n_words"), "content")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    found = find_items(docs, items).select(
        F.col("doc_id").alias("__doc"), F.col("content").alias("__found")).distinct()
    # Few rows as a rule, so that Spark can broadcast them instead of moving texts.
    found = Kept(found, "contaminated").df
    return docs.withColumn("__content", F.xxhash64(whole_text())).join(
        found, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__content") == F.col("__found")), "left_anti"
    ).drop("__content")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("content")


OP1_SQL = f"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w
  FROM benchmark),
ig AS (
  SELECT item_id, len(w) AS n, least(len(w), {WORDS}) AS k, len(w) - least(len(w), {WORDS}) + 1 AS m,
         array_to_string(w[i:i + least(len(w), {WORDS}) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WORDS}) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, k, i - 1 AS pos, len(w) - k + 1 AS total, array_to_string(w[i:i + k - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)),
ic AS (SELECT item_id, n, k, m, run, count(*) AS c FROM ig GROUP BY ALL),
starts AS (
  SELECT DISTINCT doc_id, item_id, k, n, m, width,
    unnest(range(greatest(0, pos - width + 1), least(pos, total - width) + 1)) AS start
  FROM (SELECT *, least(m, total) AS width FROM dg JOIN ic USING (k, run))),
wc AS (
  SELECT s.doc_id, s.item_id, s.k, s.n, s.m, s.width, s.start, d.run, count(*) AS c
  FROM starts s JOIN dg d ON d.doc_id = s.doc_id AND d.k = s.k AND d.pos >= s.start AND d.pos < s.start + s.width
  GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, wc.width + least(wc.n, {WORDS}) - 1 AS n, start, sum(least(wc.c, ic.c)) AS shared,
    any_value(wc.m + wc.width) AS both_runs
  FROM wc JOIN ic USING (item_id, run) GROUP BY ALL),
good AS (
  SELECT *, shared / (both_runs - shared) AS similarity FROM scored WHERE shared / (both_runs - shared) >= {SIMILARITY}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place FROM good)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start AS BIGINT) AS first_word,
       CAST(n AS BIGINT) AS n_words
FROM ranked WHERE place = 1
"""
