"""Operator 3: near-duplicate documents by MinHash with one permutation.

A document's set is its distinct runs of words. One hash of each run gives all
bins of the sketch: the smallest in each of ``BINS`` equal ranges. Empty bins are
filled from full ones in an order that depends on the bin only, which keeps the
chance that two sketches agree at the sets' similarity. Runs of ``ROWS`` bins are
the buckets' keys.

Equal sets are one node from the start, however many copies. In each bucket every
node is paired with the bucket's centre only, so pairs are fewer than bucket
entries, and each pair is verified on whole sets. A star alone could lose a link between
two nodes that are both unlike the centre. So where a bucket still holds several components,
the nodes outside its largest one are compared with all its others, in
blocks of bounded size that yield links only, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.bitmap import mark_possible
from airsleuth.llm.components import connected
from airsleuth.llm.tables import Kept, table
from airsleuth.llm.word_hashes import combine, give_back, hash_words, mix, shingles, text_chunks

BINS = 120
#: Bins of a bucket's key: 24 keys for each node. At a similarity of 0.8 all differ once in 14,000 pairs.
ROWS = 5
#: Mean nodes of the two sides of a block.
ASKING, ASKED = 256, 1024
#: Mean members of a block of a head.
MEMBERS = 256

_ORDER = np.stack([np.random.default_rng(bin_).permutation(BINS) for bin_ in range(BINS)])


def sketch(hashes: np.ndarray, bins: int = BINS, order: np.ndarray = _ORDER) -> np.ndarray:
    """Smallest hash of each bin of sorted hashes; empty bins copy the first full bin of their own order."""
    place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    out, full = np.zeros(bins, "u8"), np.zeros(bins, bool)
    out[place[first].astype("i8")] = hashes[first]
    full[place[first].astype("i8")] = True
    if len(first) < bins:
        empty = np.flatnonzero(~full)
        out[empty] = out[order[empty, full[order[empty]].argmax(axis=1)]]
    return out


def bucket_keys(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = minima.reshape(-1, rows)
    return mix(combine([bands[:, i] for i in range(rows)]) + np.arange(len(bands), dtype="u8"))


def sketches(docs: DataFrame, words: int, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``content``, ``n_shingles``, ``node`` (a hash of the whole set, null for none) and bucket ``keys``."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("n_shingles", pa.int64()),
                        ("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2), 0.5):
                hashes, starts = hash_words(data, offsets)
                sizes, nodes, keys = [], [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    found = shingles(hashes[a:b], words)
                    sizes.append(len(found))
                    if len(found):
                        digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                        nodes.append(int.from_bytes(digest, "little", signed=True))
                        keys.append(bucket_keys(sketch(found), rows).view("i8"))
                    else:
                        nodes.append(None)
                        keys.append(np.zeros(0, "i8"))
                flat = np.concatenate(keys) if keys else np.zeros(0, "i8")
                ends = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(row, len(sizes)) for i in (0, 1)), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], schema=schema)
        give_back()

    return docs.select("doc_id", "content", "text").mapInArrow(
        run, "doc_id long, content long, n_shingles long, node long, keys array<long>")


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, data, offsets in text_chunks(texts, 0.5):
        hashes, starts = hash_words(data, offsets)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield shingles(hashes[a:b], words)


def verify(slots: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) of the slots (``a``, ``block``, ``b``, ``is_head``, ``text``) whose whole sets are similar enough.

    The slots of a head ``a`` and block stand together behind the head's own; its set is made once and its members
    stream by, so a task holds one batch of texts.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, "u8")
        for batch in batches:
            a, b, is_head = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            links = np.zeros(len(a), bool)
            for i, found in enumerate(_sets(batch.column(4), words)):
                if is_head[i]:
                    head, own = a[i], found
                elif head == a[i] and len(own) and len(found):
                    both = int((own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found).sum())
                    links[i] = 100 * both >= percent * (len(own) + len(found) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], schema=schema)
        give_back()

    return (slots.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("is_head"))
            .select("a", "block", "b", "is_head", "text").mapInArrow(run, "a long, b long"))


def _with_slots(pairs: DataFrame) -> DataFrame:
    """Nodes of the pairs (head ``a``, ``b``): the blocks in which each is a member, ``at``, and how many it heads, ``heads``.

    A head's members are dealt to blocks by their hash, so a head of many is many slots of bounded size.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    # A node is a member of at most as many heads as it has buckets.
    members = pairs.join(blocks, "a").groupBy(F.col("b").alias("node")).agg(
        F.collect_list(F.struct("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))).alias("at"))
    heads = blocks.select(F.col("a").alias("node"), F.col("blocks").alias("heads"))
    return members.join(heads, "node", "full").select("node", "at", F.coalesce("heads", F.lit(0)).alias("heads"))


def _slots(texts: DataFrame) -> DataFrame:
    """One row for each block that a node's text is needed in."""
    members = texts.select(F.col("node").alias("b"), "text", F.explode("at").alias("slot")).select(
        "slot.a", "slot.block", "b", F.lit(False).alias("is_head"), "text")
    heads = texts.filter("heads > 0").select(
        F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("heads") - 1)).alias("block"), F.col("node").alias("b"),
        F.lit(True).alias("is_head"), "text")
    return heads.unionByName(members)


def _open_units(rest: DataFrame) -> DataFrame:
    """What the stars left to compare, in units of bounded size: ``key``, ``x``, ``y``, ``side``, ``node``, ``label``.

    In each bucket of several components, nodes outside its largest one (side 0) meet all
    others (side 1). Both are dealt to blocks by a hash of the node; a unit is a block of each.
    """
    sizes = Kept(rest.groupBy("key", "label").agg(F.count("*").alias("members")), "parts").df.groupBy("key").agg(
        F.count("*").alias("parts"), F.max_by("label", "members").alias("largest"),
        F.sum("members").alias("all"), (F.sum("members") - F.max("members")).alias("few")).filter("parts > 1")
    rows = rest.join(sizes, "key").withColumns({
        "x_blocks": F.ceil(F.col("few") / ASKING).cast("int"), "y_blocks": F.ceil(F.col("all") / ASKED).cast("int")})
    spread = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    others = lambda n: F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.filter("label <> largest").select(
        "key", spread(F.col("x_blocks")).alias("x"), others("y_blocks").alias("y"), F.lit(0).alias("side"), "node", "label")
    asked = rows.select(
        "key", others("x_blocks").alias("x"), spread(F.col("y_blocks")).alias("y"), F.lit(1).alias("side"), "node", "label")
    return asking.unionByName(asked)


def _links_within(units: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the sides of each unit, one for each asking node and component that it meets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sets = list(_sets(rows["text"].combine_chunks(), words))
        side, node, label = (rows[c].to_numpy() for c in ("side", "node", "label"))
        ask, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sizes = np.array([len(s) for s in sets])
        # Hashes that no two sets share cannot count for any pair.
        every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        del every
        owner, use = np.repeat(np.arange(len(sets)), sizes), times[at] > 1
        _, at = np.unique(at[use], return_inverse=True)
        owner, both = owner[use], np.zeros((len(ask), len(other)), "f4")
        for first in range(0, int(at.max(initial=-1)) + 1, 4096):
            here = (at >= first) & (at < first + 4096)
            table_ = np.zeros((len(sets), 4096), "f4")
            table_[owner[here], at[here] - first] = 1
            both += table_[ask] @ table_[other].T
        union = sizes[ask][:, None] + sizes[other][None, :] - both
        a, b = np.nonzero((100 * both >= percent * union) & (label[ask][:, None] != label[other][None, :]))
        _, once = np.unique(np.column_stack([a, label[other[b]]]), axis=0, return_index=True)
        return pa.table([pa.array(node[ask[a[once]]]), pa.array(node[other[b[once]]])], schema=schema)

    return units.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``content``, a hash of the text, ``label`` and ``stays`` for every row.

    Documents are linked if 100 times the runs in both sets is at least ``percent``
    times the runs in either; ``component_id`` is the smallest ``doc_id`` that links lead to.
    Null or wordless texts have an empty set and are linked with nothing. Rows that repeat an
    id get the same answer each. A null ``doc_id`` is never a ``component_id``
    unless its component has no other; then its rows are kept. ``label``, the smallest node of the
    component, tells components apart also where ids repeat or are null; it is null for an empty set.
    ``stays`` marks the smallest ``doc_id`` and ``content`` of each label, null ids last, and empty sets. Columns
    other than ``doc_id`` and ``text`` are ignored, so their names may be any.
    """
    no_id = F.lit((1 << 63) - 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("content", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = Kept(sketches(docs, words).withColumn("first_id", F.coalesce("doc_id", no_id)), "sketches")
    nodes = Kept(rows.df.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("first_id", "content")).alias("first"),
        F.min("n_shingles").alias("n"), F.first("keys").alias("keys")).select("node", "first.first_id", "first.content", "n", "keys"), "nodes")
    entries = nodes.df.select("node", "n", F.explode_outer("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    entries = Kept(entries.join(shared, "key"), "buckets")
    # The centre is the node that meets most others in its buckets: the original of many copies, as a rule.
    weights = entries.df.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = Kept(entries.df.join(weights, "node").groupBy("key").agg(
        F.max_by("node", "weight").alias("head")), "heads")
    sizes = nodes.df.select(F.col("node").alias("head"), F.col("n").alias("head_n"))
    stars = entries.df.join(heads.df, "key").filter("node <> head").select(
        F.col("head"), F.col("node").alias("b"), F.col("n").alias("b_n")).distinct().join(sizes, "head")
    # Sets whose sizes differ too much cannot be similar.
    able = stars.filter((100 * F.col("head_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("head_n")))
    pairs = Kept(able.select(F.col("head").alias("a"), "b"), "pairs")
    # Texts of the nodes that share a bucket. The bitmap keeps all others where they are; a text moves once to its node,
    # together with where it is wanted, and then to each of these places.
    met = Kept(nodes.df.join(entries.df.select("node").distinct(), "node").join(_with_slots(pairs.df), "node", "left").select(
        "first_id", "content", "node", "at", F.coalesce("heads", F.lit(0)).alias("heads")), "met")
    place = F.xxhash64("first_id", "content")
    given = docs.select(F.coalesce("doc_id", no_id).alias("first_id"), "content", "text")
    wanted = mark_possible(given, place, met.df.select(place)).filter("__possible").groupBy("first_id", "content").agg(F.first("text").alias("text"))
    texts = Kept(wanted.join(met.df, ["first_id", "content"]).select("node", "at", "heads", "text"), "texts")
    links = Kept(verify(_slots(texts.df), words, percent), "links")
    # Parts of components will do here: whoever shares a label is connected.
    stars = connected(links.df, rounds=1)
    rest = Kept(
        entries.df.join(heads.df, "key").filter("node <> head").select("key", "node").join(stars.df, "node", "left")
        .select("key", "node", F.coalesce("label", "node").alias("label")), "rest")
    units = Kept(_open_units(rest.df), "units")
    asked = mark_possible(texts.df.select("node", "text"), F.col("node"), units.df.select("node").distinct()).filter("__possible")
    more = Kept(_links_within(units.df.join(asked.drop("__possible"), "node"), words, percent), "more-links")
    labels = connected(links.df.unionByName(more.df))
    for done in (entries, heads, met, texts, pairs, links, stars, rest, units, more):
        done.free()
    classes = Kept(nodes.df.join(labels.df, "node", "left").select(
        "node", "first_id", "content", F.coalesce("label", "node").alias("label")), "classes")
    nodes.free()
    smallest = classes.df.groupBy("label").agg(F.min(F.struct("first_id", "content")).alias("smallest"))
    members = classes.df.join(smallest, "label").select("node", "label", "smallest")
    first = F.nullif(F.coalesce("smallest.first_id", "first_id"), no_id)
    stays = F.coalesce(F.struct("first_id", "content") == F.col("smallest"), F.lit(True))
    return rows.df.join(members, "node", "left").select(
        "doc_id", "n_shingles", first.alias("component_id"), F.col("doc_id").eqNullSafe(first).alias("kept"), "content",
        "label", stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest ``doc_id``, null ids last.

    Groups are those that links make: texts that nothing links stay, whatever their ids. Of a group's rows
    that repeat the smallest id the text of the smallest hash stays, once: of rows that differ in other columns only,
    that of the smallest hash of all columns. Rows with an empty set all stay.
    """
    found = Kept(near_duplicates(docs, words, percent).filter("n_shingles > 0").groupBy("doc_id", "content", "label").agg(
        F.bool_and("stays").alias("stays"), F.count("*").alias("rows")), "near").df
    judged = Kept(found.filter("not stays or rows > 1").select(
        F.col("doc_id").alias("__doc"), F.col("content").alias("__text"), F.col("stays").alias("__stays")), "judged").df
    columns = docs.columns
    # Only rows that are judged, and the few that share a bit with one, are moved.
    marked = mark_possible(
        docs.withColumn("__content", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("__id", F.col("doc_id").cast("long")),
        F.xxhash64("__id", "__content"), judged.select(F.xxhash64("__doc", "__text")))
    some = marked.filter("__possible").join(
        judged, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__content") == F.col("__text")), "left").filter("__stays is null or __stays")
    once = some.filter("__stays").groupBy("__id", "__content").agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return marked.filter("not __possible").select(columns).unionByName(some.filter("__stays is null").select(columns)).unionByName(once)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("content", "label", "stays")
