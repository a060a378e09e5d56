"""Operator 4: scores of a bigram language model with deleted interpolation.

The probability of a word is mixed from its share after the word before it, its share
of all words, and a floor. The weight of the first depends on how often the context
was seen, by powers of two. Weights are learned by expectation-maximisation
on deleted counts: each training token is judged by counts from which it was taken out, so
every token is held out once.

Counting is one shuffle of sorted hashes. Documents are kept in chunks of some MB.
Each chunk sends its distinct words and word pairs, cut into ranges of the hash, with its own
counts; a range adds up the counts of all chunks and answers each with the totals in the order
that they were asked for, so keys travel once. All counts cover the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept, table
from airsleuth.llm.word_hashes import combine, hash_words, text_chunks

#: Ranges of the hash for each chunk: a range gets about as many keys as a chunk has, divided by this.
RANGES = 4
#: Chunks of a corpus from which ranges stop growing in number; beyond it they grow in size.
MOST_RANGES = 20_000
FOLDS, HELD = 7, 2
END = np.uint64(0x9E3779B97F4A7C15)
#: Bins of the logarithm of a ratio of two probabilities, for each factor of two.
STEPS = 16
MIDDLE = 64 * STEPS
ROUNDS = 200
WORD, PAIR = 0, 1


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed, bytes of equal weight together."""
    columns = np.ascontiguousarray(numbers).view("u1").reshape(-1, numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(columns).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(plain, "u1").reshape(width, -1).T).view(kind).reshape(-1)


class Tokens:
    """Words and end marks of a chunk, and its distinct words and pairs."""

    def __init__(self, payload: bytes, lengths: np.ndarray) -> None:
        offsets = np.r_[0, np.cumsum(lengths)]
        words, starts = hash_words(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "u1"), offsets)
        docs = len(lengths)
        self.begins = starts[:-1] + np.arange(docs)  # a document's first token
        ends = starts[1:] + np.arange(docs)
        self.tokens = np.full(len(words) + docs, END, "u8")
        inner = np.ones(len(self.tokens), bool)
        inner[ends] = False
        self.tokens[inner] = words
        self.sizes = ends - self.begins + 1
        # What stands before the first word is the end mark too.
        before = np.r_[END, self.tokens[:-1]]
        self.words, self.word_at = np.unique(self.tokens, return_inverse=True)
        self.pairs, self.pair_at = np.unique(combine([before, self.tokens]), return_inverse=True)
        self.before_at = np.r_[np.searchsorted(self.words, END), self.word_at[:-1]]


def chunks_of(docs: DataFrame) -> DataFrame:
    """Documents in chunks: ``chunk``, ``doc_ids``, ``held``, ``lengths`` and compressed texts."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                        ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2), 3):
                ids = batch.column(0).slice(row, len(offsets) - 1)
                held = batch.column(1).slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_pylist([{
                    "chunk": number, "doc_ids": ids.to_pylist(), "held": held.to_pylist(),
                    "lengths": np.diff(offsets).tolist(), "payload": packer.compress(data.tobytes())}], schema=schema)
                number += 1

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.col("text").cast("string")).mapInArrow(
        run, "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, payload binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i] for n in batch.schema.names}


def _tokens(row: dict) -> tuple[Tokens, np.ndarray]:
    """A chunk's tokens, and which of its documents are held out."""
    lengths = row["lengths"].values.to_numpy(zero_copy_only=False)
    held = row["held"].values.to_numpy(zero_copy_only=False).astype(bool)
    return Tokens(row["payload"].as_py(), lengths), held


def questions(chunks: DataFrame, ranges: int) -> DataFrame:
    """A chunk's distinct keys of each range with its own training counts."""
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()),
                        ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t, held = _tokens(row)
            train = np.repeat(~held, t.sizes)
            out = []
            for kind, keys, at in ((WORD, t.words, t.word_at), (PAIR, t.pairs, t.pair_at)):
                counts = np.bincount(at[train], minlength=len(keys)).astype("u4")
                part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    out.append({"kind": kind, "range": int(part[a]), "chunk": row["chunk"].as_py(),
                                "keys": _pack(keys[a:b]), "counts": _pack(counts[a:b])})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return chunks.mapInArrow(run, "kind int, range int, chunk long, keys binary, counts binary")


def _count_bin(counts: np.ndarray) -> np.ndarray:
    """Counts themselves below 1024, then ``STEPS`` bins for each factor of two."""
    high = 1024 + np.floor(STEPS * (np.log2(np.maximum(counts, 1)) - 10)).astype("i8")
    return np.where(counts < 1024, counts, high)


def _bin_count(bins: np.ndarray) -> np.ndarray:
    return np.where(bins < 1024, bins, 2.0 ** (10 + (bins - 1024 + 0.5) / STEPS))


def answers(asked: DataFrame) -> DataFrame:
    """Totals for each question; and a row without ``chunk`` for each range of words, with its tokens by count."""
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()), ("totals", pa.binary()),
                        ("types", pa.int64()), ("bins", pa.list_(pa.int64())), ("mass", pa.list_(pa.int64()))])

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        kind, part = key[0].as_py(), key[1].as_py()
        order = np.argsort(blocks["chunk"].to_numpy(), kind="stable").tolist()
        keys = [_unpack(blocks["keys"][i].as_py(), "u8") for i in order]
        counts = np.concatenate([_unpack(blocks["counts"][i].as_py(), "u4") for i in order])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, counts, len(every)).astype("u8")
        out, done = [], 0
        for i, mine in zip(order, keys):
            out.append({"kind": kind, "range": part, "chunk": blocks["chunk"][i].as_py(),
                        "totals": _pack(totals[at[done:done + len(mine)]])})
            done += len(mine)
        if kind == WORD:
            seen = totals[totals > 0]
            bins, where = np.unique(_count_bin(seen), return_inverse=True)
            out.append({"kind": kind, "range": part, "types": len(seen), "bins": bins.tolist(),
                        "mass": np.bincount(where, seen, len(bins)).astype("i8").tolist()})
        return pa.Table.from_pylist(out, schema=schema)

    return asked.groupBy("kind", "range").applyInArrow(
        run, "kind int, range int, chunk long, totals binary, types long, bins array<long>, mass array<long>")


def mixture_weight(ratios: np.ndarray, mass: np.ndarray) -> float:
    """Weight of the first of two models by expectation-maximisation; ``ratios`` of its to the other's probability."""
    if mass.sum() == 0:
        return 0.0
    weight = 0.5
    for _ in range(ROUNDS):
        weight = float((mass * weight * ratios / (weight * ratios + 1 - weight)).sum() / mass.sum())
    return weight


class Model:
    """What scoring needs beside counts."""

    def __init__(self, tokens: int, types: int, floor: float) -> None:
        self.tokens, self.types, self.word_weight = tokens, types, floor
        self.weights = np.zeros(64)

    def word(self, counts: np.ndarray, deleted: int = 0) -> np.ndarray:
        return self.word_weight * counts / max(1, self.tokens - deleted) + (1 - self.word_weight) / (self.types + 1)


def _depth(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context: powers of two of its count, 0 for none."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype("i8")


def _totals(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Totals of a chunk's words and of its pairs, in the order of their hashes."""
    parts = row["answers"].values
    kinds, blocks = parts.field("kind").to_pylist(), parts.field("totals")
    both = [[_unpack(blocks[i].as_py(), "u8") for i, k in enumerate(kinds) if k == kind] for kind in (WORD, PAIR)]
    return np.concatenate(both[0]).astype("f8"), np.concatenate(both[1]).astype("f8")


def deleted_ratios(answered: DataFrame, model: Model) -> DataFrame:
    """Training tokens by context bucket and ratio of pair share to word share, all without the token itself."""
    schema = pa.schema([("depth", pa.int32()), ("bin", pa.int32()), ("mass", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((64, 2 * MIDDLE + 1), "i8")
        for row in _rows(batches):
            t, held = _tokens(row)
            words, pairs = _totals(row)
            train = np.repeat(~held, t.sizes)
            context = words[t.before_at[train]] - 1
            share = (pairs[t.pair_at[train]] - 1) / np.maximum(context, 1)
            ratio = share / model.word(words[t.word_at[train]] - 1, 1)
            # Bin 0 is for pairs that nobody else has.
            bins = np.clip(np.round(STEPS * np.log2(np.maximum(ratio, 1e-300))) + MIDDLE, 1, 2 * MIDDLE)
            np.add.at(found, (_depth(context), np.where(ratio > 0, bins, 0).astype("i8")), 1)
        depth, place = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth, pa.int32()), pa.array(place, pa.int32()), pa.array(found[depth, place])], schema=schema)

    rows = answered.mapInArrow(run, "depth int, bin int, mass long")
    return rows.groupBy("depth", "bin").agg(F.sum("mass").alias("mass"))


def scores(answered: DataFrame, model: Model) -> DataFrame:
    """A row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t, held = _tokens(row)
            words, pairs = _totals(row)
            count, context = words[t.word_at], words[t.before_at]
            weight = model.weights[_depth(context)]
            p = weight * pairs[t.pair_at] / np.maximum(context, 1) + (1 - weight) * model.word(count)
            base = np.log10((count + 1) / (model.tokens + model.types + 1))
            add = lambda x: np.add.reduceat(x, t.begins)
            yield pa.RecordBatch.from_arrays([
                row["doc_ids"].values, pa.array(held), pa.array(t.sizes, pa.int64()),
                pa.array(add((count > 0).astype("i8"))), pa.array(np.full(len(held), model.tokens, "i8")),
                pa.array(add(base)), pa.array(add(np.log10(p)))], schema=schema)

    return answered.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                    "base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model scores of every document, learned from those that are not held out.

    A null or blank text is its end mark alone; a null id is never held out; rows that repeat are documents of
    their own. Without training documents every word has the floor's probability. Other columns are ignored.
    """
    chunks = Kept(chunks_of(docs), "chunks", codec="uncompressed")
    ranges = max(1, min(MOST_RANGES, RANGES * chunks.df.count()))
    replies = Kept(answers(questions(chunks.df, ranges)), "answers", codec="uncompressed")
    about = replies.df.filter("chunk is null")
    types = about.agg(F.coalesce(F.sum("types"), F.lit(0))).head()[0]
    # Fewer than 2,000 bins, whatever the corpus.
    counts = about.select(F.explode(F.arrays_zip("bins", "mass")).alias("x")).groupBy("x.bins").agg(
        F.sum("x.mass").alias("mass")).toPandas()
    tokens = int(counts["mass"].sum())
    deleted = (_bin_count(counts["bins"].to_numpy("i8")) - 1) / max(1, tokens - 1)
    model = Model(tokens, types, mixture_weight(deleted * (types + 1), counts["mass"].to_numpy("f8")))
    grouped = replies.df.filter("chunk is not null").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("kind", "range", "totals"))).alias("answers"))
    answered = Kept(chunks.df.join(grouped, "chunk"), "answered", codec="uncompressed")
    chunks.free()
    replies.free()
    # At most 64 times 2,049 bins.
    found = deleted_ratios(answered.df, model).toPandas()
    for depth, rows in found.groupby("depth"):
        bins = rows["bin"].to_numpy("f8")
        ratios = np.where(bins > 0, 2.0 ** ((bins - MIDDLE) / STEPS), 0.0)
        if depth > 0:
            model.weights[depth] = mixture_weight(ratios, rows["mass"].to_numpy("f8"))
    return scores(answered.df, model)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
