"""Operator 6: packing documents into sequences, first-fit decreasing in random groups.

Every document is cut into pieces of the sequence length and a rest. Whole pieces
fill a sequence each. Rests are dealt at random into groups of a fixed mean size,
and each group is packed by itself: longest first, into the first bin with room,
found in a tournament tree over the bins' room. Only the pieces' places move
between tasks, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept, table
from airsleuth.llm.word_ids import WordIds

SEQUENCE = 2048
#: Mean pieces of a group.
GROUP = 8192
TOKENIZER = "word_bpe_49k.json"

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("lot", pa.int64()),
])


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each item. Of equal lengths the earlier comes first."""
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    tree = [room] * (2 * size)  # each node: the most room of a bin below it
    used = [0] * size
    bins, places = np.empty(n, "i8"), np.empty(n, "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        node = 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        b = node - size
        bins[i], places[i] = b, used[b]
        used[b] += need
        tree[node] = room - used[b]
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, places


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of each document's ids with the end id: place, length, checksum, and a random lot."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        draw = np.random.default_rng(TaskContext.get().partitionId())
        width = 4 * sequence
        for batch in batches:
            ids, starts, lengths, sums, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words.encode(text.as_py())
                for at in range(0, len(tokens), width):
                    part = tokens[at:at + width]
                    ids.append(doc)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(len(tokens) // 4)
            lots = draw.integers(0, 1 << 62, len(ids))
            columns = [pa.array(x, t.type) for x, t in zip((ids, starts, lengths, sums, totals, lots), _PIECES)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """One row per piece with its sequence and its place there.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null texts
    count as empty: such a document is its end id. Each row is a document, also
    where ids repeat or are null; an empty table gives no rows.
    """
    kept = Kept(pieces(docs, tokenizer or public_tokenizers.path(TOKENIZER), sequence), "pieces")
    groups = max(1, -(-kept.df.count() // group))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        # Lots differ between pieces, so their order is the same in every attempt.
        rows = rows.sort_values(["lot", "doc_id", "start"], kind="stable").reset_index(drop=True)
        number = int(rows["lot"].iloc[0] % groups)
        bins, places = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        out = rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = (number << 32) + bins
        out["offset"] = places
        return out

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")
    return kept.df.groupBy(F.pmod(F.col("lot"), F.lit(groups)).alias("group")).applyInPandas(fill, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
