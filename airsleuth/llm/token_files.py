"""Operator 9: token ids in files of independent compressed frames with a seek table.

A file holds the ids of a range of documents, unsigned 32-bit little-endian, cut
into frames of ``FRAME_IDS`` ids. Each frame is compressed by itself. The last
frame is the directory: which documents the file holds and how many ids each has.
A skippable frame with the seek table ends the file: compressed size, plain size
and checksum of each frame, in the layout of the public seekable zstandard format.
A reader finds the directory from the file's end and decompresses only the frames
of the documents that are asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import shuffle_parts, table
from airsleuth.llm.word_ids import WordIds
from airsleuth.session import scratch_path

FRAME_IDS = 1 << 16
TOKENIZER = "word_bpe_49k.json"
# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


class CorruptFile(ValueError):
    """A frame does not have the checksum that its seek table names."""


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents one by one; holds one frame and the directory."""

    def __init__(self, out, frame_ids: int = FRAME_IDS) -> None:
        self.out, self.width = out, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.waiting, self.size = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, plain: bytes) -> None:
        packed = self.pack(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), _checksum(plain)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.width:
            plain = b"".join(self.waiting)
            whole = len(plain) - len(plain) % self.width
            for at in range(0, whole, self.width):
                self._frame(plain[at:at + self.width])
            self.waiting, self.size = [plain[whole:]], len(plain) - whole

    def finish(self) -> None:
        if self.size:
            self._frame(b"".join(self.waiting))
        known = np.array([d is not None for d in self.docs], "u1")
        ids = np.array([d or 0 for d in self.docs], "<i8")
        self._frame(known.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes())
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads a file's directory, and frames when documents need them."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        file.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise CorruptFile("no seek table at the end")
        file.seek(end - 9 - 12 * frames)
        self.frames = list(struct.iter_unpack("<III", file.read(12 * frames)))
        self.places = [0, *accumulate(f[0] for f in self.frames)]
        self.plain = [0, *accumulate(f[1] for f in self.frames[:-1])]
        directory = self.frame(frames - 1)
        n = len(directory) // 17
        known = np.frombuffer(directory, "u1", n)
        ids = np.frombuffer(directory, "<i8", n, n).tolist()
        self.docs = [d if k else None for d, k in zip(ids, known)]
        self.counts = np.frombuffer(directory, "<i8", n, 9 * n).tolist()
        self.starts = [0, *accumulate(self.counts)]
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        packed, plain, checksum = self.frames[number]
        self.file.seek(self.places[number])
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)
        if len(data) != plain or _checksum(data) != checksum:
            raise CorruptFile(f"frame {number} does not match its checksum")
        return data

    def document(self, place: int) -> Iterator[bytes]:
        """The ids of the document at a place of the directory, frame by frame."""
        at, end = 4 * self.starts[place], 4 * self.starts[place + 1]
        while at < end:
            number = bisect_right(self.plain, at) - 1
            if self._last[0] != number:
                self._last = (number, self.frame(number))
            part = self._last[1][at - self.plain[number]:end - self.plain[number]]
            at += len(part)
            yield part


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, frame_ids: int = FRAME_IDS,
                      parts: int | None = None) -> list[tuple[str, int]]:
    """Write the ids of all texts, each with an end id, in ascending doc_id order; returns the manifest.

    The manifest lists file and number of ids, in the order of documents. A task
    that runs twice writes two files, and only the one of the attempt that counted
    is in the manifest. ``docs`` needs ``doc_id`` and ``text``. Null texts count as
    empty, null ids come first, rows that repeat an id stand in the order of their texts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, writer, out, path, total = TaskContext.get().partitionId(), None, None, None, "", 0
        for batch in batches:
            if writer is None and batch.num_rows:
                store, root = open_store(folder)
                store.create_dir(root, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
                path, out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
                words, writer = WordIds.of(tokenizer), FrameWriter(out, frame_ids)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py())
                total += len(ids) // 4
                writer.add(doc, ids)
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "ids": [total]})

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(parts or shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "part long, path string, ids long")
    )
    # A row for each file, as the scheduler holds a state for each task.
    return [(r.path, r.ids) for r in sorted(rows.collect(), key=lambda r: r.part)]


def read_token_files(spark: SparkSession, manifest: list[tuple[str, int]]) -> DataFrame:
    """A row per document of the files: its place among all ids, its number of ids, and their checksum."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    reader = FrameReader(file)
                    sums = []
                    for i in range(len(reader.docs)):
                        crc = 0
                        for ids in reader.document(i):
                            crc = zlib.crc32(ids, crc)
                        sums.append(crc)
                    starts = (np.array(reader.starts[:-1], "i8") + before).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (reader.docs, starts, reader.counts, sums)], schema=schema)

    starts = [0, *accumulate(n for _, n in manifest)]
    files = spark.createDataFrame([(p, s) for (p, _), s in zip(manifest, starts)], "path string, before long")
    return (files.repartition(max(1, len(manifest)))
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), folder))
