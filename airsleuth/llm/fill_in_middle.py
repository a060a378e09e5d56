"""Operator 13: fill-in-the-middle documents, cut with arithmetic on whole machine words.

A batch's texts are read as one stream of UTF-8 bytes in 64-bit words. A few additions
and masks mark the last byte of every unit in eight bytes at once, and the bytes that begin a
code point. Counting marks per word and summing them up makes both a rank (units before a byte)
and a select (byte of a unit): a search finds the word, and the place in it comes from
clearing its lowest marks. No text is cut into units to be counted.

Every document is changed where it is read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import table
from airsleuth.llm.word_hashes import text_chunks

# --- fixed values: sentinels, seed and shares --------------------------------------
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42:"
FIM_PERCENT, SPM_PERCENT = 50, 80


def _all(byte: int) -> np.uint64:
    """``byte`` in all eight places of a word."""
    return np.uint64(byte * 0x0101010101010101)


_LOW, _HIGH = _all(0x7F), _all(0x80)
_ONE, _EIGHT = np.uint64(1), np.uint64(8)


def white_space(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a space or from tab to carriage return.

    Sums of low seven bits never carry into the next byte.
    """
    low = words & _LOW
    space = ((words ^ _all(0x20)) & _LOW) + _LOW | words ^ _all(0x20)
    from_tab, after_return = low + _all(0x80 - 0x09), low + _all(0x80 - 0x0E)
    return (~space | (from_tab & ~after_return & ~words)) & _HIGH


def unit_ends(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The high bit of every last byte of a unit: what is no space before a space, and the last bytes of texts.

    ``ends`` are where texts that are not empty end, in bytes.
    """
    spaces = white_space(words)
    following = spaces >> _EIGHT
    following[:-1] |= spaces[1:] << np.uint64(56)
    marks = ~spaces & following & _HIGH
    last = ends - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype("u8") * _EIGHT))
    return marks


def code_point_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that does not continue a code point."""
    return ~(words & ~(words << _ONE)) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, "i8")
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before ``at``."""
        word = at >> 3
        below = (_ONE << ((at & 7).astype("u8") * _EIGHT)) - _ONE
        return self.before[word] + np.bitwise_count(np.append(self.marks, np.uint64(0))[word] & below)

    def select(self, n: np.ndarray) -> np.ndarray:
        """The byte behind the ``n``-th mark, from 1."""
        word = np.searchsorted(self.before, n, "left") - 1
        left, rest = self.marks[word], n - self.before[word]
        for _ in range(7):
            left = np.where(rest > 1, left & (left - _ONE), left)
            rest = rest - 1
        # The bits below the lowest mark number seven and eight for each byte before.
        lowest = np.bitwise_count((left & (~left + _ONE)) - _ONE).astype("i8")
        return word * 8 + (lowest >> 3) + 1


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, filled up with spaces."""
    padded = np.full(-(-max(len(data), 1) // 8) * 8, 0x20, "u1")
    padded[:len(data)] = data
    return padded.view("<u8")


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers that the id alone decides."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4]) for i in (0, 4, 8, 12))


def _changed(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, percent: int, spm: int) -> Iterator[tuple]:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each text."""
    words = as_words(data)
    units = Marks(unit_ends(words, offsets[1:][offsets[1:] > offsets[:-1]]))
    points = Marks(code_point_starts(words))
    # Spaces that fill up the last word stand behind all texts.
    before = units.rank(offsets)
    counts = np.diff(before)
    drawn = np.array([draws(i) for i in ids], "i8").reshape(-1, 4)
    cuts = np.sort(drawn[:, :2] % (counts + 1)[:, None], axis=1)
    at = np.repeat(offsets[:-1, None], 2, axis=1)
    at[cuts > 0] = units.select((before[:-1, None] + cuts)[cuts > 0])
    chars = points.rank(np.column_stack([offsets[:-1], at]))
    body = data.tobytes()
    for i, n in enumerate(counts.tolist()):
        a, d = int(offsets[i]), int(offsets[i + 1])
        text = body[a:d]
        if not text or drawn[i, 2] % 100 >= percent or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)):
            yield n, "plain", None, None, text
            continue
        b, c = at[i].tolist()
        prefix, middle, suffix = body[a:b], body[b:c], body[c:d]
        start, mid, end = chars[i].tolist()
        if drawn[i, 3] % 100 < spm:
            yield n, "spm", mid - start, end - mid, b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle)
        else:
            yield n, "psm", mid - start, end - mid, b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle)


def fill_in_middle(docs: DataFrame, percent: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    A unit is a run of white space with the word behind it, or white space at the end. ``percent`` of the documents
    are cut at two of the n + 1 borders that a hash of the id draws; ``spm`` percent of those take the order suffix, prefix,
    middle. Null texts count as empty. Empty texts and those that hold a sentinel stay as they are, form ``plain``,
    with null lengths. Rows without an id draw from an empty id; rows that repeat an id are cut each by
    their own text. Other columns than ``doc_id`` and ``text`` are ignored, so their names may be any.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(row, len(offsets) - 1)
                columns = list(zip(*_changed(ids.to_pylist(), data, offsets, percent, spm)))
                output = pa.array(columns[4], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, f.type) for c, f in zip(columns[:4], list(schema)[1:])), output], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(changed: DataFrame) -> DataFrame:
    """``changed`` with ``text``, rebuilt from ``output`` and ``form`` alone."""
    parts = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    text = (F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col("output")))
    return changed.withColumn("text", text)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return changed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2("text", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM texts),
cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
