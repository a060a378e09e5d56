"""Operator 5: a quality classifier by co-training of two views.

One classifier sees what a text is made of, the other the page's metadata. Both start
from the labelled rows. In every round each labels the unlabelled documents it is sure of
for the other, which learns from them what its own view could not
tell. Each view is calibrated on labelled texts that took no part, and the two are
combined as independent evidence; once a round makes the loss on those texts higher, the views of the round before stay.

Statistics of all documents are computed in Spark; the two fits run on bounded samples of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from airsleuth.llm.tables import Kept, table
from airsleuth.llm.word_hashes import give_back, hash_words, text_chunks

#: Most labelled rows that are fitted, and most pseudo-labels of a class that a view hands over in a round, in which
#: the classes keep the proportion of the labels; both are taken in the order of a hash of the id.
LABELLED = 20_000
HANDED = 1_000
ROUNDS = 3
#: A view is sure of a label from this probability.
SURE = 0.95
#: One in so many labelled rows calibrates.
CALIBRATE = 5
#: Documents below this probability of good quality are rejected.
THRESHOLD = 0.5
SOURCES, LANGUAGES = 32, 16

_CLASSES = np.full(256, 7, "u1")  # symbols
_CLASSES[ord("a"):ord("z") + 1] = 0
_CLASSES[ord("A"):ord("Z") + 1] = 1
_CLASSES[ord("0"):ord("9") + 1] = 2
_CLASSES[[0x20, 0x09]] = 3
_CLASSES[[0x0A, 0x0D]] = 4
_CLASSES[[ord(c) for c in ".,;:?'-\"()"]] = 5
_CLASSES[ord("!")] = 6
_CLASSES[128:] = 8
CONTENT = 9 + 5


def content_features(texts: pa.Array) -> np.ndarray:
    """A row per text: shares of kinds of bytes, word and line lengths, repetition, length."""
    parts = [np.zeros((0, CONTENT))]
    for _, data, offsets in text_chunks(texts, 0.5):
        n = np.diff(offsets)
        whole = np.maximum(n, 1)
        kinds = _CLASSES[data]
        shares = []
        for kind in range(9):
            sums = np.r_[0, np.cumsum(kinds == kind)]
            shares.append((sums[offsets[1:]] - sums[offsets[:-1]]) / whole)
        hashes, starts = hash_words(data, offsets)
        words = np.diff(starts)
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(starts[:-1], starts[1:])])
        upper = np.r_[False, (kinds[1:] == 1) & (kinds[:-1] == 1)] if len(data) else np.zeros(0, bool)
        marked = np.r_[False, (kinds[1:] == 7) & (kinds[:-1] == 7)] if len(data) else np.zeros(0, bool)
        double = []
        for flags in (upper, marked):
            sums = np.r_[0, np.cumsum(flags)]
            double.append((sums[offsets[1:]] - sums[offsets[:-1]]) / whole)
        parts.append(np.column_stack([
            *shares, *double, np.log1p(n / np.maximum(words, 1)), distinct / np.maximum(words, 1), np.log1p(words)]))
    return np.concatenate(parts)


def metadata_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """A row per page: source and language by hash, and the stated length; null is a value of its own."""
    out = np.zeros((len(source), SOURCES + LANGUAGES + 2))
    for column, width, first in ((source, SOURCES, 0), (lang, LANGUAGES, SOURCES)):
        values = column.fill_null("\0").dictionary_encode()
        places = np.array([xxhash.xxh32_intdigest(v) % width for v in values.dictionary.to_pylist()], "i8")
        out[np.arange(len(source)), first + places[values.indices.to_numpy(zero_copy_only=False)]] = 1
    length = np.maximum(n_chars.fill_null(0).to_numpy(zero_copy_only=False).astype("f8"), 0)
    out[:, -2], out[:, -1] = np.log1p(length), np.log1p(length) ** 2 / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on standardized features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Linear:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    model = Linear(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1] + 1))
    model.weights = _newton(np.clip((x - model.mean) / model.scale, -8, 8), y, 1.0)
    return model


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> None:
    """Fit slope and shift of the log-odds on rows that the model has not seen."""
    if len(y) and 0 < y.sum() < len(y):
        raw = model.raw(x)
        spread = raw.std() or 1.0
        model.shift, slope = _newton(raw[:, None] / spread, y, 0.1)
        model.slope = max(slope, 0.0) / spread


@dataclass
class CoTrained:
    content: Linear
    metadata: Linear
    prior: float  # log-odds of good quality

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by content, by metadata and by both."""
        a, b = self.content.probability(x), self.metadata.probability(m)
        odds = lambda p: np.log(p / (1 - p))
        return a, b, _sigmoid(odds(a) + odds(b) - self.prior)


_INPUTS = ("text", "source", "lang", "n_chars")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n_chars = (batch.column(batch.schema.get_field_index(f"__{c}")) for c in _INPUTS)
    return content_features(text), metadata_features(source, lang, n_chars)


def _inputs(docs: DataFrame) -> dict:
    kinds = dict.fromkeys(_INPUTS, "string") | {"n_chars": "long"}
    return {f"__{c}": F.col(c).cast(k) if c in docs.columns else F.lit(None).cast(k) for c, k in kinds.items()}


def features(docs: DataFrame) -> DataFrame:
    """Both views of every document and a hash of its text, without the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("x", pa.list_(pa.float32())), ("m", pa.list_(pa.float32()))])

    def lists(a: np.ndarray) -> pa.Array:
        ends = np.arange(len(a) + 1, dtype="i4") * a.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(a.astype("f4").ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(x), lists(m)], schema=schema)
        give_back()

    new = _inputs(docs)
    content = F.xxhash64(F.coalesce(new["__text"], F.lit(""))).alias("__content")
    return docs.select(F.col("doc_id").cast("long"), content, *(e.alias(n) for n, e in new.items())).mapInArrow(
        run, "doc_id long, content long, x array<float>, m array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, width)


def _rows(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both views, labels and hashes of texts."""
    found = df.toPandas()
    stack = lambda c, w: np.array(found[c].tolist(), "f8").reshape(-1, w)
    content = found["content"].to_numpy("i8") if "content" in found else np.zeros(len(found), "i8")
    return stack("x", CONTENT), stack("m", SOURCES + LANGUAGES + 2), found["label"].to_numpy("f8"), content


def _in_proportion(handed: list[tuple], good: float) -> list[tuple]:
    """The first of the bad and of the good rows, as many as keep the share of good ones."""
    total = min(len(handed[0][2]) / (1 - good), len(handed[1][2]) / good)
    take = [int(total * (1 - good)), int(total * good)]
    return [tuple(a[:n] for a in rows) for rows, n in zip(handed, take)]


def _loss(model: CoTrained, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log-likelihood of the labels; 0 for no rows."""
    p = np.clip(model.score(x, m)[2], 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def _first_rows(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of smallest ``hash``. What cannot be among them stays in its task, however many tasks there are."""
    rows, spare = df.count(), int(most + 6 * most ** 0.5)
    if rows > spare:
        df = df.filter(F.col("hash") <= -(1 << 63) + (spare << 64) // rows)
    return df.orderBy("hash", F.hash("x")).limit(most)


def _confident(pool: DataFrame, models: tuple[Linear, Linear]) -> DataFrame:
    """Unlabelled documents that a view is sure of: which view (0 content), the class, and both views' features."""
    schema = pa.schema([("hash", pa.int64()), ("view", pa.int32()), ("label", pa.float64()),
                        ("x", pa.list_(pa.float32())), ("m", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column(1), CONTENT), _matrix(batch.column(2), SOURCES + LANGUAGES + 2)
            hashes = batch.column(0).to_numpy()
            for view, p in enumerate((models[0].probability(x), models[1].probability(m))):
                for label, sure in ((1.0, p >= SURE), (0.0, p <= 1 - SURE)):
                    # No more of a batch can be among the first of all.
                    take = np.flatnonzero(sure)
                    take = take[np.argsort(hashes[take], kind="stable")[:HANDED]]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(take)), pa.array(np.full(len(take), view, "i4")),
                        pa.array(np.full(len(take), label)), batch.column(1).take(pa.array(take)),
                        batch.column(2).take(pa.array(take))], schema=schema)

    return pool.select("hash", "x", "m").mapInArrow(
        run, "hash long, view int, label double, x array<float>, m array<float>")


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED) -> CoTrained | None:
    """Fit both views; None without labelled documents of both classes.

    ``labels`` has ``doc_id`` and ``quality``, 1 for good; nulls are no labels, and the majority of
    repeated ones counts, good for a tie. Labels without a document are ignored.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    kept = Kept(features(docs).join(marks, "doc_id", "left").withColumn("hash", F.xxhash64("doc_id")), "views")
    # A bounded sample of the labelled rows; of rows that repeat an id, that of the smallest hash of its text.
    one = kept.df.filter("label is not null").groupBy("doc_id").agg(
        F.min_by(F.struct("hash", "content", "x", "m", "label"), "content").alias("row")).select("row.*")
    x, m, y, content = _rows(_first_rows(one, labelled))
    if not 0 < y.sum() < len(y):
        kept.free()
        return None
    # By a hash of the text, so that no copy of a fitted text calibrates.
    hold = content % CALIBRATE == 0
    if not 0 < y[~hold].sum() < (~hold).sum():
        hold[:] = False
    own_x, own_m = (x[~hold], y[~hold]), (m[~hold], y[~hold])
    good = float(y.mean())

    def fitted() -> CoTrained:
        model = CoTrained(fit(*own_x), fit(*own_m), float(np.log(good / (1 - good))))
        calibrate(model.content, x[hold], y[hold])
        calibrate(model.metadata, m[hold], y[hold])
        return model

    best = fitted()
    least = _loss(best, x[hold], m[hold], y[hold])
    pool = kept.df.filter("label is null")
    for turn in range(rounds):
        sure = Kept(_confident(pool.withColumn("hash", F.xxhash64("hash", F.lit(turn))), (best.content, best.metadata)), "sure")
        handed = [_in_proportion([_rows(_first_rows(sure.df.filter((F.col("view") == view) & (F.col("label") == label)), HANDED))
                                  for label in (0.0, 1.0)], good) for view in (0, 1)]
        sure.free()
        # What content is sure of teaches metadata, and the other way round.
        own_m = (np.concatenate([own_m[0], *(h[1] for h in handed[0])]), np.concatenate([own_m[1], *(h[2] for h in handed[0])]))
        own_x = (np.concatenate([own_x[0], *(h[0] for h in handed[1])]), np.concatenate([own_x[1], *(h[2] for h in handed[1])]))
        model = fitted()
        loss = _loss(model, x[hold], m[hold], y[hold])
        if loss > least:
            break
        best, least = model, loss
    kept.free()
    return best


def score_quality(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``content_score``, ``metadata_score``, ``quality_score`` and ``good``.

    Nulls are values like any other: a null text is an empty one. Columns of these names
    are replaced. Without a model (no labels to learn from) scores are null and all documents are good.
    """
    names = ("content_score", "metadata_score", "quality_score")
    docs = docs.drop(*names, "good")
    if model is None:
        return docs.withColumns({**{n: F.lit(None).cast("double") for n in names}, "good": F.lit(True)})
    new = _inputs(docs)
    schema = StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names), StructField("good", BooleanType())])
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = model.score(*_views(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(width)), *(pa.array(v) for v in (a, b, both, both >= threshold))],
                names=schema.names)
        give_back()

    return docs.withColumns(new).mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, co_train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", "content_score", "metadata_score", "quality_score", "good")
