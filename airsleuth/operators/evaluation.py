"""How well events match the labels of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsleuth.errors import FeatureEngineeringError
from airsleuth.functions.columns import is_fault, minutes_between, ratio
from airsleuth.operators.ordered import MAX_ROWS, SLICE, Order, slice_series, with_run_up
from airsleuth.schema import FAULT_TYPES, NORMAL, ROW_KEYS, SCENARIO, require_columns
from airsleuth.session import cut_lineage

FAULTS = [f for f in FAULT_TYPES if f != NORMAL]


def round4(value: Column) -> Column:
    """Four digits; NaN stays NaN."""
    return F.when(F.isnan(value), value).otherwise(F.round(value, 4))


def label_detections(rows: DataFrame, events: DataFrame) -> DataFrame:
    """All rows with ``detected`` and ``predicted_fault``.

    A row without event is not detected, and a missing prediction is 'normal'.
    """
    found = F.min("predicted_fault") if "predicted_fault" in events.columns else F.lit(None).cast("string")
    per_key = events.groupBy(*ROW_KEYS).agg(
        F.lit(True).alias("detected"), found.alias("predicted_fault")
    )
    return (
        rows.select(*ROW_KEYS, "fault_type").join(per_key, ROW_KEYS, "left")
        .withColumns({
            "detected": F.coalesce("detected", F.lit(False)),
            "predicted_fault": F.coalesce("predicted_fault", F.lit(NORMAL)),
        })
    )


def first_events(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """First event per row key in the order ``by``."""
    rest = [c for c in events.columns if c not in ROW_KEYS]
    return (
        events.groupBy(*ROW_KEYS)
        .agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_first"))
        .select(*ROW_KEYS, "_first.*")
    )


def _require_labelled(report: DataFrame) -> DataFrame:
    """Fail, when the report is computed, if no labelled row was found."""
    return report.withColumn(
        "n_evaluated",
        F.when(F.col("n_evaluated") > 0, F.col("n_evaluated")).otherwise(
            F.raise_error(F.lit("no rows with valid ground-truth labels remain")).cast("long")
        ),
    )


def detection_report(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of fault against normal, in one pass."""
    require_columns(df, ["fault_type", "detected"])
    truth, hit = is_fault(F.col("fault_type")), F.col("detected")
    counts = df.agg(
        F.count("fault_type").alias("n_evaluated"),
        F.count_if(F.col("fault_type").isNull()).alias("n_skipped"),
        F.count_if(truth & hit).alias("_tp"),
        F.count_if(~truth & hit).alias("_fp"),
        F.count_if(truth & ~hit).alias("_fn"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return _require_labelled(counts).select(
        "n_evaluated", "n_skipped",
        round4(ratio(tp, tp + fp)).alias("precision"),
        round4(ratio(tp, tp + fn)).alias("recall"),
        round4(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def fault_recall(df: DataFrame, fault_types: Sequence[str] = tuple(FAULTS)) -> DataFrame:
    """Recall per fault type; a type without rows has recall 0."""
    require_columns(df, ["fault_type", "detected"])
    label = F.col("fault_type")
    pairs = df.agg(F.array(*[
        F.struct(
            F.lit(f).alias("fault_type"),
            F.count_if(label == f).alias("support"),
            F.count_if((label == f) & F.col("detected")).alias("_tp"),
        ) for f in fault_types
    ]).alias("_types"))
    return pairs.select(F.inline("_types")).select(
        "fault_type", "support", round4(ratio(F.col("_tp"), F.col("support"))).alias("recall")
    )


def confusion_counts(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows per (truth, prediction), null labels included."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _label_sums(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label, within ``by``: rows with it as truth, rows with it as prediction, rows with both.

    Rows that lack a label on either side are summed under a null label.
    """
    none = F.lit(0).cast("long")
    valid = F.col("truth").isNotNull() & F.col("prediction").isNotNull()
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(none)

    def side(label: Column, true_n: Column, pred_n: Column, tp: Column) -> Column:
        return F.struct(label.alias("label"), true_n.alias("true_n"), pred_n.alias("pred_n"), tp.alias("tp"))

    n = F.col("n")
    sides = F.when(valid, F.array(side(F.col("truth"), n, none, hit), side(F.col("prediction"), none, n, none)))
    sides = sides.otherwise(F.array(side(F.lit(None).cast("string"), n, none, none)))
    return (
        counts.select(*by, F.inline(sides)).groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("true_n", "pred_n", "tp")])
    )


def _f1() -> Column:
    return ratio(2 * F.col("tp"), F.col("true_n") + F.col("pred_n"))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label that occurs on either side."""
    return _label_sums(counts).filter(F.col("label").isNotNull()).select(
        "label",
        round4(ratio(F.col("tp"), F.col("pred_n"))).alias("precision"),
        round4(ratio(F.col("tp"), F.col("true_n"))).alias("recall"),
        round4(_f1()).alias("f1"),
        F.col("true_n").alias("support"),
    )


def class_summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1 over all labels, and rows evaluated and skipped; a row for each group of ``by``."""
    labelled = F.col("label").isNotNull()

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    totals = _label_sums(counts, by).groupBy(*by).agg(
        total("true_n", labelled).alias("n_evaluated"), total("true_n", ~labelled).alias("n_skipped"),
        total("tp", labelled).alias("_right"), F.avg(F.when(labelled, _f1())).alias("_macro"),
    )
    return _require_labelled(totals).select(
        *by, "n_evaluated", "n_skipped",
        round4(ratio(F.col("_right"), F.col("n_evaluated"))).alias("accuracy"),
        round4(F.col("_macro")).alias("macro_f1"),
    )


def confusion_matrix(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per true label, one column per predicted label, both in sorted order.

    ``labels`` must hold all labels that occur; others would have no column.
    """
    columns = sorted(labels)
    valid = counts.dropna(subset=["truth", "prediction"])
    stray = ~F.col("truth").isin(columns) | ~F.col("prediction").isin(columns)
    checked = valid.withColumn("n", F.when(
        stray, F.raise_error(F.concat(F.lit("unexpected label: "), "truth", F.lit("/"), "prediction")).cast("long")
    ).otherwise(F.col("n")))
    return checked.groupBy("truth").pivot("prediction", columns).agg(F.sum("n")).na.fill(0)


def time_to_detect(events: DataFrame, starts: Mapping[str, datetime],
                   by: Sequence[str] = ("ground_truth",)) -> DataFrame:
    """Mean minutes from a fault's start to its events; negative when events come first."""
    require_columns(events, ["event_time", "ground_truth"])
    if not starts:
        raise FeatureEngineeringError("time_to_detect needs at least one start time")
    begin = F.create_map(*[F.lit(v) for pair in starts.items() for v in pair])[F.col("ground_truth")]
    return (
        events.withColumn("_start", begin).filter(F.col("_start").isNotNull())
        .groupBy(*by)
        .agg(F.round(F.avg(minutes_between(F.col("event_time"), F.col("_start"))), 4).alias("mean_delay_min"))
    )


def scenario_report(df: DataFrame) -> DataFrame:
    """Detected share per scenario: recall if all its rows are faulty, false-positive
    rate if none is, and no rate (kind 'mixed') otherwise."""
    fault = is_fault(F.coalesce("fault_type", F.lit("")))
    return (
        df.groupBy(SCENARIO)
        .agg(
            F.count("*").alias("n"),
            F.count_if("detected").alias("detected_rows"),
            F.bool_and(fault).alias("_all"), F.bool_or(fault).alias("_any"),
        )
        .withColumn("kind", F.when(F.col("_all"), "fault_recall").when(~F.col("_any"), "normal_fpr").otherwise("mixed"))
        .select(
            SCENARIO, "n", "kind", "detected_rows",
            F.when(F.col("kind") != "mixed", round4(ratio(F.col("detected_rows"), F.col("n")))).alias("rate"),
        )
    )


def gaps(df: DataFrame, order: Order = Order()) -> DataFrame:
    """Minutes to the previous row of the series, as ``gap_min``; null for the first."""
    before = F.lag(order.time).over(Window.partitionBy(*order.by_slice).orderBy(*order.columns))
    return (
        with_run_up(df, 1, order)
        .withColumn("gap_min", minutes_between(F.col(order.time), before))
        .filter(~F.col("_copy")).drop("_copy", SLICE)
    )


def alert_bursts(detected: DataFrame, gap_minutes: float = 5, order: Order = Order(),
                 max_rows: int = MAX_ROWS) -> DataFrame:
    """Runs of detected rows of a series in which no gap exceeds ``gap_minutes``.

    Bursts are found within bounded slices of a series first. Then only the
    first and last burst of every slice are compared with their neighbours,
    because no other can go on in the next slice. Keys and order columns of the
    detected rows are written once, so that looking for cuts detects nothing again.
    """
    limit = F.lit(int(gap_minutes * 60_000_000))
    keys = list(order.keys)
    in_slice = Window.partitionBy(*order.by_slice).orderBy(*order.columns)
    instant = F.unix_micros(order.time)
    starts = (F.lag(instant).over(in_slice).isNull()) | (instant - F.lag(instant).over(in_slice) > limit)
    places = cut_lineage(detected.select(*dict.fromkeys([*keys, *order.columns])))
    pieces = cut_lineage(
        slice_series(places, order, max_rows).select(*order.by_slice, *order.columns)
        .withColumn("_starts", starts.cast("int"))
        .withColumn("_burst", F.sum("_starts").over(in_slice))
        .groupBy(*order.by_slice, "_burst")
        .agg(F.min(order.time).alias("burst_start"), F.max(order.time).alias("burst_end"),
             F.count("*").alias("rows"))
        .withColumn("_last", F.max("_burst").over(Window.partitionBy(*order.by_slice)))
    )
    at_edge = (F.col("_burst") == 1) | (F.col("_burst") == F.col("_last"))
    columns = [*keys, "burst_start", "burst_end", "rows"]
    along = Window.partitionBy(*keys).orderBy(SLICE, "_burst")
    since = F.unix_micros("burst_start") - F.unix_micros(F.lag("burst_end").over(along))
    joined = (
        pieces.filter(at_edge)
        .withColumn("_new", F.coalesce((since > limit).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(along))
        .groupBy(*keys, "_run")
        .agg(F.min("burst_start").alias("burst_start"), F.max("burst_end").alias("burst_end"),
             F.sum("rows").alias("rows"))
    )
    return joined.select(*columns).unionByName(pieces.filter(~at_edge).select(*columns))
