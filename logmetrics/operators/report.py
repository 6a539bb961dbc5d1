"""Aligned rows for a report or a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logmetrics.operators.intervals import attach_scores


def anomaly_report(rows: DataFrame, key: str, *scores: DataFrame) -> DataFrame:
    """Source rows with each score frame joined on the row key; rows without a
    score (the first ones of a series, points in no tree) keep null."""
    report = rows
    for frame in scores:
        report = attach_scores(report, frame, key)
    return report
