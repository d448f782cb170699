"""Spark-native analytics over cumulative counter snapshots."""

from counterlake.model import Interval, Repository, SnapshotSpec
from counterlake.plans.report import diff_report, interval_report, latest_report, report_of

__all__ = [
    "Interval",
    "Repository",
    "SnapshotSpec",
    "diff_report",
    "interval_report",
    "latest_report",
    "report_of",
]
