"""The insight report: all tables from one pass over the analyses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from echolens.operators import insights as I
from echolens.session import materialize


class Report(NamedTuple):
    themes: DataFrame
    overall: DataFrame
    requests: DataFrame
    totals: DataFrame
    swot: DataFrame


def insight_report(analyses: DataFrame) -> Report:
    """The theme table is written once to the shared folder, so the analyses are scanned and shuffled only once."""
    stats = materialize(I.insight_stats(analyses))
    themes, totals = I.theme_insights(stats), I.insight_totals(stats)
    overall, requests = I.overall_sentiment(stats), I.feature_requests(stats)
    return Report(themes, overall, requests, totals, I.swot(themes, overall, requests, totals))
