"""The whole analysis: from media, GOPs and ranges to JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gopmill.operators import decisions, gops, segments, texts
from gopmill.session import written


def smart_reports(media: DataFrame, gop_table: DataFrame, ranges: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """(asset_id, segment_id, text) for every asset with ranges, see ``texts.smart_report``.

    The GOPs feed the plan, the recommendation and the summary, so pass a stored table; the plan feeds both the
    segments and the counts, so it is written.
    """
    plan = written(decisions.plan_segments(media, ranges, gop_table, "smart", tolerance))
    return texts.smart_report(
        decisions.segment_reasons(plan, tolerance),
        decisions.report_summary(plan),
        gops.media_summary(media, gop_table),
        decisions.recommend(media, gop_table, tolerance),
    )


def analyze(
    media: DataFrame, packets: DataFrame, target_secs: float = 10.0, tolerance: float = 0.3
) -> DataFrame:
    """Reports from packets: GOPs, keyframe-aligned segments, plan, texts."""
    cut = segments.create_segments(media, gops.keyframes(packets), target_secs)
    spans = written(cut.select("asset_id", "segment_id", "start_ts", "end_ts"))
    return smart_reports(media, written(gops.gop_stats(packets)), spans, tolerance)
