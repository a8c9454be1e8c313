"""Per-frame measures from luma planes, and scene changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gopmill.functions.timing import histogram_distance
from gopmill.operators import slices

# They must equal the published behaviour for right results.
HISTOGRAM_BINS = 64
BIN_WIDTH = 256 // HISTOGRAM_BINS
VARIANCE_SCALE = 4000.0
SCENE_CHANGE_THRESHOLD = 0.30

FEATURES_SCHEMA = "asset_id bigint, frame_idx bigint, histogram array<double>, complexity double"


def features_from_pixels(pixels: DataFrame) -> DataFrame:
    """(asset_id, frame_idx, histogram, complexity) from one row per pixel (asset_id, frame_idx, gray).

    Pixels are counted by gray level's bin with exact integer sums, so at most 64 rows a frame are shuffled
    however large the frame is.
    """
    gray = F.col("gray").cast("bigint")
    binned = (
        pixels.withColumn("_bin", F.least(F.floor(gray / BIN_WIDTH), F.lit(HISTOGRAM_BINS - 1)).cast("int"))
        .groupBy("asset_id", "frame_idx", "_bin")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.sum(gray).alias("_sum"), F.sum(gray * gray).alias("_squares"),
        )
    )
    framed = binned.groupBy("asset_id", "frame_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"),
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.sum("_squares").alias("_squares"),
    )
    n = F.col("_n").cast("double")
    mean = F.col("_sum") / n
    variance = F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0))
    histogram = F.transform(
        F.sequence(F.lit(0), F.lit(HISTOGRAM_BINS - 1)),
        lambda b: F.coalesce(F.element_at("_counts", b), F.lit(0)).cast("double") / n,
    )
    return framed.select(
        "asset_id", "frame_idx", histogram.alias("histogram"),
        F.least(variance / VARIANCE_SCALE, F.lit(1.0)).alias("complexity"),
    )


def _measure_plane(gray: memoryview, width: int, height: int, stride: int) -> tuple[np.ndarray, float]:
    """Histogram and complexity of one plane; an empty frame has no share in any bin."""
    total = width * height
    if total == 0:
        return np.full(HISTOGRAM_BINS, np.nan), 0.0
    # the last row of a plane may stop short of its stride
    plane = np.frombuffer(gray, dtype=np.uint8)
    rows = np.lib.stride_tricks.as_strided(plane, (height, width), (stride, 1), writeable=False)
    counts = np.bincount(rows.ravel(), minlength=256)
    levels = np.arange(256)
    mean = counts @ levels / total
    variance = counts @ (levels - mean) ** 2 / total
    return counts.reshape(HISTOGRAM_BINS, BIN_WIDTH).sum(axis=1) / total, min(float(variance) / VARIANCE_SCALE, 1.0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = zip(*(batch.column(name).to_pylist() for name in ("width", "height", "stride")))
        measured = [
            _measure_plane(gray.as_buffer(), *shape) for gray, shape in zip(batch.column("gray"), shapes)
        ]
        histograms = [histogram.tolist() for histogram, _ in measured]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("asset_id"),
                batch.column("frame_idx"),
                pa.array(histograms, pa.list_(pa.float64())),
                pa.array([complexity for _, complexity in measured], pa.float64()),
            ],
            names=["asset_id", "frame_idx", "histogram", "complexity"],
        )


def frame_features(frames: DataFrame) -> DataFrame:
    """The same table from binary planes (asset_id, frame_idx, width, height, stride, gray).

    A plane shorter than its geometry fails the job rather than read past it. A full-HD plane is 2 MB, so set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` to some tens for such frames.
    """
    needed = F.when(
        (F.col("width") == 0) | (F.col("height") == 0), F.lit(0)
    ).otherwise((F.col("height") - 1) * F.col("stride") + F.col("width"))
    checked = frames.select(
        "asset_id", "frame_idx", "width", "height", "stride",
        F.when(F.length("gray") >= needed, F.col("gray"))
        .otherwise(F.raise_error(F.lit("luma plane is shorter than its geometry")).cast("binary"))
        .alias("gray"),
    )
    return checked.mapInArrow(_measure, FEATURES_SCHEMA)


def scene_changes(
    features: DataFrame, threshold: float = SCENE_CHANGE_THRESHOLD, slice_rows: int = slices.SLICE_ROWS
) -> DataFrame:
    """Features with ``distance`` to the frame before and ``is_scene_change``; a first frame is never one.

    Frame numbers need not be dense, only unique and ascending within an asset.
    """
    paired = slices.previous(
        features, ["asset_id"], slices.slice_of("frame_idx", slice_rows), ["frame_idx"], {"histogram": "_before"}
    )
    distance = histogram_distance(F.col("_before"), F.col("histogram"))
    return paired.withColumn("distance", F.when(F.col("_before").isNotNull(), distance)).select(
        "asset_id", "frame_idx", "complexity", "distance",
        F.coalesce(F.col("distance") > threshold, F.lit(False)).alias("is_scene_change"),
    )


def analysis_counts(frames: DataFrame) -> DataFrame:
    """Frames, keyframes and scene changes per asset."""
    return frames.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("is_key").alias("keyframes"),
        F.count_if("is_scene_change").alias("scene_changes"),
    )
