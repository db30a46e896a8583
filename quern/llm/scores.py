"""The score of an image: its latest valid sharpness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_scores(sharpness: DataFrame) -> DataFrame:
    """(image_id, score): laplacian_variance of the row with the latest measured_at, then the largest measurement_id, among
    an image's rows with a finite value >= 0. Null moments are earliest. An image without such a row isn't listed."""
    v = F.col("laplacian_variance")
    valid = sharpness.where(F.col("image_id").isNotNull() & (v >= 0) & (v < float("inf")))
    return valid.groupBy("image_id").agg(F.max_by("laplacian_variance", F.struct("measured_at", "measurement_id")).alias("score"))
