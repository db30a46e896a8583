"""Quality gates: always measured, blocking only against a frozen threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.contract import finite


def gate(value: Column, threshold: float | None = None, higher_is_better: bool = True, applicable: Column | None = None) -> Column:
    """A struct of value, threshold, higher_is_better, measured_only, applicable, passed.

    Inapplicable passes; a value that is null, NaN or infinite fails; without a threshold any other passes; else the value is
    held against it, the threshold itself passing.
    """
    on = F.lit(True) if applicable is None else F.coalesce(applicable, F.lit(False))
    limit = F.lit(threshold).cast("double")
    held = F.lit(True) if threshold is None else (value >= limit) if higher_is_better else (value <= limit)
    passed = F.when(~on, True).when(~finite(value), False).otherwise(held)
    return F.struct(
        value.cast("double").alias("value"),
        limit.alias("threshold"),
        F.lit(higher_is_better).alias("higher_is_better"),
        F.lit(threshold is None).alias("measured_only"),
        on.alias("applicable"),
        passed.alias("passed"),
    )


def report(gates: dict[str, Column]) -> Column:
    """map of name -> gate, in order."""
    return F.create_map(*[x for name, g in gates.items() for x in (F.lit(name), g)])


def blocked_by(gates: dict[str, Column]) -> Column:
    """Names of the gates that didn't pass, in order."""
    return F.array_compact(F.array(*[F.when(~g["passed"], F.lit(name)) for name, g in gates.items()]))


def first_block(gates: dict[str, Column], slugs: dict[str, str] | None = None) -> Column:
    """Name, or slug, of the first gate that didn't pass; null if all did."""
    names = slugs or {}
    return F.coalesce(*[F.when(~g["passed"], F.lit(names.get(name, name))) for name, g in gates.items()])


def focus_depth(disparity: Column, least: float, most: float) -> dict[str, Column]:
    """Gates on the depth 1/disparity; a disparity <= 0 is infinitely far and passes neither."""
    depth = F.when(disparity > 0, F.lit(1.0) / disparity).otherwise(F.lit(float("inf")))
    return {"focus_depth_m_min": gate(depth, least), "focus_depth_m_max": gate(depth, most, False)}


def echoes_focal_length(crop_factor: Column) -> Column:
    """Mark, never a block: a crop factor of exactly one, within 1e-9."""
    return F.coalesce(F.abs(crop_factor - 1) < 1e-9, F.lit(False))
