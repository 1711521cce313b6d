"""Scope filters as cumulative stages, and visibility rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.geo import great_circle_km, in_box


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """One row: n_all, then rows left after each stage and all before it. One pass, nothing shuffled but one row a task."""
    counts, so_far = [F.count("*").alias("n_all")], F.lit(True)
    for name, stage in stages.items():
        so_far = so_far & stage
        counts.append(F.count_if(so_far).alias(name))
    return df.agg(*counts)


def sole_culprit(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """One row: per stage, the rows that only this stage keeps out."""
    missed = {name: ~F.coalesce(stage, F.lit(False)) for name, stage in stages.items()}
    total = sum((m.cast("int") for m in missed.values()), F.lit(0))
    return df.agg(*(F.count_if(m & (total == 1)).alias(name) for name, m in missed.items()))


def radius(lat: str, lon: str, centre: tuple[float, float], km: float) -> Column:
    """Inside a circle; the box in front of it reaches the scan. Null coordinates are outside."""
    near = in_box(lat, lon, *centre, km) & (great_circle_km(lat, lon, *centre) <= km)
    return F.coalesce(near, F.lit(False))


def structured_or_extracted(structured: str, extracted: str, confidence: str, least: float = 0.6) -> Column:
    """A structured value, else an extracted one of enough confidence."""
    return F.coalesce(F.col(structured), F.when(F.col(confidence) >= least, F.col(extracted)))


def elevator_allowed(has_elevator: str, required: bool) -> Column:
    """Unknown passes."""
    return ~F.col(has_elevator).eqNullSafe(F.lit(False)) if required else F.lit(True)


def not_rejected(state: str) -> Column:
    return ~F.col(state).eqNullSafe(F.lit("reject"))


def visible(df: DataFrame, active: str, open_: str) -> DataFrame:
    """Entities with no active listing at all, or one from an enabled source."""
    return df.filter((F.coalesce(active, F.lit(0)) == 0) | (F.col(open_) > 0))
