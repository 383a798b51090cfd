"""Weights of sources learned from corrections: the more often a source is overruled, the less it weighs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.functions.text import rounded
from onefold.model import DAMPING, FLOOR, SOURCE_WEIGHT


def report(spark: SparkSession, displaced: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each known source: base and calibrated weight, how often it was overruled and used, and the rate.

    `displaced` has a row (source) for each correction of a value that a source had won, `records` one for each record.
    """
    known = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(SOURCE_WEIGHT.items())], "place int, source string, base_weight double")
    overrides = displaced.groupBy("source").agg(F.count("*").alias("overrides"))
    exposure = records.groupBy("source").agg(F.count("*").alias("exposure"))
    out = known.join(overrides, "source", "left").join(exposure, "source", "left").fillna(0, ["overrides", "exposure"])
    rate = F.col("overrides") / F.greatest(F.lit(1), F.col("exposure"))
    factor = F.greatest(F.lit(FLOOR), F.lit(1.0) - F.lit(DAMPING) * rate)
    return out.select("place", "source", "base_weight", rounded(F.col("base_weight") * factor).alias("calibrated_weight"), "overrides", "exposure", rounded(rate).alias("override_rate"))


def weights(calibrated: DataFrame) -> dict[str, float] | None:
    """What resolution takes (six rows at most), or None while nothing was corrected."""
    rows = calibrated.collect()
    return {r["source"]: r["calibrated_weight"] for r in rows} if any(r["overrides"] for r in rows) else None
