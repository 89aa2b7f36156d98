"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators import timestamps


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, samples = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lme_questions", "locomo_samples"))
    return timestamps.question_stamps(questions).unionByName(timestamps.sample_stamps(samples))


# The zones that devices of these tables use.
ZONES = ["UTC", "America/Los_Angeles", "America/New_York", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney", "Europe/Berlin", "Europe/London"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date that denotes an instant; where the zone is null, UTC holds unless the order of the dates speaks clearly for others."""
    questions, samples = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lme_questions", "locomo_samples"))
    return timestamps.found_stamps(questions, samples, ZONES)


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For records without a zone, how many of their dates fall in each zone of the history that fits best."""
    told = timestamps.estimate_zones(_stamps(spark, sf_dir), ["record_id", "row"], "stamp_no", "written", "locale", "time_zone", ZONES)
    zones = told.select("record_id", "violations", "dates", F.inline_outer("history")).where("zone IS NOT NULL OR dates = 0")
    return zones.groupBy("record_id", "zone", "violations", "dates").agg(F.count("zone").alias("in_zone"))


QUERIES = {"p2_found": p2_found, "p2_zones": p2_zones}
ORACLES: dict[str, str] = {}
