"""Recruiters' CSV exports: name, email, phone, current_company and title; headers in any case and spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.functions.text import clean
from onefold.sources.common import record

COLUMNS = ("name", "email", "phone", "current_company", "title")


def records(rows: DataFrame, place: list[str]) -> DataFrame:
    """Records of rows with some of COLUMNS. Company and title are one open-ended job."""
    named = {c.strip().lower(): c for c in rows.columns}
    value = {name: clean(F.col(f"`{named[name]}`").cast("string")) if name in named else F.lit(None).cast("string") for name in COLUMNS}
    job = F.struct(value["current_company"].alias("company"), value["title"].alias("title"), *[F.lit(None).cast("string").alias(x) for x in ("start", "end", "summary")])
    return record(
        rows, "recruiter_csv", "field_map", place,
        full_name=value["name"],
        emails=F.when(value["email"].isNotNull(), F.array(value["email"])),
        phones=F.when(value["phone"].isNotNull(), F.array(value["phone"])),
        experience=F.when(value["current_company"].isNotNull() | value["title"].isNotNull(), F.array(job)),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    return records(rows.withColumn("path", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id()), ["path", "at"])
