"""What the sources share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.model import FIELDS


def record(rows: DataFrame, source: str, method: str, place: list[str], **fields: Column) -> DataFrame:
    """Rows with all fields of a record (those not given are null) and `place`, columns that order them; rows with no field go."""
    columns = [fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]
    out = rows.select(*place, F.lit(source).alias("source"), F.lit(method).alias("method"), *columns)
    return out.where(F.coalesce(*[F.when(F.col(name).isNotNull(), True) for name in FIELDS], F.lit(False)))


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at what Python takes for line ends."""
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
