"""What the review console asks: the inbox, its summary, and the cards of one person's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.functions.text import rounded


def band(c: Column) -> Column:
    return F.when(c.isNull(), "na").when(c >= 0.85, "high").when(c >= 0.6, "mid").otherwise("low")


def percent(c: Column) -> Column:
    """Cut off, not rounded."""
    return (c * F.lit(100.0)).cast("int")


def status(people: DataFrame) -> Column:
    own = F.when(F.col("needs_review"), "needs_review").otherwise("accepted")
    return F.when(F.col("status") == "reviewed", "reviewed").otherwise(own) if "status" in people.columns else own


def inbox(people: DataFrame) -> DataFrame:
    """A row for each person, those to be reviewed first, then by confidence."""
    rows = people.select("candidate_id", F.coalesce("full_name", "candidate_id").alias("name"), status(people).alias("status"), "overall_confidence", "completeness", F.size("conflicts").cast("long").alias("conflicts"), F.array_join("flags", ",").alias("flags"))
    return rows.orderBy(F.col("status") != "needs_review", "overall_confidence", "candidate_id")


def summary(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(rounded(F.avg(c), 1_000.0), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "needs_review", "reviewed")],
        F.count_if(F.col("conflicts") > 0).alias("with_conflicts"),
        mean("overall_confidence").alias("avg_confidence"),
        mean("completeness").alias("avg_completeness"),
    )


def span(start: Column, end: Column) -> Column:
    return F.concat(F.coalesce(start, F.lit("?")), F.lit(" – "), F.coalesce(end, F.lit("present")))


def cards(people: DataFrame) -> DataFrame:
    """(candidate_id, field, display, confidence, band, sources): what is shown of each field."""
    shown = {
        "full_name": F.col("full_name"),
        "headline": F.col("headline"),
        "years_experience": F.col("years_experience").cast("string"),
        "emails": F.array_join("emails", ", "),
        "phones": F.array_join("phones", ", "),
        "location": F.concat_ws(", ", "location.city", "location.region", "location.country"),
        "skills": F.array_join("skills.name", ", "),
        "experience": F.array_join(F.transform("experience", lambda e: F.concat(F.concat_ws(" at ", e["title"], e["company"]), F.lit(" ("), span(e["start"], e["end"]), F.lit(")"))), "; "),
        "education": F.array_join(F.transform("education", lambda e: F.concat_ws(", ", e["degree"], e["field"], e["institution"], e["end_year"].cast("string"))), "; "),
    }
    sources = lambda name: F.array_distinct(F.transform(F.filter("provenance", lambda p: p["field"] == name), lambda p: p["source"]))
    card = lambda name, text: F.struct(F.lit(name).alias("field"), text.alias("display"), F.try_element_at("field_confidence", F.lit(name)).alias("confidence"), sources(name).alias("sources"))
    rows = people.select("candidate_id", F.explode(F.array(*[card(name, text) for name, text in shown.items()])).alias("card")).select("candidate_id", "card.*")
    return rows.withColumn("band", band(F.col("confidence")))
