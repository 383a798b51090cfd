"""How far to trust a canonical record: anomalies, completeness, flags, review, and the batch's rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.functions.text import rounded
from onefold.model import MOST_YEARS, REFERENCE_YEAR, REVIEW_THRESHOLD, SPARSE
from onefold.operators.resolve import SCALARS

_ANOMALY = "array<struct<type:string,field:string,detail:string>>"


def _one(when: Column, kind: str, field: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(field).alias("field"), detail.alias("detail")))


def anomalies(reference_year: int = REFERENCE_YEAR) -> Column:
    """Values that can't well be so, whoever agrees: array of (type, field, detail)."""
    years = F.col("years_experience")
    odd = F.array(_one((years < 0) | (years > MOST_YEARS), "implausible_years_experience", "years_experience", F.concat(years.cast("string"), F.lit(" years"))))

    def job(e: Column) -> Column:
        late = [_one(F.substring(e[k], 1, 4).cast("int") > reference_year, "future_date", "experience", F.concat(F.lit(f"{k}="), e[k])) for k in ("start", "end")]
        inverted = (F.length(e["start"]) == 7) & (F.length(e["end"]) == 7) & (e["start"] > e["end"])
        return F.array(*late, _one(inverted, "inverted_date_range", "experience", F.concat_ws(" > ", e["start"], e["end"])))

    jobs = F.flatten(F.transform("experience", job))
    studies = F.transform("education", lambda e: _one(e["end_year"] > reference_year, "future_date", "education", F.concat(F.lit("end_year="), e["end_year"].cast("string"))))
    tokens = F.regexp_extract_all(F.lower("full_name"), F.lit("([a-z]{3,})"), F.lit(1))
    shares = F.exists("emails", lambda m: F.exists(tokens, lambda t: F.contains(F.lower(F.substring_index(m, "@", 1)), t)))
    stranger = F.array(_one((F.size(tokens) > 0) & (F.size("emails") > 0) & ~shares, "email_name_mismatch", "emails", F.get(F.col("emails"), F.lit(0))))
    return F.array_compact(F.concat(*[x.cast(_ANOMALY) for x in (odd, jobs, studies, stranger)]))


def completeness() -> Column:
    filled = [F.col(x).isNotNull() for x in ("full_name", "location.country", "headline", "years_experience")] + [F.size(x) > 0 for x in ("emails", "phones", "skills", "experience", "education")]
    return rounded(sum((x.cast("int") for x in filled[1:]), filled[0].cast("int")) / F.lit(float(len(filled))))


def reported(people: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """people with anomalies, completeness, flags, review_reasons, needs_review, conflicts and low_confidence_fields."""
    people = people.withColumn("anomalies", anomalies()).withColumn("completeness", completeness())
    flag = lambda when, name: F.when(when, F.lit(name))
    sparse = F.col("completeness") < SPARSE
    flags = F.array_compact(F.array(flag(F.size("emails") == 0, "no_email"), flag(F.size("phones") == 0, "no_phone"), flag(F.size("skills") == 0, "no_skills"), flag(sparse, "sparse"), flag(F.size("anomalies") > 0, "anomaly")))
    fixed = F.array_compact(
        F.array(
            flag(F.size("emails") == 0, "no email address resolved"),
            F.when(F.col("overall_confidence") < threshold, F.concat(F.lit("overall_confidence "), F.col("overall_confidence").cast("string"), F.lit(f" < {threshold}"))),
            F.when(sparse, F.concat(F.lit("completeness "), F.col("completeness").cast("string"), F.lit(f" < {SPARSE}"))),
        )
    )
    reasons = F.concat(fixed, F.transform("anomalies", lambda a: F.concat(F.lit("anomaly: "), a["type"], F.lit(" ("), a["detail"], F.lit(")"))))
    conflict = lambda f: F.when(F.col(f"conflict_{f}"), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("chosen"), F.transform(F.filter(f"considered_{f}", lambda o: ~o["won"]), lambda o: F.struct(o["value"].alias("value"), o["source"].alias("source"))).alias("alternatives")))
    low = F.array_sort(F.filter(F.transform(F.map_entries("field_confidence"), lambda x: F.struct(x["key"].alias("field"), x["value"].alias("confidence"))), lambda x: x["confidence"] < threshold))
    return people.withColumns({"flags": flags, "review_reasons": reasons, "conflicts": F.array_compact(F.array(*map(conflict, SCALARS))), "low_confidence_fields": low}).withColumn("needs_review", F.size("review_reasons") > 0)


def rollup(people: DataFrame) -> DataFrame:
    """One row over all reported people; the averages of none are 0."""
    n = F.count("*")
    mean = lambda c: F.when(n > 0, rounded(F.sum(c) / n)).otherwise(F.lit(0.0))
    return people.agg(
        n.alias("total"),
        F.count_if(~F.col("needs_review")).alias("accepted"),
        F.count_if("needs_review").alias("needs_review"),
        F.coalesce(F.sum(F.size("anomalies")), F.lit(0)).cast("long").alias("anomalies"),
        mean("overall_confidence").alias("avg_confidence"),
        mean("completeness").alias("avg_completeness"),
    )


def conflict_counts(people: DataFrame) -> DataFrame:
    """(field, n): people whose sources conflicted on a field, most first."""
    return people.select(F.explode("conflicts.field").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")
