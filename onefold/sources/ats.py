"""JSON of applicant tracking systems, whose vocabulary is mapped to ours. Broken JSON gives no records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.functions.text import clean
from onefold.sources.common import record, texts


def _text(v: Column, *paths: str) -> Column:
    """The first of some paths with a value that isn't empty, false or zero, as text."""
    found = [F.try_variant_get(v, path, "string") for path in paths]
    return F.coalesce(*[F.when(~x.isin("", "0", "false", "[]", "{}"), x) for x in found], F.lit(None).cast("string"))


def _list(v: Column, *paths: str) -> Column:
    found = [F.try_variant_get(v, path, "array<variant>") for path in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])


def _objects(v: Column, *paths: str) -> Column:
    return F.filter(_list(v, *paths), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def records(rows: DataFrame, place: list[str], column: str = "v") -> DataFrame:
    """Records of rows with a variant for each applicant; what is no object gives none."""
    v = F.col(column)
    rows = rows.where(F.schema_of_variant(v).startswith("OBJECT"))
    word = lambda *paths: clean(_text(v, *paths))
    one = lambda x: F.when(x.isNotNull(), F.array(x))
    state, city, country = word("$.state"), word("$.city"), word("$.country")
    years = F.when(F.schema_of_variant(F.try_variant_get(v, "$.experience_years", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|BOOLEAN)"), F.try_variant_get(v, "$.experience_years", "double"))
    handle = word("$.github", "$.github_username")
    none = F.lit(None).cast("string")
    job = lambda w: F.struct(
        clean(_text(w, "$.org", "$.company")).alias("company"), clean(_text(w, "$.role", "$.title")).alias("title"), _text(w, "$.from", "$.start").alias("start"), _text(w, "$.to", "$.end").alias("end"), clean(_text(w, "$.summary")).alias("summary")
    )
    study = lambda s: F.struct(clean(_text(s, "$.name", "$.institution")).alias("institution"), clean(_text(s, "$.degree")).alias("degree"), clean(_text(s, "$.major", "$.field")).alias("field"), _text(s, "$.grad_year", "$.end_year").alias("end_year"))
    jobs, studies = _objects(v, "$.work_history"), _objects(v, "$.schools", "$.education")
    tags = _list(v, "$.tags", "$.skills")
    return record(
        rows, "ats_json", "field_map", place,
        full_name=word("$.applicant_name", "$.full_name"),
        emails=one(word("$.contact.email_address", "$.email")),
        phones=one(word("$.contact.mobile", "$.contact.phone")),
        location=F.when(F.coalesce(city, state, country).isNotNull(), F.struct(city.alias("city"), state.alias("region"), country.alias("country"))),
        headline=word("$.job_title"),
        years_experience=years,
        skills=F.transform(F.filter(tags, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string")),
        links=F.when(handle.isNotNull(), F.struct(none.alias("linkedin"), handle.alias("github"), none.alias("portfolio"), F.lit(None).cast("array<string>").alias("other"))),
        experience=F.when(F.size(jobs) > 0, F.transform(jobs, job)),
        education=F.when(F.size(studies) > 0, F.transform(studies, study)),
    )


def applicants(files: DataFrame) -> DataFrame:
    """(path, at, v): the applicants of files (path, text), from a list or from candidates or applicants of an object."""
    parsed = files.select("path", F.try_parse_json("text").alias("file"))
    found = F.coalesce(F.try_variant_get("file", "$", "array<variant>"), _list(F.col("file"), "$.candidates", "$.applicants"))
    return parsed.select("path", F.posexplode(found).alias("at", "v"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return records(applicants(texts(spark, path)), ["path", "at"])
