"""Normalizing records, their identity keys, and clustering them into people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onefold.functions import contact, dates, places, skills
from onefold.functions.text import clean, rounded, table
from onefold.model import FIELD_SOURCE_WEIGHT, METHOD_CERTAINTY, PRIORITY, SOURCE_WEIGHT, UNKNOWN_METHOD, UNKNOWN_SOURCE
from onefold.operators.components import components
from onefold.scratch import joined, written


def _mapped(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(table(values, "double"), key), F.lit(float(default)))


def priority(source: Column) -> Column:
    """The place of a source in the order of trust; unknown sources come last."""
    return _mapped({name: i for i, name in enumerate(PRIORITY)}, source, len(PRIORITY)).cast("int")


def base_confidence(source: Column, method: Column, field: str | None = None, weights: dict[str, float] | None = None) -> Column:
    """Trust in a source times the certainty of a method. A weight for (field, source) comes before a learned one, and that before the fixed."""
    weight = _mapped(SOURCE_WEIGHT | (weights or {}), source, UNKNOWN_SOURCE)
    for (of, name), value in FIELD_SOURCE_WEIGHT.items():
        if of == field:
            weight = F.when(source == name, F.lit(value)).otherwise(weight)
    return rounded(weight * _mapped(METHOD_CERTAINTY, method, UNKNOWN_METHOD))


def normalized(records: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Records with every field normalized: the values that resolution compares. What a field offered is counted in `given_*`."""
    emails, phones = contact.distinct_of(F.col("emails"), contact.email), contact.distinct_of(F.col("phones"), contact.phone)
    place = F.when(F.col("location").isNotNull(), places.place(F.col("location"))).when(F.col("location_text").isNotNull(), places.place_of_text(F.col("location_text")))
    job = lambda e: F.struct(clean(e["company"]).alias("company"), clean(e["title"]).alias("title"), dates.date(e["start"]).alias("start"), dates.date(e["end"]).alias("end"), clean(e["summary"]).alias("summary"))
    study = lambda e: F.struct(clean(e["institution"]).alias("institution"), clean(e["degree"]).alias("degree"), clean(e["field"]).alias("field"), dates.year(e["end_year"]).alias("end_year"))
    return records.withColumns(
        {
            "full_name": clean(F.col("full_name")),
            "headline": clean(F.col("headline")),
            "given_emails": F.size("emails"),
            "given_phones": F.size("phones"),
            "emails": emails,
            "phones": phones,
            "place": place,
            "skills": F.array_compact(skills.skills(F.col("skills"), fuzzy)),
            "experience": F.filter(F.transform("experience", job), lambda e: e["company"].isNotNull() | e["title"].isNotNull()),
            "education": F.filter(F.transform("education", study), lambda e: e["institution"].isNotNull() | e["degree"].isNotNull()),
            "handle": contact.handle(F.col("links.github")),
            "prio": priority(F.col("source")),
        }
    ).drop("location", "location_text")


def identity_keys(records: DataFrame) -> DataFrame:
    """(ord, key_type, key_value) of normalized records: e-mails, phones and handles, which are strong, and names, which aren't."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("key_type"), value.alias("key_value"))
    many = [F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: pair(kind, x)) for kind, column in (("email", "emails"), ("phone", "phones"))]
    one = [F.when(value.isNotNull(), F.array(pair(kind, F.lower(value)))).otherwise(F.array().cast("array<struct<key_type:string,key_value:string>>")) for kind, value in (("github", F.col("handle")), ("name", F.col("full_name")))]
    return records.select("ord", F.explode(F.array_distinct(F.concat(*many, *one))).alias("key")).select("ord", "key.*")


def links(keys: DataFrame) -> DataFrame:
    """(a, b): records to be linked. Each strong key links its records to the first; a name links only records without strong keys to its first record, if that has none either."""
    strong = keys.where("key_type <> 'name'")
    firsts = strong.groupBy("key_type", "key_value").agg(F.min("ord").alias("a"), F.max("ord").alias("last")).where("a < last").drop("last")
    by_key = joined(strong, firsts, ["key_type", "key_value"]).where("a < ord").select("a", F.col("ord").alias("b"))
    have = keys.groupBy("ord").agg(F.max(F.col("key_type") != "name").alias("strong"), F.max(F.when(F.col("key_type") == "name", F.col("key_value"))).alias("name")).where("name is not null")
    first_named = have.groupBy("name").agg(F.min_by("strong", "ord").alias("first_strong"), F.min("ord").alias("a"))
    by_name = joined(have.where("not strong"), first_named.where("not first_strong"), "name").where("a < ord").select("a", F.col("ord").alias("b"))
    return by_key.unionByName(by_name)


def clustered(records: DataFrame) -> DataFrame:
    """Normalized records with cluster_id, the least ord of those that links lead to."""
    found = components(links(identity_keys(records)), "a", "b")
    return joined(records, found, records["ord"] == found["node"], "left").withColumn("cluster_id", F.coalesce("component", "ord")).drop("node", "component")


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """(column, number) from 0 in the order of a column of distinct values, without one task that sees all rows."""
    dealt = written(ids.select(column).repartitionByRange(column).withColumn("part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return dealt.join(F.broadcast(counts.select("part", "before")), "part").select(column, (F.col("before") + place).alias("number"))
