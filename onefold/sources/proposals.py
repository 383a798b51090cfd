"""Fields that a language model proposed for a text, kept only where the text has them. The model itself is not called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.sources.common import record

#: White space, spelled out so that every engine takes the same characters for it.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def folded(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, WHITE + "+", " ")))


def grounded(value: Column, text: Column) -> Column:
    """Whether a text has a value, in any case and spacing."""
    return F.coalesce((folded(value) != "") & F.contains(folded(text), folded(value)), F.lit(False))


def grounded_number(value: Column, text: Column) -> Column:
    """Whether a text has a number by itself, also as a whole number."""
    plain = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.coalesce(F.rlike(text, F.concat(F.lit(r"(?<![0-9.])"), F.replace(plain, F.lit("."), F.lit(r"\.")), F.lit(r"(?:\.0)?(?![0-9.]*[0-9])"))), F.lit(False))


def grounded_phone(value: Column, text: Column) -> Column:
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return F.coalesce((digits(value) != "") & F.contains(digits(text), digits(value)), F.lit(False))


def verified(rows: DataFrame, place: list[str], text: str = "text") -> DataFrame:
    """Records of proposals (fields named as a record's) that their text bears out; a country that only was inferred goes."""
    t = F.col(text)
    own = lambda name: F.when(grounded(F.col(name), t), F.col(name))
    kept = lambda name, test: F.filter(name, lambda x: test(x, t))
    filled = lambda c: F.when(F.size(c) > 0, c)
    part = lambda e, name: F.when(grounded(e[name], t), e[name]).alias(name)
    city = F.when(grounded(F.col("location.city"), t), F.col("location.city"))
    jobs = F.filter(F.transform("experience", lambda e: F.struct(*[part(e, x) for x in ("company", "title", "start", "end", "summary")])), lambda e: e["company"].isNotNull() | e["title"].isNotNull())
    studies = F.filter(F.transform("education", lambda e: F.struct(*[part(e, x) for x in ("institution", "degree", "field", "end_year")])), lambda e: e["institution"].isNotNull() | e["degree"].isNotNull())
    return record(
        rows, "resume", "llm", place,
        full_name=own("full_name"),
        headline=own("headline"),
        years_experience=F.when(grounded_number(F.col("years_experience"), t), F.col("years_experience")),
        emails=filled(kept("emails", grounded)),
        phones=filled(kept("phones", grounded_phone)),
        location=F.when(city.isNotNull(), F.struct(city.alias("city"), F.when(grounded(F.col("location.region"), t), F.col("location.region")).alias("region"), F.when(grounded(F.col("location.country"), t), F.col("location.country")).alias("country"))),
        skills=filled(kept("skills", grounded)),
        experience=filled(jobs),
        education=filled(studies),
    )
