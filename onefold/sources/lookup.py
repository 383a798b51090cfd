"""Profiles of a code host as tables: users by handle, and their repositories' languages. No live calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onefold.sources.common import record

#: Repositories of a user whose languages count, the latest first; and what a handle may be.
REPOSITORIES, HANDLE = 100, r"^[A-Za-z0-9][A-Za-z0-9-]{0,38}$"


def languages(repositories: DataFrame) -> DataFrame:
    """(handle, languages) of repositories (handle, language, at): each language once, in the order of at, the latest first."""
    turn = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("at"), "language"))
    latest = repositories.withColumn("turn", turn).where(F.col("turn") <= REPOSITORIES).where(F.coalesce("language", F.lit("")) != "")
    firsts = latest.groupBy("handle", "language").agg(F.min("turn").alias("turn"))
    return firsts.groupBy("handle").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "language"))), lambda x: x["language"]).alias("languages"))


def enriched(handles: DataFrame, users: DataFrame, repositories: DataFrame, place: list[str]) -> DataFrame:
    """Records of the users (handle, name, bio, location, email, blog, url) that `handles` (handle, and `place`) name; unknown ones have none."""
    known = handles.where(F.col("handle").rlike(HANDLE)).join(users, "handle").join(languages(repositories), "handle", "left")
    some = lambda name: F.when(F.col(name) != "", F.col(name))
    url = F.coalesce(some("url"), F.concat(F.lit("https://github.com/"), F.col("handle")))
    return record(
        known, "github", "api", place,
        full_name=some("name"),
        headline=some("bio"),
        location_text=some("location"),
        emails=F.when(some("email").isNotNull(), F.array("email")),
        links=F.struct(F.lit(None).cast("string").alias("linkedin"), url.alias("github"), some("blog").alias("portfolio"), F.lit(None).cast("array<string>").alias("other")),
        skills=F.col("languages"),
    )
