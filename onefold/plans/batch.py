"""A folder of mixed sources to people, with a trust report and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.model import REVIEW_THRESHOLD
from onefold.operators import projection, trust
from onefold.operators.records import clustered, normalized, numbered
from onefold.operators.resolve import candidate_ids, gathered, resolved
from onefold.sources import ats, csv, lookup, text
from onefold.scratch import joined, written


def listed(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(kind, path) of what lies in a folder, by name: notes, resumes, docx, csv or ats. Files of other kinds are passed over; no folder, nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    out = []
    for entry in sorted(fs.listStatus(at), key=lambda e: e.getPath().getName()):
        path, name = entry.getPath(), entry.getPath().getName().lower()
        if entry.isDirectory():
            kind = "notes" if name in ("notes", "recruiter_notes") else "resumes" if name in ("resumes", "resume") else None
            for inside in sorted((x.getPath() for x in fs.listStatus(path)), key=lambda p: p.getName()) if kind else []:
                if inside.getName().lower().endswith(".txt"):
                    out.append((kind, inside.toString()))
                elif kind == "resumes" and inside.getName().lower().endswith(".docx"):
                    out.append(("docx", inside.toString()))
        elif name.endswith((".csv", ".docx")):
            out.append((name.rsplit(".", 1)[1], path.toString()))
        elif name.endswith(".json") and "config" not in name:
            out.append(("ats", path.toString()))
        elif name.endswith(".txt"):
            out.append(("notes", path.toString()))
    return out


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The records of a folder, in the order of names, then of places in a file. A source that can't be read gives none."""
    readers = {"csv": csv.read, "ats": ats.read, "notes": text.read_notes, "resumes": text.read_resumes, "docx": text.read_docx}
    files: dict[str, list[str]] = {}
    for kind, path in listed(spark, folder):
        files.setdefault(kind, []).append(path)
    parts = [readers[kind](spark, paths).withColumn("at", F.col("at").cast("long")) for kind, paths in files.items()]
    return ordered(reduce(DataFrame.unionByName, parts), ["path", "at"]) if parts else None


def ordered(records: DataFrame, place: list[str]) -> DataFrame:
    """Records with ord, their number in the order of `place`."""
    records = written(records.withColumn("_key", F.struct(*place)), "records")
    return joined(records, numbered(records, "_key"), "_key").withColumnRenamed("number", "ord").drop("_key", *place)


def people(records: DataFrame, weights: dict[str, float] | None = None, threshold: float = REVIEW_THRESHOLD, users: DataFrame | None = None, repositories: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Reported canonical records of `records`. Profiles of users join a cluster after it was made, so they link nothing."""
    known = clustered(normalized(records, fuzzy))
    if users is not None:
        first = known.where("handle is not null").groupBy("cluster_id").agg(F.min_by("handle", "ord").alias("handle"), F.min("ord").alias("from"))
        found = lookup.enriched(first, users, repositories, ["cluster_id"]).withColumn("ord", F.lit((1 << 62)))
        known = known.unionByName(normalized(found, fuzzy), allowMissingColumns=True)
    groups = gathered(known)
    with_ids = candidate_ids(groups, numbered(groups, "cluster_id"))
    return trust.reported(resolved(with_ids, weights=weights), threshold)


def run(spark: SparkSession, folder: str, config: dict | None = None, **options) -> dict[str, DataFrame]:
    """profiles, errors, people and trust of a folder."""
    records = read(spark, folder)
    if records is None:
        raise FileNotFoundError(f"nothing to read in {folder}")
    found = written(people(records, **options), "people")
    profiles, errors = projection.parted(projection.projected(found.orderBy("cluster_id"), config))
    return {"profiles": profiles, "errors": errors, "people": found, "trust": trust.rollup(found)}


def reporting() -> list[Column | str]:
    """What the trust report of a person tells besides their id, with the explanation of every field that has one."""
    told = [f for f in ("full_name", "headline", "years_experience", "emails", "phones")]
    explain = F.struct(*[F.when(F.col(f"reason_{f}").isNotNull(), F.struct(F.col(f).alias("chosen"), F.col(f"c_{f}").alias("confidence"), F.col(f"considered_{f}").alias("considered"), F.col(f"reason_{f}").alias("reason"))).alias(f) for f in told])
    return ["overall_confidence", "completeness", "conflicts", "low_confidence_fields", "anomalies", "flags", "needs_review", "review_reasons", explain.alias("explain")]


def report(people: DataFrame) -> DataFrame:
    """The trust report of each person."""
    return people.select("candidate_id", *reporting())


def save(found: dict[str, DataFrame], folder: str) -> None:
    """Writes what `run` gives as JSON lines, nulls too: profiles, errors, report and trust, a folder each."""
    for name, rows in (found | {"report": report(found["people"])}).items():
        if name != "people":
            rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
