"""Source records made of the customer table by arithmetic on its keys, so that both engines read the same definition.

Planted: addresses in capitals and blanks, two phone formats, missing and broken contacts, names that differ between sources, records
that bridge two people, people without strong keys who share a name, ranges the wrong way round, and years to come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.model import RECORD

#: Runs in Spark and in DuckDB; {customer} is the table.
PEOPLE = """
SELECT k, first, last, 200 + k % 700 AS exchange, lpad(CAST(k % 10000 AS STRING), 4, '0') AS line, country, keyless FROM (
  SELECT c_custkey AS k,
         CASE c_custkey % 5 WHEN 0 THEN 'Jane' WHEN 1 THEN 'Carlos' WHEN 2 THEN 'Maria' WHEN 3 THEN 'Tom' ELSE 'Amina' END AS first,
         CASE c_custkey % 4 WHEN 0 THEN 'Doe' WHEN 1 THEN 'Reyes' WHEN 2 THEN 'Okafor' ELSE 'Lind' END AS last,
         CASE c_custkey % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'uk' WHEN 2 THEN ' Deutschland' WHEN 3 THEN 'India' WHEN 4 THEN 'Atlantis' ELSE '' END AS country,
         c_custkey % 13 = 0 AS keyless
  FROM {customer}) AS c
"""
_TEXTS = ("headline", "city", "region", "country", "github", "skills", "company", "title", "job_start", "job_end", "institution", "degree", "field", "end_year")
_BRANCHES = {
    1: ("recruiter_csv", "field_map", "k % 10 < 8", {
        "full_name": "CASE WHEN keyless THEN 'Sam Lee' || CAST(CAST(floor(k / 26.0) AS BIGINT) AS STRING) WHEN k % 9 = 2 THEN first || ' ' || last ELSE ' ' || first || ' Q. ' || last || ' ' END",
        "email": "CASE WHEN keyless OR k % 10 = 7 THEN '' WHEN k % 17 = 5 THEN 'not-an-email' ELSE ' ' || first || CAST(k AS STRING) || '@Example.COM ' END",
        "phone": "CASE WHEN keyless OR k % 11 = 4 THEN 'call-me-maybe' ELSE '(415) ' || CAST(exchange AS STRING) || '-' || line END",
        "company": "CASE k % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Globex' ELSE '' END", "title": "CASE WHEN k % 3 = 2 THEN '' ELSE 'Engineer' END",
    }),
    2: ("ats_json", "field_map", "k % 3 <> 0", {
        "full_name": "CASE WHEN keyless THEN 'Sam Lee' || CAST(CAST(floor(k / 26.0) AS BIGINT) AS STRING) ELSE first || ' ' || last END",
        "email": "CASE WHEN keyless THEN '' WHEN k % 29 = 3 THEN lower(CASE (k + 1) % 5 WHEN 0 THEN 'Jane' WHEN 1 THEN 'Carlos' WHEN 2 THEN 'Maria' WHEN 3 THEN 'Tom' ELSE 'Amina' END) || CAST(k + 1 AS STRING) || '@example.com' ELSE lower(first) || CAST(k AS STRING) || '@example.com' END",
        "phone": "CASE WHEN keyless THEN '' ELSE '+1 415 ' || CAST(exchange AS STRING) || ' ' || line END",
        "headline": "CASE WHEN k % 8 = 0 THEN '' ELSE 'Engineer' END", "years": "CAST(k % 70 AS DOUBLE)",
        "city": "'City' || CAST(k % 50 AS STRING)", "region": "CASE WHEN k % 2 = 0 THEN 'CA' ELSE '' END", "country": "country",
        "github": "CASE WHEN keyless OR k % 4 > 0 THEN '' ELSE 'https://github.com/User' || CAST(k AS STRING) || '/' END",
        "skills": "CASE k % 4 WHEN 0 THEN 'golang,postgres,Basket weaving' WHEN 1 THEN 'Python,reactjs' WHEN 2 THEN 'k8s,Python,py' ELSE '' END",
        "company": "CASE WHEN k % 2 = 0 THEN 'acme' ELSE 'Initech' END", "title": "'Engineer'",
        "job_start": "CASE WHEN k % 19 = 1 THEN '2022-05' WHEN k % 2 = 0 THEN 'Jan 2018' ELSE '2016' END", "job_end": "CASE WHEN k % 19 = 1 THEN '03/2021' WHEN k % 23 = 2 THEN '2031-01' ELSE 'present' END",
        "institution": "'MIT'", "degree": "CASE WHEN k % 2 = 0 THEN 'BSc' ELSE 'MSc' END", "field": "'Physics'", "end_year": "CASE WHEN k % 31 = 0 THEN '2031' ELSE CAST(1990 + k % 30 AS STRING) END",
    }),
    3: ("recruiter_notes", "regex", "k % 4 = 1", {
        "full_name": "first || ' ' || last",
        "email": "CASE WHEN keyless THEN '' ELSE lower(first) || CAST(k AS STRING) || '@example.com' END",
        "years": "CAST(k % 40 AS DOUBLE)", "skills": "'python,machine learning'",
        "github": "CASE WHEN k % 8 = 1 AND NOT keyless THEN '@user' || CAST(k AS STRING) ELSE '' END",
    }),
    4: ("resume", "regex", "k % 5 = 2", {
        "full_name": "first || ' ' || last",
        "email": "CASE WHEN keyless THEN '' ELSE 'cv' || CAST(k AS STRING) || '@mail.example.org' END",
        "phone": "CASE WHEN keyless THEN '' ELSE '415.' || CAST(exchange AS STRING) || '.' || line END",
        "headline": "'Senior Engineer'", "skills": "'Python,Terraform,Underwater hockey'",
        "company": "'Initech'", "title": "'engineer'", "job_start": "'2014-06'", "job_end": "'2015-12'",
        "institution": "'MIT'", "degree": "'bsc'", "field": "'physics'", "end_year": "'May 2016'",
    }),
}


def flat_sql(customer: str = "customer") -> str:
    """The records as flat columns, empty texts for what is absent."""
    parts = []
    for i, (source, method, where, fields) in _BRANCHES.items():
        columns = [f"k * 10 + {i} AS ord", f"'{source}' AS source", f"'{method}' AS method"]
        columns += [f"{fields.get(name, chr(39) * 2)} AS {name}" for name in ("full_name", "email", "phone", *_TEXTS)]
        parts.append(f"SELECT {', '.join(columns)}, {fields.get('years', 'CAST(NULL AS DOUBLE)')} AS years FROM ({PEOPLE.format(customer=customer)}) AS p WHERE {where}")
    return " UNION ALL ".join(parts)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(flat_sql("{customer}"), customer=customers)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as sources give them: model.RECORD."""
    some = lambda name: F.when(F.col(name) != "", F.col(name))
    one = lambda name: F.when(F.col(name) != "", F.array(name))
    none = F.lit(None).cast("string")
    fields = {
        "full_name": some("full_name"),
        "headline": some("headline"),
        "years_experience": F.col("years"),
        "emails": one("email"),
        "phones": one("phone"),
        "location": F.when(F.col("city") != "", F.struct("city", "region", "country")),
        "location_text": none,
        "links": F.when(F.col("github") != "", F.struct(none.alias("linkedin"), F.col("github"), none.alias("portfolio"), F.lit(None).cast("array<string>").alias("other"))),
        "skills": F.when(F.col("skills") != "", F.split("skills", ",")),
        "experience": F.when(F.coalesce(some("company"), some("title")).isNotNull(), F.array(F.struct("company", "title", F.col("job_start").alias("start"), F.col("job_end").alias("end"), none.alias("summary")))),
        "education": F.when(F.col("institution") != "", F.array(F.struct("institution", "degree", "field", "end_year"))),
    }
    return flat(spark, sf_dir).select("ord", "source", "method", *[fields[name].cast(kind).alias(name) for name, kind in RECORD.items() if name in fields])
