"""The queries over the driver's tables, each with its SQL: what an operator gives, as flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.functions import contact, dates, places, skills
from onefold.operators import projection, records, trust
from onefold.operators.resolve import candidate_ids, gathered, resolved
from onefold.plans import derived, oracle
from onefold.scratch import joined, written

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def query(sql: str | None = None, chain: bool = True) -> Callable[[Query], Query]:
    """Registers a query by its name, with SQL over the chain of the oracle or by itself."""

    def register(run: Query) -> Query:
        FOUND[run.__name__] = run, oracle.sql(sql) if sql and chain else sql
        return run

    return register


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, made once in a session and written to the scratch folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = written(make(), name)
    return _TABLES[key]


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.normalized(derived.records(spark, sf_dir))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "clustered", lambda: records.clustered(normal(spark, sf_dir)))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        groups = gathered(clustered(spark, sf_dir))
        return trust.reported(resolved(candidate_ids(groups, records.numbered(clustered(spark, sf_dir).select("cluster_id").distinct(), "cluster_id"))))

    return stored(spark, sf_dir, "people", make)


# scans and normalizers


@query("SELECT source, count(*) AS n FROM src GROUP BY source")
def source_exposure(spark, sf_dir):
    return derived.records(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT ord, source, method, full_name, headline, years_experience, email, phone, handle FROM n")
def source_records(spark, sf_dir):
    return normal(spark, sf_dir).select("ord", "source", "method", "full_name", "headline", "years_experience", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), "handle")


@query("SELECT ord, email AS given, " + oracle.email("email") + " AS email FROM src")
def norm_email(spark, sf_dir):
    return derived.flat(spark, sf_dir).select("ord", F.col("email").alias("given"), contact.email(F.col("email")).alias("email"))


@query("SELECT ord, phone AS given, " + oracle.phone("phone") + " AS phone FROM src")
def norm_phone(spark, sf_dir):
    return derived.flat(spark, sf_dir).select("ord", F.col("phone").alias("given"), contact.phone(F.col("phone")).alias("phone"))


@query("SELECT ord, " + ", ".join(f"{oracle.date(x)} AS {x}" for x in ("job_start", "job_end", "end_year")) + f", CAST(substr({oracle.date('end_year')}, 1, 4) AS INTEGER) AS year FROM src")
def norm_date(spark, sf_dir):
    return derived.flat(spark, sf_dir).select("ord", *[dates.date(F.col(x)).alias(x) for x in ("job_start", "job_end", "end_year")], dates.year(F.col("end_year")).alias("year"))


@query(f"SELECT ord, {oracle.COUNTRY} AS country FROM src")
def norm_country(spark, sf_dir):
    return derived.flat(spark, sf_dir).select("ord", places.country(F.col("country")).alias("country"))


@query("SELECT ord, city, nullif(trim(region), '') AS region, country FROM (SELECT ord, nullif(trim(city), '') AS city, CASE WHEN code IS NULL AND trim(country) <> '' AND region = '' THEN trim(country) ELSE region END AS region, code AS country FROM (SELECT *, " + oracle.COUNTRY + " AS code FROM src WHERE city <> ''))")
def norm_location(spark, sf_dir):
    rows = derived.flat(spark, sf_dir).where("city <> ''")
    return rows.select("ord", places.place_of_text(F.concat_ws(", ", "city", "region", "country")).alias("p")).select("ord", "p.*")


@query(f"SELECT ord, pos, {oracle.SKILL} AS skill FROM (SELECT ord, generate_subscripts(string_split(skills, ','), 1) - 1 AS pos, trim(unnest(string_split(skills, ','))) AS s FROM src WHERE skills <> '')")
def norm_skill_alias(spark, sf_dir):
    return derived.flat(spark, sf_dir).where("skills <> ''").select("ord", F.posexplode(skills.skills(F.split("skills", ","), fuzzy=False)).alias("pos", "skill")).withColumn("pos", F.col("pos").cast("long"))


@query()
def norm_skill_fuzzy(spark, sf_dir):
    return derived.flat(spark, sf_dir).where("skills <> ''").select("ord", F.posexplode(skills.skills(F.split("skills", ","))).alias("pos", "skill"))


@query(f"SELECT ord, {oracle.HANDLE} AS handle FROM src WHERE github <> ''")
def norm_handle(spark, sf_dir):
    return derived.flat(spark, sf_dir).where("github <> ''").select("ord", contact.handle(F.col("github")).alias("handle"))


@query("SELECT ord, source, method, " + ", ".join(f"{oracle.base(f)} AS b_{f}" for f in ("full_name", "emails", "skills")) + " FROM src")
def base_confidence(spark, sf_dir):
    s, m = F.col("source"), F.col("method")
    return derived.flat(spark, sf_dir).select("ord", "source", "method", *[records.base_confidence(s, m, f).alias(f"b_{f}") for f in ("full_name", "emails", "skills")])


# linkage


@query("SELECT ord, key_type, key_value FROM keys")
def identity_keys(spark, sf_dir):
    return records.identity_keys(normal(spark, sf_dir))


@query("SELECT a, b FROM edge")
def identity_links(spark, sf_dir):
    return records.links(records.identity_keys(normal(spark, sf_dir))).distinct()


@query("SELECT ord, cluster_id FROM cl")
def cluster_components(spark, sf_dir):
    return clustered(spark, sf_dir).select("ord", "cluster_id")


@query("SELECT h.ord, d.a AS first FROM have h JOIN named d ON h.name = d.name WHERE NOT h.strong AND NOT d.strong AND d.a < h.ord")
def cluster_name_fallback(spark, sf_dir):
    keys = records.identity_keys(normal(spark, sf_dir))
    weak = joined(keys, keys.where("key_type <> 'name'").select("ord").distinct(), "ord", "left_anti").select("ord")
    return joined(records.links(keys), weak, F.col("b") == weak["ord"]).select("ord", F.col("a").alias("first"))


@query("SELECT cluster_id, candidate_id FROM ids")
def batch_candidate_id(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", "candidate_id")


# resolution


def _scalar(field: str) -> None:
    def run(spark, sf_dir):
        p = people(spark, sf_dir).where(F.col(field).isNotNull())
        return p.select("cluster_id", F.col(field).alias("value"), F.col(f"c_{field}").alias("confidence"), F.col(f"conflict_{field}").alias("conflict"), F.col(f"n_agree_{field}").cast("long").alias("n_agree"), F.col(f"n_distinct_{field}").cast("long").alias("n_distinct"))

    run.__name__ = f"resolve_{field}"
    query(f"SELECT cluster_id, value, confidence, conflict, n_agree, n_distinct FROM s_{field}")(run)


def _considered(field: str) -> None:
    def run(spark, sf_dir):
        p = people(spark, sf_dir).select("cluster_id", F.posexplode(f"considered_{field}").alias("pos", "o"))
        return p.select("cluster_id", F.col("pos").cast("long").alias("pos"), F.col("o.value").alias("value"), F.col("o.source").alias("source"), F.col("o.method").alias("method"), F.col("o.base").alias("base"), F.col("o.won").alias("won"))

    run.__name__ = f"considered_{field}"
    query(f"SELECT o.cluster_id, rn - 1 AS pos, CAST(o.value AS VARCHAR) AS value, o.source, o.method, o.base, o.value = w.value AND o.source = w.source AND o.method = w.method AS won FROM o_{field} o JOIN w_{field} w ON o.cluster_id = w.cluster_id")(run)


def _list(field: str, one: str) -> None:
    def run(spark, sf_dir):
        p = people(spark, sf_dir).where(F.size(field) > 0)
        return p.select("cluster_id", F.array_join(field, ",").alias("vals"), F.size(field).cast("long").alias("n_values"), F.col(f"c_{field}").alias("confidence"), F.col(f"dropped_{field}").cast("long").alias("dropped"))

    run.__name__ = f"resolve_{field}"
    query(f"SELECT s.cluster_id, vals, n_values, confidence, (SELECT count(*) FROM c WHERE c.cluster_id = s.cluster_id AND raw_{one} <> '' AND {one} IS NULL) AS dropped FROM s_{field} s")(run)


for _f in oracle.SCALARS:
    _scalar(_f)
    _considered(_f)
_list("emails", "email")
_list("phones", "phone")


@query("SELECT ids.cluster_id, city, region, country, confidence FROM ids LEFT JOIN loc ON ids.cluster_id = loc.cluster_id LEFT JOIN s_location s ON ids.cluster_id = s.cluster_id")
def resolve_location(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", "location.*", F.col("c_location").alias("confidence"))


@query("SELECT cluster_id, github FROM s_links")
def resolve_links(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", F.col("links.github").alias("github"))


@query("SELECT cluster_id, name, sources, confidence FROM skill")
def resolve_skills(spark, sf_dir):
    s = people(spark, sf_dir).select("cluster_id", F.explode("skills").alias("s"))
    return s.select("cluster_id", F.col("s.name").alias("name"), F.array_join("s.sources", ",").alias("sources"), F.col("s.confidence").alias("confidence"))


@query("SELECT cluster_id, pos, company, title, start_ AS start_date, end_ AS end_date FROM l_experience")
def resolve_experience(spark, sf_dir):
    e = people(spark, sf_dir).select("cluster_id", F.posexplode("experience").alias("pos", "e"))
    return e.select("cluster_id", F.col("pos").cast("long").alias("pos"), F.col("e.company").alias("company"), F.col("e.title").alias("title"), F.col("e.start").alias("start_date"), F.col("e.end").alias("end_date"))


@query("SELECT cluster_id, pos, institution, degree, field, end_year FROM l_education")
def resolve_education(spark, sf_dir):
    e = people(spark, sf_dir).select("cluster_id", F.posexplode("education").alias("pos", "e"))
    return e.select("cluster_id", F.col("pos").cast("long").alias("pos"), "e.*")


@query("""SELECT cluster_id, field, source, method, count(*) AS n FROM (SELECT cluster_id, 'full_name' AS field, source, method FROM o_full_name UNION ALL SELECT cluster_id, 'headline', source, method FROM o_headline UNION ALL SELECT cluster_id, 'years_experience', source, method FROM o_years_experience
    UNION ALL SELECT cluster_id, 'emails', source, method FROM c WHERE email IS NOT NULL UNION ALL SELECT cluster_id, 'phones', source, method FROM c WHERE phone IS NOT NULL
    UNION ALL SELECT pl.cluster_id, 'location', source, method FROM pl JOIN loc ON loc.cluster_id = pl.cluster_id AND prio::BIGINT * 1000000000 + ord IN (at_city, at_region, at_country)
    UNION ALL SELECT c.cluster_id, 'links', source, method FROM c JOIN (SELECT cluster_id, min(prio::BIGINT * 1000000000 + ord) AS o1 FROM c WHERE github IS NOT NULL GROUP BY cluster_id) f ON c.cluster_id = f.cluster_id AND prio::BIGINT * 1000000000 + ord = f.o1
    UNION ALL SELECT cluster_id, 'skills', source, method FROM c WHERE skills <> '' UNION ALL SELECT DISTINCT cluster_id, 'experience', source, method FROM (SELECT cluster_id, ord, source, method FROM l_experience) UNION ALL SELECT cluster_id, 'education', source, method FROM (SELECT DISTINCT cluster_id, ord, source, method FROM l_education)) GROUP BY ALL""".replace("SELECT DISTINCT cluster_id, 'experience', source, method FROM (SELECT cluster_id, ord, source, method FROM l_experience)", "SELECT cluster_id, 'experience', source, method FROM (SELECT DISTINCT cluster_id, ord, source, method FROM l_experience)"))  # fmt: skip
def provenance(spark, sf_dir):
    p = people(spark, sf_dir).select("cluster_id", F.explode("provenance").alias("p")).select("cluster_id", "p.*")
    return p.groupBy("cluster_id", "field", "source", "method").agg(F.count("*").alias("n"))


@query("SELECT cluster_id, overall_confidence, completeness FROM q")
def overall_confidence(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", "overall_confidence", "completeness")


# trust


@query("SELECT cluster_id, type, field, detail FROM an")
def anomalies(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", F.explode("anomalies").alias("a")).select("cluster_id", "a.*")


@query("SELECT cluster_id, flags, reasons, reasons <> '' AS needs_review FROM t")
def quality_report(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", F.array_join("flags", ",").alias("flags"), F.array_join("review_reasons", "; ").alias("reasons"), "needs_review")


@query("SELECT candidate_id, overall_confidence FROM t WHERE reasons <> ''")
def review_queue(spark, sf_dir):
    return people(spark, sf_dir).where("needs_review").select("candidate_id", "overall_confidence")


def _means(k: int) -> str:
    """Averages of all of t, of values of four places summed as whole numbers."""
    total = "sum(CAST(round({} * 10000) AS BIGINT)) / 10000::DOUBLE / greatest(1, count(*))"
    return ", ".join(f"{oracle.r4(f'coalesce({total.format(x)}, 0)', k)} AS {name}" for x, name in (("overall_confidence", "avg_confidence"), ("completeness", "avg_completeness")))


@query(f"SELECT count(*) AS total, count(*) FILTER (reasons = '') AS accepted, count(*) FILTER (reasons <> '') AS needs_review, CAST(coalesce(sum(n_anomalies), 0) AS BIGINT) AS anomalies, {_means(10_000)} FROM t")
def batch_rollup(spark, sf_dir):
    return trust.rollup(people(spark, sf_dir))


@query("SELECT field, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field FROM t WHERE conflict_{f}" for f in oracle.SCALARS) + ") GROUP BY field")
def conflict_field_counts(spark, sf_dir):
    return trust.conflict_counts(people(spark, sf_dir))


@query("SELECT candidate_id, field, value, source FROM (" + " UNION ALL ".join(f"SELECT t.cluster_id, candidate_id, '{f}' AS field, CAST(o.value AS VARCHAR) AS value, o.source FROM t JOIN o_{f} o ON t.cluster_id = o.cluster_id JOIN w_{f} w ON t.cluster_id = w.cluster_id WHERE conflict_{f} AND NOT (o.value = w.value AND o.source = w.source AND o.method = w.method)" for f in oracle.SCALARS) + ")")
def conflict_alternatives(spark, sf_dir):
    c = people(spark, sf_dir).select("candidate_id", F.explode("conflicts").alias("c")).select("candidate_id", "c.field", F.explode("c.alternatives").alias("a"))
    return c.select("candidate_id", "field", "a.*")


@query("SELECT cluster_id, field, confidence FROM (" + " UNION ALL ".join(f"SELECT cluster_id, '{f}' AS field, c_{f} AS confidence FROM t" for f in (*oracle.SCALARS, "emails", "phones", "location", "skills")) + ") WHERE confidence < 0.6")
def low_confidence_fields(spark, sf_dir):
    return people(spark, sf_dir).select("cluster_id", F.explode("low_confidence_fields").alias("f")).select("cluster_id", "f.*")


# views

CUSTOM = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True},
        {"path": "primary_email", "from": "emails[0]", "type": "string"},
        {"path": "phone", "from": "phones[0]", "type": "string", "normalize": "E164"},
        {"path": "country", "from": "location.country", "type": "string"},
        {"path": "github", "from": "links.github", "type": "string"},
        {"path": "first_company", "from": "experience[0].company", "type": "string"},
    ],
    "include_confidence": True,
    "on_missing": "null",
}
STRICT = {"fields": [{"path": "full_name", "type": "string", "required": True}, {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True}], "on_missing": "error"}
OMIT = CUSTOM | {"on_missing": "omit", "include_confidence": False}
_CUSTOM_SQL = "SELECT full_name, email AS primary_email, phone, country, github, (SELECT min_by(company, pos) FROM l_experience e WHERE e.cluster_id = t.cluster_id) AS first_company, overall_confidence, candidate_id FROM t"


@query(f"SELECT * EXCLUDE (candidate_id) FROM ({_CUSTOM_SQL}) WHERE full_name IS NOT NULL")
def project_custom(spark, sf_dir):
    return projection.parted(projection.projected(people(spark, sf_dir), CUSTOM))[0]


@query(f"SELECT candidate_id, key, value FROM ({_CUSTOM_SQL}) UNPIVOT (value FOR key IN (full_name, primary_email, phone, country, github, first_company))")
def project_omit(spark, sf_dir):
    view = projection.projected(people(spark, sf_dir), OMIT)
    return view.select(F.col("_id").alias("candidate_id"), F.explode("view").alias("key", "value"))


@query("SELECT full_name, email AS primary_email FROM t WHERE full_name IS NOT NULL AND email IS NOT NULL")
def project_strict(spark, sf_dir):
    return projection.parted(projection.projected(people(spark, sf_dir), STRICT))[0]


@query("SELECT candidate_id, 'missing value for ''' || CASE WHEN full_name IS NULL THEN 'full_name'' (from ''full_name' ELSE 'primary_email'' (from ''emails[0]' END || ''') on candidate ''' || candidate_id || '''' AS error FROM t WHERE full_name IS NULL OR email IS NULL")
def project_strict_errors(spark, sf_dir):
    return projection.parted(projection.projected(people(spark, sf_dir), STRICT))[1]


@query("SELECT candidate_id, 0::BIGINT AS n_violations FROM t")
def validate_violations(spark, sf_dir):
    p = people(spark, sf_dir)
    return p.select("candidate_id", F.size(projection.violations(p)).cast("long").alias("n_violations"))


@query("SELECT cluster_id, concat_ws(',', CASE WHEN cluster_id % 3 = 0 THEN 'candidate_id' END, CASE WHEN cluster_id % 5 = 0 AND n_jobs > 0 THEN 'experience' END) AS violations FROM t")
def validate_planted(spark, sf_dir):
    """As above, where every third person has lost the id and every fifth has jobs that began soon."""
    p = people(spark, sf_dir)
    broken = F.transform("experience", lambda e: e.withField("start", F.lit("soon")))
    p = p.withColumn("candidate_id", F.when(F.col("cluster_id") % 3 != 0, F.col("candidate_id"))).withColumn("experience", F.when(F.col("cluster_id") % 5 == 0, broken).otherwise(F.col("experience")))
    return p.select("cluster_id", F.array_join(projection.violations(p), ",").alias("violations"))


# the console


@query("SELECT candidate_id, coalesce(full_name, candidate_id) AS name, CASE WHEN reasons <> '' THEN 'needs_review' ELSE 'accepted' END AS status, overall_confidence, completeness, conflict_full_name::BIGINT + conflict_headline::BIGINT + conflict_years_experience::BIGINT AS conflicts, flags FROM t")
def inbox(spark, sf_dir):
    from onefold.operators.console import inbox as rows

    return rows(people(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (reasons = '') AS accepted, count(*) FILTER (reasons <> '') AS needs_review, 0::BIGINT AS reviewed, count(*) FILTER (conflict_full_name OR conflict_headline OR conflict_years_experience) AS with_conflicts, {_means(1_000)} FROM t")
def dashboard_summary(spark, sf_dir):
    from onefold.operators.console import inbox as rows
    from onefold.operators.console import summary

    return summary(rows(people(spark, sf_dir)))


@query("SELECT candidate_id, CASE WHEN overall_confidence >= 0.85 THEN 'high' WHEN overall_confidence >= 0.6 THEN 'mid' ELSE 'low' END AS band, CAST(trunc(overall_confidence * 100::DOUBLE) AS INTEGER) AS percent FROM t")
def confidence_band(spark, sf_dir):
    from onefold.operators.console import band, percent

    return people(spark, sf_dir).select("candidate_id", band(F.col("overall_confidence")).alias("band"), percent(F.col("overall_confidence")).alias("percent"))


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
