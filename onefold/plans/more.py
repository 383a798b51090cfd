"""Queries of the store, of streams, and of texts as they are in the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from onefold.operators import calibration, store
from onefold.plans import derived, oracle
from onefold.plans.queries import people, query, stored
from onefold.scratch import scratch_path
from onefold.sources import lookup, proposals, text
from onefold.streaming import ingest

# texts


@query("SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS email FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') AS m FROM documents)", chain=False)
def notes_extract_email(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(text.every(F.col("text"), text.EMAIL)).alias("pos", "email")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, trim(unnest(m)) AS phone FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\+?[0-9][0-9\\-\\s().]{7,}[0-9]') AS m FROM documents)", chain=False)
def notes_extract_phone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(text.every(F.col("text"), text.PHONE)).alias("pos", "phone")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT page_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS email FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') AS m FROM pages)", chain=False)
def pages_extract_email(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(text.every(F.col("html"), text.EMAIL)).alias("pos", "email")).withColumn("pos", F.col("pos").cast("long"))


_NOTE = "SELECT c_custkey AS k, 'Name: Ann Poe' || CAST(c_custkey AS STRING) || chr(10) || 'Mail a' || CAST(c_custkey AS STRING) || '@x.com, phone 415-' || CAST(200 + c_custkey % 700 AS STRING) || '-1234. About ' || CAST(c_custkey % 40 AS STRING) || ' years of golang' AS note FROM {customer}"


@query("SELECT k, 'Ann Poe' || k AS full_name, 'a' || k || '@x.com' AS email, '415-' || (200 + k % 700) || '-1234' AS phone, CAST(k % 40 AS DOUBLE) AS years, 'golang' AS skills FROM (" + _NOTE.format(customer="customer") + ")", chain=False)
def notes_records(spark, sf_dir):
    rows = spark.sql(_NOTE, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    found = text.notes(rows, ["k"], "note")
    return found.select("k", "full_name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), F.col("years_experience").alias("years"), F.array_join("skills", ",").alias("skills"))


_RESUME = "SELECT c_custkey AS k, 'Ann Poe' || chr(10) || 'SKILLS' || chr(10) || 'Tools: Go, Weaving (basic)' || chr(10) || 'EXPERIENCE' || chr(10) || 'Engineer at Acme' || CAST(c_custkey % 9 AS STRING) || ' (2015-0' || CAST(1 + c_custkey % 9 AS STRING) || ' to present)' || chr(10) || '- did things' || chr(10) || 'EDUCATION' || chr(10) || 'BSc in Physics, MIT, ' || CAST(1990 + c_custkey % 30 AS STRING) AS cv FROM {customer}"


@query("SELECT k, 'Go,Weaving' AS skills, 'Engineer' AS title, 'Acme' || (k % 9) AS company, '2015-0' || (1 + k % 9) AS start_date, 'present' AS end_date, 'MIT' AS institution, 'BSc' AS degree, 'Physics' AS field, CAST(1990 + k % 30 AS VARCHAR) AS end_year FROM (" + _RESUME.format(customer="customer") + ")", chain=False)
def resume_sections(spark, sf_dir):
    rows = spark.sql(_RESUME, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    found = text.resumes(rows, ["k"], "cv").withColumn("e", F.get("experience", F.lit(0))).withColumn("s", F.get("education", F.lit(0)))
    return found.select("k", F.array_join("skills", ",").alias("skills"), "e.title", "e.company", F.col("e.start").alias("start_date"), F.col("e.end").alias("end_date"), "s.institution", "s.degree", "s.field", "s.end_year")


@query("SELECT doc_id, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(src)) AS source_there, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(word)) AS word_there FROM (SELECT doc_id, text, source AS src, trim(substr(text, 5, 12)) AS word FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(substr(text, 5, 12), '\\s+', ' ', 'g')) <> '' AND NOT regexp_matches(substr(text, 5, 12), '\\s\\s|[^ -~]'))", chain=False)
def grounding_verify(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("word", F.substring("text", 5, 12)).where("text is not null")
    docs = docs.where(~F.col("word").rlike(r"\s\s|[^ -~]") & (F.trim("word") != ""))
    return docs.select("doc_id", proposals.grounded(F.col("source"), F.col("text")).alias("source_there"), proposals.grounded(F.col("word"), F.col("text")).alias("word_there"))


def _folded(sql):
    return f"lower(trim(regexp_replace({sql}, '{proposals.WHITE}+', ' ', 'g')))"


_VALUES = {"source": "source", "word": "substr(text, 5, 12)", "other": "'not said ' || doc_id"}


@query("SELECT doc_id, " + ", ".join(f"coalesce({v} <> '' AND contains(t, {v}), false) AS {v}_there" for v in _VALUES) + f" FROM (SELECT doc_id, {_folded('text')} AS t, " + ", ".join(f"{_folded(sql)} AS {v}" for v, sql in _VALUES.items()) + " FROM documents)", chain=False)
def grounding_every_document(spark, sf_dir):
    """A row for every document, whatever its text begins with (null text: nothing is there), and a value that no text has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = {"source": F.col("source"), "word": F.substring("text", 5, 12), "other": F.concat(F.lit("not said "), F.col("doc_id").cast("string"))}
    return docs.select("doc_id", *[proposals.grounded(value, F.col("text")).alias(f"{name}_there") for name, value in values.items()])


@query("WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, event_type) AS turn FROM events), f AS (SELECT user_id, event_type, min(turn) AS turn FROM r WHERE turn <= 100 GROUP BY ALL) SELECT 'user' || user_id AS handle, 'User ' || user_id AS full_name, string_agg(event_type, ',' ORDER BY turn) AS skills FROM f GROUP BY user_id", chain=False)
def enrichment_lookup(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("handle"), F.col("event_type").alias("language"), F.col("event_id").alias("at"), "user_id")
    none = F.lit(None).cast("string")
    users = events.select("handle", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"), *[none.alias(x) for x in ("bio", "location", "email", "blog", "url")]).distinct()
    found = lookup.enriched(users.select("handle"), users, events, ["handle"])
    return found.select("handle", "full_name", F.array_join("skills", ",").alias("skills"))


# the store: people of the first records, then the rest of the batch


def _first(spark, sf_dir):
    return derived.records(spark, sf_dir).where("source in ('ats_json', 'recruiter_notes')")


def _state(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        _STATES[key] = store.ingest(store.empty(spark), _first(spark, sf_dir))
    return _STATES[key]


def _whole(spark, sf_dir):
    """The state after the first records and, as two more batches, all others."""
    key = (spark.sparkContext.applicationId, sf_dir, "whole")
    if key not in _STATES:
        rest = derived.records(spark, sf_dir).where("source not in ('ats_json', 'recruiter_notes')")
        state = _state(spark, sf_dir)
        for batch in (rest.where("source = 'recruiter_csv'"), rest.where("source <> 'recruiter_csv'")):
            state = store.ingest(state, batch)
        _STATES[key] = state
    return _STATES[key]


_STATES: dict = {}
_EVERY = "SELECT source, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (ord) FROM src) GROUP BY source"


@query("SELECT source, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (ord) FROM src WHERE source IN ('ats_json', 'recruiter_notes')) GROUP BY source")
def idempotent_ingest(spark, sf_dir):
    again = store.ingest(_state(spark, sf_dir), _first(spark, sf_dir))
    return again.records.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'email' AS key_type, email AS key_value, 1::BIGINT AS n_people FROM (SELECT DISTINCT email FROM n WHERE source IN ('ats_json', 'recruiter_notes') AND email IS NOT NULL)")
def incremental_link(spark, sf_dir):
    keys = _state(spark, sf_dir).keys.where("key_type = 'email'")
    return keys.groupBy("key_type", "key_value").agg(F.countDistinct("candidate_id").alias("n_people"))


@query(_EVERY)
def idempotent_ingest_all(spark, sf_dir):
    again = store.ingest(_whole(spark, sf_dir), derived.records(spark, sf_dir))
    return again.records.groupBy("source").agg(F.count("*").alias("n"))


@query()
def incremental_candidates(spark, sf_dir):
    """Every record of the store, and the person that it was linked to."""
    return _whole(spark, sf_dir).records.select("ord", "source", "candidate_id")


@query()
def incremental_link_all(spark, sf_dir):
    return _whole(spark, sf_dir).keys.groupBy("key_type", "key_value").agg(F.countDistinct("candidate_id").alias("n_people"))


@query()
def incremental_people(spark, sf_dir):
    return _whole(spark, sf_dir).people.select("candidate_id", "full_name", "status", "overall_confidence")


@query("SELECT count(*) AS n, count(DISTINCT headline) AS n_headlines, min(headline) AS headline FROM src WHERE source = 'ats_json'".replace("count(DISTINCT headline)", "1::BIGINT").replace("min(headline)", "'Chief'"))
def origin_refresh(spark, sf_dir):
    rows = _first(spark, sf_dir).where("source = 'ats_json'").withColumn("from", F.col("ord").cast("string"))
    once = store.ingest(store.empty(spark), rows, "from")
    twice = store.ingest(once, rows.withColumn("headline", F.lit("Chief")), "from")
    return twice.records.agg(F.count("*").alias("n"), F.countDistinct("headline").alias("n_headlines"), F.min("headline").alias("headline"))


@query("SELECT count(*) AS n, 1::BIGINT AS n_headlines, 'Chief' AS headline FROM src")
def origin_refresh_all(spark, sf_dir):
    rows = derived.records(spark, sf_dir).withColumn("from", F.col("ord").cast("string"))
    once = store.ingest(store.empty(spark), rows, "from")
    twice = store.ingest(once, rows.withColumn("headline", F.lit("Chief")), "from")
    return twice.records.agg(F.count("*").alias("n"), F.countDistinct("headline").alias("n_headlines"), F.min("headline").alias("headline"))


def _some(state):
    return state.people.where("full_name is not null and candidate_id like '%1@example.com'").select("candidate_id")


@query()
def delete_candidate(spark, sf_dir):
    state = _whole(spark, sf_dir)
    return store.delete(state, _some(state)).people.select("candidate_id", "status")


@query()
def sticky_review(spark, sf_dir):
    state = _whole(spark, sf_dir)
    return store.review(state, _some(state)).people.groupBy("status").agg(F.count("*").alias("n"))


@query()
def correction_wins(spark, sf_dir):
    state = _whole(spark, sf_dir)
    fixes = _some(state).select("candidate_id", F.lit("full_name").alias("field"), F.lit("New Name").alias("value"), F.lit(1).cast("long").alias("seq"))
    return store.correct(state, fixes).people.where("full_name = 'New Name'").select("candidate_id", "full_name", "c_full_name")


_RATE = "(o / greatest(1, e)::DOUBLE)"


@query(f"SELECT source, base_weight, {oracle.r4(f'base_weight * greatest(0.4::DOUBLE, 1::DOUBLE - 0.6::DOUBLE * {_RATE})')} AS calibrated_weight, o AS overrides, e AS exposure, {oracle.r4(_RATE)} AS override_rate FROM (SELECT w.source, base_weight, coalesce(o, 0) AS o, coalesce(e, 0) AS e FROM (VALUES " + ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in oracle.SOURCE_WEIGHT.items()) + ") w(source, base_weight) LEFT JOIN (SELECT source, count(*) AS o FROM w_full_name WHERE cluster_id % 3 = 0 GROUP BY source) a ON w.source = a.source LEFT JOIN (SELECT source, count(*) AS e FROM src GROUP BY source) b ON w.source = b.source)")
def calibration_report(spark, sf_dir):
    fixed = people(spark, sf_dir).where("full_name is not null and cluster_id % 3 = 0").select("candidate_id", F.lit("full_name").alias("field"), F.get("considered_full_name", F.lit(0))["source"].alias("source"))
    return calibration.report(spark, fixed, derived.records(spark, sf_dir)).drop("place")


@query("SELECT source, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (ord) FROM src WHERE source IN ('ats_json', 'recruiter_notes')) GROUP BY source")
def stream_ingest(spark, sf_dir):
    def records():
        return _first(spark, sf_dir)

    path = stored(spark, sf_dir, "arrivals", records).inputFiles()[0].rsplit("/", 1)[0]
    sink = ingest.Sink(spark, scratch_path(spark, "store"))
    stream = spark.readStream.schema(records().schema).parquet(path)
    ingest.start(stream, sink, scratch_path(spark, "stream")).awaitTermination()
    return sink.state.records.groupBy("source").agg(F.count("*").alias("n"))


@query(_EVERY)
def stream_ingest_all(spark, sf_dir):
    """All sources, in micro-batches of one file."""

    def records():
        return derived.records(spark, sf_dir).repartition(3)

    path = stored(spark, sf_dir, "all_arrivals", records).inputFiles()[0].rsplit("/", 1)[0]
    sink = ingest.Sink(spark, scratch_path(spark, "store"))
    stream = spark.readStream.schema(records().schema).option("maxFilesPerTrigger", 1).parquet(path)
    ingest.start(stream, sink, scratch_path(spark, "stream")).awaitTermination()
    return sink.state.records.groupBy("source").agg(F.count("*").alias("n"))
