"""One canonical record of each cluster: who said what, which value won, and how far to trust it.

The records of a cluster are gathered once, in order; everything else is array expressions over them, so resolution is one
shuffle. The result names every contributing record in its provenance, so it is as large as what is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.functions.text import once, rounded
from onefold.model import AGREEMENT_BONUS, CONFLICT_PENALTY
from onefold.operators.records import base_confidence
from onefold.scratch import joined

SCALARS = ("full_name", "headline", "years_experience")
LISTS = ("emails", "phones")
_PROVENANCE = "array<struct<field:string,source:string,method:string>>"


def adjusted(base: Column, agreeing: Column, conflict: Column | bool = False) -> Column:
    """A base with a bonus for each further agreeing record and a penalty for conflict, within 0 and 1."""
    score = base + F.lit(AGREEMENT_BONUS) * F.greatest(F.lit(0), agreeing - 1)
    if not isinstance(conflict, bool):
        score = F.when(conflict, score * F.lit(CONFLICT_PENALTY)).otherwise(score)
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _provenance(rows: Column, field: str) -> Column:
    return F.transform(rows, lambda r: F.struct(F.lit(field).alias("field"), r["source"].alias("source"), r["method"].alias("method"))).cast(_PROVENANCE)


def _based(rows: Column, field: str, weights: dict[str, float] | None) -> Column:
    return F.transform(rows, lambda r: base_confidence(r["source"], r["method"], field, weights))


def gathered(records: DataFrame, by: str = "cluster_id") -> DataFrame:
    """(by, recs): the records of each cluster as an array, in the order of ord."""
    columns = [name for name in records.columns if name not in (by, "ord")]
    return records.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("recs"))


def _by_priority(rows: Column) -> Column:
    """Records with the most trusted sources first, else in order."""
    keyed = F.transform(rows, lambda r: F.struct(r["prio"].alias("prio"), r["ord"].alias("ord"), r.alias("r")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["prio"] != y["prio"], x["prio"] - y["prio"]).when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)), lambda x: x["r"])


def _scalar(field: str, weights: dict[str, float] | None) -> dict[str, Column]:
    """Winner by base, then priority, then order; agreement counts records, conflict other values."""
    offers = F.transform(
        F.filter("recs", lambda r: r[field].isNotNull()),
        lambda r: F.struct((-base_confidence(r["source"], r["method"], field, weights)).alias("minus"), r["prio"].alias("prio"), r["ord"].alias("ord"), r[field].alias("value"), r["source"].alias("source"), r["method"].alias("method")),
    )
    ranked = F.array_sort(offers)
    won = F.get(F.col(f"_{field}"), F.lit(0))
    return {"rank": ranked, "won": won}


def _most_sources(rows: Column, field: str) -> Column:
    """The most sources that gave one value of a list: a count over sorted pairs, as large clusters have about as many values as records."""
    pairs = F.array_sort(F.flatten(F.transform(rows, lambda r: F.transform(r[field], lambda v: F.struct(v.alias("value"), r["source"].alias("source"))))))
    none = F.lit(None).cast("string")

    def counted(so_far: Column, pair: Column) -> Column:
        same = so_far["value"].eqNullSafe(pair["value"])
        run = F.when(~same, F.lit(1)).when(so_far["source"].eqNullSafe(pair["source"]), so_far["run"]).otherwise(so_far["run"] + 1)
        return F.struct(pair["value"].alias("value"), pair["source"].alias("source"), run.alias("run"), F.greatest(so_far["most"], run).alias("most"))

    return F.aggregate(pairs, F.struct(none.alias("value"), none.alias("source"), F.lit(0).alias("run"), F.lit(0).alias("most")), counted, lambda x: x["most"])


def resolved(clusters: DataFrame, by: str = "cluster_id", weights: dict[str, float] | None = None) -> DataFrame:
    """The canonical record of each cluster (by, recs): its fields, provenance, field_confidence, overall_confidence and trace.

    trace has, for each field with one, the chosen value, its confidence, whether sources conflicted, all that was considered and why.
    """
    out = clusters
    for field in SCALARS:
        out = out.withColumn(f"_{field}", _scalar(field, weights)["rank"])
    for field in SCALARS:
        offers, first = F.col(f"_{field}"), F.get(F.col(f"_{field}"), F.lit(0))
        agree = F.size(F.filter(offers, lambda o: o["value"] == first["value"]))
        distinct = F.size(F.array_distinct(F.transform(offers, lambda o: o["value"])))
        value, some = first["value"], F.size(offers) > 0
        confidence = adjusted(-first["minus"], agree, distinct > 1)
        considered = F.transform(offers, lambda o: F.struct(o["value"].cast("string").alias("value"), o["source"].alias("source"), o["method"].alias("method"), (-o["minus"]).alias("base"), ((o["value"] == first["value"]) & (o["source"] == first["source"]) & (o["method"] == first["method"])).alias("won")))
        base = (-first["minus"]).cast("string")
        reason = F.when(distinct > 1, F.concat(F.lit("chosen from "), first["source"], F.lit(" (base "), base, F.lit(") over "), (distinct - 1).cast("string"), F.lit(" differing value(s); sources conflicted -> confidence penalized")))
        reason = reason.when(agree > 1, F.concat(F.lit("chosen from "), first["source"], F.lit(" (base "), base, F.lit("); "), agree.cast("string"), F.lit(" source(s) agreed -> corroboration bonus")))
        reason = reason.otherwise(F.concat(F.lit("single source "), first["source"], F.lit(" (base "), base, F.lit(")")))
        out = out.withColumn(field, value).withColumn(f"c_{field}", F.when(some, confidence)).withColumn(f"conflict_{field}", F.coalesce(some & (distinct > 1), F.lit(False)))
        out = out.withColumn(f"considered_{field}", considered).withColumn(f"reason_{field}", F.when(some, reason)).withColumn(f"n_distinct_{field}", distinct).withColumn(f"n_agree_{field}", F.when(some, agree).otherwise(0))
        out = out.withColumn(f"p_{field}", _provenance(F.filter("recs", lambda r: r[field].isNotNull()), field))
    for field in LISTS:
        some = F.filter("recs", lambda r: F.size(r[field]) > 0)
        values = F.array_distinct(F.flatten(F.transform(some, lambda r: r[field])))
        out = out.withColumn(field, values)
        agree = _most_sources(some, field)
        base = F.array_max(_based(some, field, weights))
        dropped = F.aggregate(F.filter("recs", lambda r: r[field].isNotNull()), F.lit(0), lambda n, r: n + F.greatest(F.lit(0), r[f"given_{field}"] - F.size(r[field])))
        out = out.withColumn(f"c_{field}", F.when(F.size(field) > 0, adjusted(base, agree))).withColumn(f"dropped_{field}", dropped).withColumn(f"p_{field}", _provenance(some, field))
        out = out.withColumn(f"considered_{field}", F.transform(some, lambda r: F.struct(r["source"].alias("source"), r["method"].alias("method"), r[field].alias("values"))))
        reason = F.concat(F.lit("union of "), F.size(some).cast("string"), F.lit(" source(s), deduped to "), F.size(field).cast("string"), F.lit(" value(s)"), F.when(dropped > 0, F.concat(F.lit("; "), dropped.cast("string"), F.lit(" unparseable value(s) dropped"))).otherwise(""))
        out = out.withColumn(f"reason_{field}", F.when(F.size(field) > 0, reason))
    out = out.withColumn("_ranked", _by_priority(F.col("recs")))
    ranked = F.col("_ranked")
    out = _located(out, ranked, weights)
    out = _linked(out, ranked)
    out = _skilled(out, weights)
    out = _listed(out, ranked, "experience", ("company", "title"))
    out = _listed(out, ranked, "education", ("institution", "degree", "field"))
    order = (*SCALARS, *LISTS, "location", "links", "skills", "experience", "education")
    scored = ("full_name", "headline", "years_experience", "emails", "phones", "location", "skills")
    total = sum((F.coalesce(f"c_{x}", F.lit(0.0)) for x in scored[1:]), F.coalesce(f"c_{scored[0]}", F.lit(0.0)))
    count = sum((F.col(f"c_{x}").isNotNull().cast("int") for x in scored[1:]), F.col(f"c_{scored[0]}").isNotNull().cast("int"))
    out = out.withColumn("provenance", F.concat(*[F.col(f"p_{x}") for x in order])).withColumn("overall_confidence", F.when(count > 0, rounded(total / count)).otherwise(F.lit(0.0)))
    names, values = F.array(*[F.lit(x) for x in scored]), F.array(*[F.col(f"c_{x}") for x in scored])
    confidence = F.map_from_entries(F.filter(F.arrays_zip(names.alias("field"), values.alias("confidence")), lambda x: x["confidence"].isNotNull()))
    return out.withColumn("field_confidence", confidence).drop("_ranked", *[f"_{x}" for x in SCALARS], *[f"p_{x}" for x in order])


def _located(out: DataFrame, ranked: Column, weights: dict[str, float] | None) -> DataFrame:
    """City, region and country each from the first source that has it."""
    rows = F.filter(ranked, lambda r: r["place"].isNotNull())
    first = lambda part: F.get(F.filter(rows, lambda r: r["place"][part].isNotNull()), F.lit(0))
    parts = ("city", "region", "country")
    gave = once(F.array(*[first(p)["ord"] for p in parts]), lambda firsts: F.filter(rows, lambda r: F.array_contains(firsts, r["ord"])))
    return (
        out.withColumn("location", F.struct(*[first(p)["place"][p].alias(p) for p in parts]))
        .withColumn("c_location", F.when(F.size(gave) > 0, F.array_max(_based(gave, "location", weights))))
        .withColumn("p_location", _provenance(gave, "location"))
    )


def _linked(out: DataFrame, ranked: Column) -> DataFrame:
    """Each link from the first source that has it; other links all, in order."""
    rows = F.filter(ranked, lambda r: r["links"].isNotNull())
    some = lambda x: x.isNotNull() & (x != "")
    first = lambda part: F.get(F.filter(rows, lambda r: some(r["links"][part])), F.lit(0))
    parts = ("linkedin", "github", "portfolio")
    others = lambda r: F.filter(F.coalesce(r["links"]["other"], F.array().cast("array<string>")), some)
    before = lambda r: F.flatten(F.transform(F.filter(rows, lambda q: (q["prio"] < r["prio"]) | ((q["prio"] == r["prio"]) & (q["ord"] < r["ord"]))), others))
    news = lambda r: (F.size(others(r)) > 0) & (F.size(F.array_except(others(r), before(r))) > 0)
    gave = once(F.array(*[first(p)["ord"] for p in parts]), lambda firsts: F.filter(rows, lambda r: F.coalesce(F.array_contains(firsts, r["ord"]), F.lit(False)) | news(r)))
    every = F.array_distinct(F.flatten(F.transform(rows, others)))
    return out.withColumn("links", F.struct(*[first(p)["links"][p].alias(p) for p in parts], every.alias("other"))).withColumn("p_links", _provenance(gave, "links"))


def _skilled(out: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Each skill once, by name, with its sources in the order in which they named it."""
    rows = F.filter("recs", lambda r: r["skills"].isNotNull())
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["skills"]))))

    def skill(name: Column) -> Column:
        told = F.filter(rows, lambda r: F.array_contains(r["skills"], name))
        sources = F.array_distinct(F.transform(told, lambda r: r["source"]))
        return F.struct(name.alias("name"), adjusted(F.array_max(_based(told, "skills", weights)), F.size(sources)).alias("confidence"), sources.alias("sources"))

    out = out.withColumn("_names", names).withColumn("_told", rows).withColumn("skills", F.transform("_names", skill))
    told = F.filter("_told", lambda r: F.exists("_told", lambda q: (q["source"] == r["source"]) & (F.size(q["skills"]) > 0)))
    return out.withColumn("c_skills", F.when(F.size("skills") > 0, F.array_max(F.transform("skills", lambda s: s["confidence"])))).withColumn("p_skills", _provenance(told, "skills")).drop("_names", "_told")


def _listed(out: DataFrame, ranked: Column, field: str, key: tuple[str, ...]) -> DataFrame:
    """Entries with different keys, each from the first source that has it; case doesn't tell keys apart."""
    entries = F.flatten(F.transform(F.filter(ranked, lambda r: r[field].isNotNull()), lambda r: F.transform(r[field], lambda e: F.struct(r["ord"].alias("ord"), F.concat_ws("\u0001", *[F.coalesce(F.lower(e[k]), F.lit("")) for k in key]).alias("key"), e.alias("e")))))
    out = out.withColumn("_entries", entries).withColumn("_keys", F.transform("_entries", lambda x: x["key"]))
    kept = F.filter("_entries", lambda x, i: F.array_position("_keys", x["key"]) == i + 1)
    out = out.withColumn("_kept", kept)
    gave = F.filter(ranked, lambda r: F.exists("_kept", lambda x: x["ord"] == r["ord"]))
    return out.withColumn(field, F.transform("_kept", lambda x: x["e"])).withColumn(f"p_{field}", _provenance(gave, field)).drop("_entries", "_keys", "_kept")


def candidate_ids(clusters: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """clusters with candidate_id: the least e-mail, else the first name in lower case with hyphens, else the cluster's number."""
    emails = F.array_min(F.flatten(F.transform(F.filter("recs", lambda r: r["emails"].isNotNull()), lambda r: r["emails"])))
    name = F.get(F.filter("recs", lambda r: r["full_name"].isNotNull()), F.lit(0))["full_name"]
    own = F.coalesce(emails, F.replace(F.lower(name), F.lit(" "), F.lit("-")))
    if numbers is None:
        return clusters.withColumn("candidate_id", F.coalesce(own, F.concat(F.lit("candidate-"), F.col("cluster_id").cast("string"))))
    return joined(clusters, numbers, "cluster_id").withColumn("candidate_id", F.coalesce(own, F.concat(F.lit("candidate-"), F.col("number").cast("string")))).drop("number")
