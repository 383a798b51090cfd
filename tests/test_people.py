import json
import random

import gold
import pytest
from pyspark.sql import functions as F

from onefold.model import RECORD, RECORD_DDL
from onefold.operators import projection, trust
from onefold.operators.components import components
from onefold.operators.records import clustered, normalized
from onefold.operators.resolve import candidate_ids, gathered, resolved
from onefold.plans import batch


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.get(name) for name in RECORD) for r in rows], RECORD_DDL)


def resolve(spark, *rows, **options):
    return trust.reported(resolved(candidate_ids(gathered(clustered(normalized(frame(spark, *rows))))), **options))


@pytest.fixture(scope="module")
def example(spark, tmp_path_factory):
    return batch.run(spark, gold.write(tmp_path_factory.mktemp("sources")))


def test_example_numbers(example):
    by_id = {r.candidate_id: r for r in example["people"].collect()}
    jane, carlos, sam = (by_id[x] for x in ("jane.doe@example.com", "carlos.reyes@example.com", "sam-lee"))
    assert (jane.overall_confidence, carlos.overall_confidence, sam.overall_confidence) == (0.9336, 0.9671, 0.54)
    assert (jane.completeness, carlos.completeness, sam.completeness) == (1.0, 1.0, 0.3333)
    assert (jane.full_name, jane.c_full_name, jane.phones) == ("Jane A. Doe", 0.765, ["+14155550132"])
    assert [e.company for e in jane.experience] == ["Acme Corp", "Globex", "Acme", "Initech"]
    assert [(s.name, s.confidence, s.sources) for s in jane.skills][:2] == [("AWS", 0.385, ["resume"]), ("GraphQL", 1.0, ["ats_json", "recruiter_notes", "resume"])]
    assert jane.links.portfolio == "https://jane.dev" and jane.links.linkedin == "https://www.linkedin.com/in/jane-doe"
    assert [a.detail for a in carlos.anomalies] == ["end_year=2031"]
    assert sam.review_reasons == ["no email address resolved", "overall_confidence 0.54 < 0.6", "completeness 0.3333 < 0.5"]


def test_example_rollup(example):
    assert example["trust"].first().asDict() == {"total": 3, "accepted": 1, "needs_review": 2, "anomalies": 1, "avg_confidence": 0.8136, "avg_completeness": 0.7778}
    assert example["profiles"].count() == 3 and example["errors"].count() == 0


def test_strict_view_isolates_errors(example):
    strict = {"fields": [{"path": "full_name", "required": True}, {"path": "primary_email", "from": "emails[0]", "required": True}], "on_missing": "error"}
    good, bad = projection.parted(projection.projected(example["people"], strict))
    assert good.count() == 2
    assert [r.error for r in bad.collect()] == ["missing value for 'primary_email' (from 'emails[0]') on candidate 'sam-lee'"]


def test_views_and_policies(example):
    config = {"fields": [{"path": "name", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "nothing", "from": "no.such"}], "on_missing": "omit"}
    sam = projection.projected(example["people"], config).where("_id = 'sam-lee'").first()
    assert {k: json.loads(v) if v.startswith("[") else v for k, v in sam.view.items()} == {"name": "Sam Lee", "skills": ["Machine Learning", "Python"]}
    row = projection.projected(example["people"], config | {"on_missing": "null"}).where("_id = 'sam-lee'").first()
    assert row["mail"] is None and row["nothing"] is None and row["_errors"] == []
    wrong = {"fields": [{"path": "years_experience", "type": "string"}]}
    assert projection.projected(example["people"], wrong).where("size(_errors) > 0").count() == 3


def test_paths():
    assert projection.parsed("a.b[0].c[]") == [("a", None, False), ("b", 0, False), ("c", None, True)]
    with pytest.raises(ValueError):
        projection.parsed("a..b")


def test_missing_folder_and_broken_files(spark, tmp_path):
    assert batch.read(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken.json").write_text("{nope")
    assert batch.read(spark, str(tmp_path)).count() == 0


def test_enrichment_joins_after_clustering(spark):
    users = spark.createDataFrame([("octo", "Octo Cat", "Builder", "Berlin", "j@x.com", "https://o.dev", "https://github.com/octo")], "handle string, name string, bio string, location string, email string, blog string, url string")
    repos = spark.createDataFrame([("octo", "Go", 2), ("octo", "Python", 3), ("octo", "Go", 1), ("octo", None, 4)], "handle string, language string, at int")
    rows = [{"ord": 0, "source": "recruiter_notes", "method": "regex", "full_name": "Jane", "links": (None, "@octo", None, None)}, {"ord": 1, "source": "recruiter_csv", "method": "field_map", "emails": ["j@x.com"]}]
    people = {r.cluster_id: r for r in batch.people(frame(spark, *rows), users=users, repositories=repos).collect()}
    assert len(people) == 2
    assert people[0].emails == ["j@x.com"] and people[0].full_name == "Jane" and [s.name for s in people[0].skills] == ["Go", "Python"]


def test_weighted_winner_and_corroboration(spark):
    one = {"ord": 0, "source": "recruiter_notes", "method": "regex", "full_name": "J. Doe", "emails": ["j@x.com"]}
    two = {"ord": 1, "source": "ats_json", "method": "field_map", "full_name": "Jane Doe", "emails": ["j@x.com", "k@x.com"]}
    row = resolve(spark, one, two).first()
    assert (row.full_name, row.c_full_name, row.conflict_full_name) == ("Jane Doe", 0.765, True)
    assert (row.emails, row.c_emails) == (["j@x.com", "k@x.com"], 0.97)
    assert resolve(spark, one, two, weights={"ats_json": 0.1}).first().full_name == "J. Doe"


def test_same_names_with_different_addresses_stay_apart(spark):
    rows = [{"ord": i, "source": "recruiter_csv", "method": "field_map", "full_name": "Sam Lee", "emails": [f"{i}@x.com"]} for i in range(2)]
    weak = [{"ord": i, "source": "recruiter_notes", "method": "regex", "full_name": "Ann Poe"} for i in (2, 3)]
    assert sorted(r.cluster_id for r in clustered(normalized(frame(spark, *rows, *weak))).collect()) == [0, 1, 2, 2]


def test_no_records(spark):
    assert resolve(spark).count() == 0
    assert trust.rollup(resolve(spark)).first().asDict() == {"total": 0, "accepted": 0, "needs_review": 0, "anomalies": 0, "avg_confidence": 0.0, "avg_completeness": 0.0}


def test_components_against_union_find(spark):
    random.seed(2)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    parent = {x: x for pair in links for x in pair if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()) == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_in_few_stages(spark):
    links = [(50, i) for i in range(100) if i != 50] * 5 + [(200 + i, 201 + i) for i in range(20)]
    frame, tracker = spark.createDataFrame(links, "a long, b long"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few stages", "")
    try:
        found = dict(components(frame, "a", "b").collect())
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert found == {i: 0 for i in range(100)} | {200 + i: 200 for i in range(21)}
    ran = [tracker.getStageInfo(k) for k in {k for j in tracker.getJobIdsForGroup("few stages") for k in tracker.getJobInfo(j).stageIds}]
    assert sum(x.numCompletedTasks > 0 for x in ran if x) <= 75  # each has as many tasks as the session shuffles to


def test_resume_layouts(spark):
    from onefold.sources import text

    cv = "Ann Poe\n\nWORK EXPERIENCE\nLead | Initech | Dec 2020 - May 2021\n- built things\nEngineer at Acme (2015-01 to 2016-02)\n\nEDUCATION\nB.Tech Physics | Delhi University, India\nExpected: 2027\n\nSKILLS\nLanguages: Go, Rust (basic); SQL | Weaving\n"
    row = text.resumes(spark.createDataFrame([(0, cv)], "at int, text string"), ["at"]).first()
    assert [(e.title, e.company, e.start, e.end) for e in row.experience] == [("Lead", "Initech", "Dec 2020", "May 2021"), ("Engineer", "Acme", "2015-01", "2016-02")]
    assert [(e.institution, e.degree, e.field, e.end_year) for e in row.education] == [("Delhi University", "B.Tech", "Physics", "2027")]
    assert row.skills == ["Go", "Rust", "SQL", "Weaving"]


def test_proposals_must_be_in_the_text(spark):
    from onefold.sources import proposals

    rows = spark.createDataFrame(
        [(0, "Jane Doe, 8 years in Paris. Mail j@x.com, phone (415) 555-0132. Go.", "jane  doe", "Chief", 8.0, ["j@x.com", "k@x.com"], ["4155550132"], ("Paris", None, "FR"), ["Go", "Rust"], [("Acme", None, None, None, None)], [])],
        "at int, text string, full_name string, headline string, years_experience double, emails array<string>, phones array<string>, location struct<city:string,region:string,country:string>, skills array<string>, experience array<struct<company:string,title:string,start:string,end:string,summary:string>>, education array<struct<institution:string,degree:string,field:string,end_year:string>>",
    )
    row = proposals.verified(rows, ["at"]).first()
    assert (row.full_name, row.headline, row.years_experience, row.emails, row.phones, row.skills, row.experience) == ("jane  doe", None, 8.0, ["j@x.com"], ["4155550132"], ["Go"], None)
    assert (row.location.city, row.location.country) == ("Paris", None)


def test_console_cards(example):
    from onefold.operators import console

    cards = {(r.candidate_id, r.field): r for r in console.cards(example["people"]).collect()}
    card = cards["jane.doe@example.com", "full_name"]
    assert (card.display, card.band, card.sources) == ("Jane A. Doe", "mid", ["ats_json", "recruiter_csv", "recruiter_notes", "resume"])
    assert console.inbox(example["people"]).agg(F.count("*")).first()[0] == 3


def test_command_line(spark, tmp_path, capsys):
    from onefold.__main__ import main

    (tmp_path / "in").mkdir()
    config = tmp_path / "strict.json"
    config.write_text(json.dumps({"fields": [{"path": "full_name", "required": True}, {"path": "primary_email", "from": "emails[0]"}], "on_missing": "error"}))
    assert main(["--inputs", gold.write(tmp_path / "in"), "--out", str(tmp_path / "out"), "--config", str(config)]) == 0
    assert "sam-lee: missing value" in capsys.readouterr().err
    assert sorted(r.primary_email for r in spark.read.json(f"{tmp_path}/out/profiles").collect()) == ["carlos.reyes@example.com", "jane.doe@example.com"]
    reports = {r.candidate_id: r for r in spark.read.json(f"{tmp_path}/out/report").collect()}
    assert reports["jane.doe@example.com"].explain.full_name.reason == "chosen from ats_json (base 0.9) over 1 differing value(s); sources conflicted -> confidence penalized"
