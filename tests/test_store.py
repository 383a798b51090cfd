import pytest

from onefold.model import RECORD, RECORD_DDL
from onefold.operators import store
from onefold.scratch import scratch_path
from onefold.streaming import ingest


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame([tuple(r.get(name) for name in RECORD) for r in rows], RECORD_DDL)


@pytest.fixture
def some(frame):
    return frame(
        {"ord": 1, "source": "ats_json", "method": "field_map", "full_name": "Jane Doe", "emails": ["jane@x.com"]},
        {"ord": 2, "source": "recruiter_csv", "method": "field_map", "full_name": "J. Doe", "emails": ["JANE@x.com"], "phones": ["(415) 555-0132"]},
        {"ord": 3, "source": "recruiter_notes", "method": "regex", "full_name": "Sam Lee"},
        {"ord": 4, "source": "resume", "method": "regex", "full_name": "Sam Lee"},
    )


def members(state):
    return {r.candidate_id: r["count"] for r in state.records.groupBy("candidate_id").count().collect()}


def test_scores():
    jane, other = {("email", "j@x.com"), ("name", "jane")}, {("phone", "+1"), ("name", "jane")}
    assert store.score(jane, {("email", "j@x.com")}) == 1.0
    assert store.score(jane, other) == 0.0 and store.score(jane, {("name", "jane")}) == 0.0
    assert store.score({("name", "lee sam")}, {("name", "sam lee")}) == 1.0
    assert store.score({("name", "lee sam")}, {("name", "bob")}) == 0.0


def test_ingest_correct_review_delete(spark, frame, some):
    state = store.ingest(store.empty(spark), some)
    assert members(state) == {"jane@x.com": 2, "sam-lee": 2}
    assert members(store.ingest(state, some)) == {"jane@x.com": 2, "sam-lee": 2}
    more = frame({"ord": 5, "source": "resume", "method": "regex", "full_name": "Other", "phones": ["415-555-0132"]}, {"ord": 6, "source": "github", "method": "api", "headline": "No keys"}, {"ord": 7, "source": "resume", "method": "regex", "headline": "None here"})
    state = store.ingest(state, more)
    assert members(state) == {"jane@x.com": 3, "sam-lee": 2, "candidate": 1, "candidate-2": 1}
    fix = spark.createDataFrame([("jane@x.com", "full_name", "Jane Q. Doe", 1), ("jane@x.com", "full_name", "Jane R. Doe", 2), ("jane@x.com", "years_experience", "many", 3), ("jane@x.com", "skills", "Go", 4)], "candidate_id string, field string, value string, seq long")
    state = store.correct(state, fix)
    jane = state.people.where("candidate_id = 'jane@x.com'").first()
    assert jane.full_name == "Jane R. Doe" and jane.years_experience is None and jane.skills == []
    report = {r.source: r for r in store.calibrated(state).collect()}
    assert report["ats_json"].overrides == 2 and report["ats_json"].calibrated_weight == 0.36 and report["resume"].calibrated_weight == 0.55
    state = store.review(state, spark.createDataFrame([("sam-lee",)], "candidate_id string"))
    assert store.reindex(state, 0.99).people.where("status = 'reviewed'").first().candidate_id == "sam-lee"
    gone = store.delete(state, spark.createDataFrame([("sam-lee",)], "candidate_id string"))
    assert "sam-lee" not in members(gone) and gone.people.where("candidate_id = 'sam-lee'").count() == 0 and gone.displaced.count() == 2


def test_a_new_person_among_who_is_known(spark, frame, some):
    state = store.ingest(store.empty(spark), some.where("ord = 1"))
    more = frame({"ord": 5, "source": "resume", "method": "regex", "phones": ["415-555-0132"]}, {"ord": 6, "source": "recruiter_csv", "method": "field_map", "emails": ["jane@x.com"], "phones": ["415-555-0132"]})
    assert sorted(members(store.ingest(state, more)).values()) == [1, 2]


def test_a_misspelled_skill_is_folded(spark, frame):
    rows = frame(
        {"ord": 1, "source": "ats_json", "method": "field_map", "emails": ["jane@x.com"], "skills": ["Python", "Kubernetes"]},
        {"ord": 2, "source": "resume", "method": "regex", "emails": ["jane@x.com"], "skills": ["Pythonn", "Kubernets", "Basket weaving"]},
    )
    people = store.ingest(store.empty(spark), rows).people.first()
    assert [x.name for x in people.skills] == ["Basket weaving", "Kubernetes", "Python"]


def test_origin_replaces_in_place(spark, some):
    rows = some.where("ord = 1").withColumn("from", some["source"])
    state = store.ingest(store.empty(spark), rows, "from")
    changed = store.ingest(state, rows.withColumns({"emails": rows["phones"], "phones": rows["emails"]}), "from")
    assert members(changed) == {"jane@x.com": 1}
    assert changed.people.first().emails == []


def test_a_stream_is_the_same_as_a_batch(spark, some, tmp_path):
    some.repartition(2).write.parquet(f"{tmp_path}/in")
    sink = ingest.Sink(spark, f"file://{tmp_path}/store")
    stream = lambda: spark.readStream.schema(some.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # what comes again, with a new checkpoint, changes nothing
        ingest.start(stream(), sink, scratch_path(spark, "stream")).awaitTermination()
        assert members(sink.state) == {"jane@x.com": 2, "sam-lee": 2}


def test_a_stream_goes_on_after_a_restart(spark, some, tmp_path):
    """Records come two by two; each time the stream starts anew on its checkpoint, and a sink knows nothing but the store's root."""
    at = scratch_path(spark, "stream")
    for these in ("ord = 1 or ord = 3", "ord = 2 or ord = 4"):
        some.where(these).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(some.schema).parquet(f"{tmp_path}/in")
        ingest.start(stream, ingest.Sink(spark, f"file://{tmp_path}/store"), at).awaitTermination()
    found = store.load(spark, f"file://{tmp_path}/store")
    once = store.ingest(store.empty(spark), some)
    assert members(found) == members(once) == {"jane@x.com": 2, "sam-lee": 2}
    columns = ["candidate_id", "full_name", "emails", "phones", "overall_confidence", "status"]
    assert sorted(found.people.select(columns).collect()) == sorted(once.people.select(columns).collect())
    ingest.Sink(spark, f"file://{tmp_path}/store").take(at, some.withColumn("headline", some["source"]), 0)  # a replayed batch
    assert members(store.load(spark, f"file://{tmp_path}/store")) == members(once)


def test_versions_and_parts(spark, frame, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "PARTS", 2)
    root = f"file://{tmp_path}/store"
    state = store.load(spark, root)
    assert state.people is None and state.records.isEmpty()
    for ord in range(3):  # more than PARTS, so that parts are merged
        state = store.ingest(state, frame({"ord": 1, "source": "resume", "method": "regex", "full_name": "Jane Doe", "emails": ["jane@x.com"], "headline": f"No. {ord}"}))
        assert store.save(state) == ord + 1
    assert members(store.load(spark, root)) == {"jane@x.com": 3} and members(store.load(spark, root, 2)) == {"jane@x.com": 2}
    assert store.load(spark, root).people.count() == 1 and len(state.parts["records"].frames) <= store.PARTS
    with pytest.raises(Exception, match="FileAlreadyExists|exists"):  # another writer was first
        store.Versions(spark, root).commit(3, {})
    state = store.review(store.load(spark, root), spark.createDataFrame([("jane@x.com",)], "candidate_id string"))
    store.save(state)
    assert store.load(spark, root).people.first().status == "reviewed"


def test_numbers_of_batches_may_be_the_same(spark, frame):
    """ord tells records of one batch apart, not those of two."""
    state = store.ingest(store.empty(spark), frame({"ord": 1, "source": "ats_json", "method": "field_map", "emails": ["a@x.com"]}))
    state = store.ingest(state, frame({"ord": 1, "source": "ats_json", "method": "field_map", "emails": ["b@x.com"]}))
    state = store.ingest(state, frame({"ord": 1, "source": "resume", "method": "regex", "emails": ["b@x.com"], "headline": "x"}))
    assert members(state) == {"a@x.com": 1, "b@x.com": 2}


def test_stale_keys_link_no_more(spark, frame):
    rows = frame({"ord": 1, "source": "ats_json", "method": "field_map", "emails": ["old@x.com"]})
    state = store.ingest(store.empty(spark), rows.withColumn("from", rows["source"]), "from")
    rows = frame({"ord": 1, "source": "ats_json", "method": "field_map", "emails": ["new@x.com"]})
    state = store.ingest(state, rows.withColumn("from", rows["source"]), "from")
    state = store.ingest(state, frame({"ord": 2, "source": "resume", "method": "regex", "emails": ["old@x.com"]}, {"ord": 3, "source": "resume", "method": "regex", "emails": ["new@x.com"]}))
    assert sorted(members(state).values()) == [1, 2]


def test_nothing_that_grows_is_broadcast(spark, frame, some, monkeypatch):
    """Tables are small on disk and large in memory, so joins must not go by their files' sizes."""
    monkeypatch.setattr(store, "_saved", lambda state, touched: state)  # people are resolved below
    state = store.ingest(store.ingest(store.empty(spark), some), frame({"ord": 5, "source": "resume", "method": "regex", "full_name": "Other", "phones": ["415-555-0132"]}))
    for rows in (state.records, state.keys, store.resolve(state)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_blocks_across_batches():
    """Blocks are told apart in a stream of Arrow batches, wherever those end; known people come first."""
    import pyarrow as pa

    rows = [("a", -1, "p1", "email", "x"), ("a", -1, "p1", "phone", "1"), ("a", 3, None, "email", "x"), ("a", 3, None, "phone", "2"), ("a", 7, None, "phone", "2"), ("b", 3, None, "email", "z"), ("b", 4, None, "email", "z"), ("b", 9, None, "name", "bob")]
    names = ["block", "ord", "candidate_id", "key_type", "key_value"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=pa.schema([("block", pa.string()), ("ord", pa.int64()), *[(n, pa.string()) for n in names[2:]]])) for row in rows]
    found = [tuple(r.values()) for batch in store._blocks(batches) for r in batch.to_pylist()]
    assert found == [(3, "p1"), (7, "p1"), (3, "\0z\x003"), (4, "\0z\x003"), (9, "\0bob\x009")]
