"""Every query against its SQL, and what must hold when the text operators are taken away."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import same

from onefold.plans import derived, more, queries  # noqa: F401

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_in_sql(spark, small, name):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_without_sql(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


def test_every_document_is_judged(spark, tmp_path):
    texts = ["Das \u00e9l\u00e8ve  a dit\nweb", "abcd  \u3000\x1f", "", None, "1234 \u00a0two\u2003Words not said 4"]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["grounding_every_document"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(0, True, True, False), (1, False, False, False), (2, False, False, False), (3, False, False, False), (4, False, True, True)]


def test_every_source_enters_the_store(spark, small):
    every = {r.ord: r.source for r in derived.records(spark, small).collect()}
    found = queries.queries()["incremental_candidates"](spark, small).collect()
    assert {r.source for r in found} == set(every.values()) and all(every[r.ord] == r.source for r in found)
    first = {r.candidate_id for r in found if r.source in ("ats_json", "recruiter_notes")}
    later = [r for r in found if r.source in ("recruiter_csv", "resume")]
    assert 0 < sum(r.candidate_id in first for r in later) < len(later)
    assert {r.candidate_id for r in queries.queries()["incremental_people"](spark, small).collect()} == {r.candidate_id for r in found}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_text_operators(tmp_path):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, check=True)
