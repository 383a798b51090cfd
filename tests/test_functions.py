import random

import pytest
from pyspark.sql import functions as F

from onefold.functions import contact, dates, places, skills, text


@pytest.fixture
def apply(spark):
    def run(function, values):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.o for r in frame.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]

    return run


def test_email(apply):
    assert apply(contact.email, ["  Jane.Doe@Example.com ", "<a@b.co>", "not-an-email", "a@b", "", None, " x@y.z "]) == ["jane.doe@example.com", "a@b.co", None, None, None, None, "x@y.z"]


def test_phone(apply):
    given = ["(415) 555-0132", "+1 415-555-0132", "1 415 555 0132", "+44 20 7946 0958", "12345", "call-me-maybe", "4785380592391139", "(415) 911-0132", "+999 1234567", None]
    assert apply(contact.phone, given) == ["+14155550132", "+14155550132", "+14155550132", "+442079460958", None, None, None, None, None, None]


def test_date(apply):
    given = ["2021-03", "2021/3", "2021-03-15", "03/2021", "March 2021", "sept. 2020", "2019 may", "2021", "present", "sometime 2021", "2021-13", "1899", "", None]
    assert apply(dates.date, given) == ["2021-03", "2021-03", "2021-03", "2021-03", "2021-03", "2020-09", "2019-05", "2021", None, None, None, None, None, None]
    assert apply(dates.year, ["May 2016", "nope"]) == [2016, None]


def test_country_and_place(apply):
    assert apply(places.country, ["USA", "de", "DEU", "Germany", "Viet Nam", "Republic of Korea", "Atlantis", "", None]) == ["US", "DE", "DE", "DE", "VN", "KR", None, None, None]
    assert apply(places.place_of_text, ["San Francisco, CA, USA", "Berlin", ""]) == [("San Francisco", "CA", "US"), ("Berlin", None, None), (None, None, None)]


def test_handle(apply):
    assert apply(contact.handle, ["octocat", "@octocat", "https://github.com/Octo/repo/", "https://github.com/", " "]) == ["octocat", "octocat", "Octo", "https://github.com", None]


def test_skills(spark):
    frame = spark.createDataFrame([(["reactjs", "React.js", "golang", "k8s", "Rust", " ", None, "Kubernets"],), (None,)], "v array<string>")
    assert [r[0] for r in frame.select(skills.skills(F.col("v"))).collect()] == [["React", "React", "Go", "Kubernetes", "Rust", None, None, "Kubernetes"], None]


def test_fuzzy_ratios():
    assert skills.indel("abc", "abc") == 100
    assert skills.token_sort("lee sam", "sam lee") == 100
    assert skills.nearest("Javascript") == "JavaScript"
    assert skills.nearest("Underwater hockey") == "Underwater hockey"


def test_rounding_is_that_of_the_exact_value(spark):
    random.seed(1)
    values = [round(random.random(), random.choice([3, 4, 5, 6])) * random.choice([1, 0.85, 0.95]) for _ in range(5000)] + [0.00005 * k for k in range(5000)]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.rounded(F.col("v")).alias("o")).collect()
    assert [r.v for r in found if r.o != round(r.v, 4)] == []
