import time

from onefold.sources import text


def test_a_long_resume_is_read_line_by_line(spark):
    """Sections are found once for a text: work that grew with the square of its lines took hours for this one."""
    lines = ["Ann Poe", "SKILLS", *[f"Craft{i}, weaving" for i in range(1500)], "EXPERIENCE", *[f"Engineer at Acme{i} (2015-01 to present)" for i in range(1500)], "EDUCATION", "BSc in Physics, MIT, 1999"]
    began = time.monotonic()
    found = text.resumes(spark.createDataFrame([(1, "\n".join(lines)), (2, "SKILLS"), (3, None)], "k long, cv string"), ["k"], "cv").collect()
    assert time.monotonic() - began < 60
    assert [r.k for r in found] == [1] and len(found[0].skills) == 1501 and found[0].skills[:2] == ["Craft0", "weaving"]
    assert [e.company for e in found[0].experience] == [f"Acme{i}" for i in range(1500)] and found[0].education[0].institution == "MIT"
