"""Free text: recruiters' notes, and resumes with sections. Only what the text says, found by patterns, is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.functions import skills
from onefold.functions.text import clean, once, trimmed
from onefold.sources import docx
from onefold.sources.common import lines_of, record, texts

#: Patterns of what texts hold.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9\-\s().]{7,}[0-9]"
GITHUB = r"(?i)github\.com/([A-Za-z0-9\-]+)|github\s*[:\-]\s*@?(?!github\b)([A-Za-z0-9\-]+)"
LINKEDIN = r"(?i)linkedin\.com/in/([A-Za-z0-9\-]+)"
NAME = r"(?im)^\s*name\s*[:\-]\s*([^\n]+)$"
YEARS = r"(?i)([0-9]{1,2}(?:\.[0-9])?)\+?\s*(?:years|yrs)\b"
PORTFOLIO = r"(?i)(?:portfolio|website)\s*[:\-]?\s*(https?://\S+)"
JOB = r"(?i)^(.+?)\s+at\s+(.+?)\s*\(([^)]+)\)\s*$"
STUDY = r"^(.+?),\s*(.+?),\s*([0-9]{4})\s*$"
DEGREE = r"(?i)\b(?:Ph\.?D|B\.?E|B\.?Tech|B\.?Sc|B\.?S|B\.?A|M\.?E|M\.?Tech|M\.?Sc|M\.?S|M\.?A|M\.?B\.?A|Bachelor|Master|Diploma)\b\.?"
DATE = r"(?:[A-Za-z]{3,9}\.?\s+[0-9]{4}|[0-9]{4}[-/][0-9]{1,2}|[0-9]{4})"
RANGE = rf"(?i)({DATE})\s*(?:-|–|—|to|until)\s*({DATE}|present|current|now|ongoing)"
YEAR = r"\b((?:19|20)[0-9]{2})\b"
SCHOOL = r"(?i)(University|Institute|College|School|Polytechnic|Academy)"
HEADINGS = (
    "education", "experience", "work experience", "professional experience", "employment", "skills", "technical skills", "projects", "certifications", "summary",
    "objective", "awards", "publications", "languages", "interests", "achievements", "publications & achievements", "contact", "profile",
)
#: Dashes and bullets that fonts of documents make of "-".
FOLDED = "�–—―•·●‣"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def every(text: Column, pattern: str) -> Column:
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), trimmed)
    return F.when(F.size(values) > 0, values)


def name_in(text: Column) -> Column:
    """What a line "Name: …" says, else the first line that isn't blank if it is two to four capitalized words of letters."""
    first = F.get(F.filter(F.transform(lines_of(text), trimmed), lambda x: x != ""), F.lit(0))
    looks = first.rlike(r"^\p{Lu}") & first.rlike(r"^\p{L}+( +\p{L}+){1,3}$")
    return F.coalesce(clean(F.regexp_extract(text, NAME, 1)), F.when(looks, first))


def _links(text: Column, portfolio: bool) -> Column:
    github = F.coalesce(found(text, GITHUB, 1), found(text, GITHUB, 2))
    profile = F.concat(F.lit("https://www.linkedin.com/in/"), found(text, LINKEDIN))
    page = found(text, PORTFOLIO) if portfolio else F.lit(None).cast("string")
    return F.when(F.coalesce(github, profile, page).isNotNull(), F.struct(profile.alias("linkedin"), github.alias("github"), page.alias("portfolio"), F.lit(None).cast("array<string>").alias("other")))


def _basics(text: Column, portfolio: bool = False) -> dict[str, Column]:
    return {
        "emails": every(text, EMAIL),
        "phones": every(text, PHONE),
        "links": _links(text, portfolio),
        "full_name": name_in(text),
        "years_experience": found(text, YEARS).cast("double"),
    }


def _filled(values: Column) -> Column:
    return once(values, lambda v: F.when(F.size(v) > 0, v))


def notes(rows: DataFrame, place: list[str], column: str = "text") -> DataFrame:
    """A record of each note that says anything."""
    text = F.col(column)
    return record(rows, "recruiter_notes", "regex", place, **_basics(text), skills=_filled(skills.mentioned(text)))


# sections of resumes


def _key(line: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(line)), ":+$", "")


def is_heading(line: Column) -> Column:
    """A known heading, or at most three words and thirty characters in capitals."""
    loud = lambda raw: (raw != "") & (F.upper(raw) == raw) & (F.size(F.split(raw, r"\s+")) <= 3) & (F.length(raw) <= 30) & raw.rlike(r"\p{L}")
    return once(trimmed(line), lambda raw: F.regexp_replace(F.lower(raw), ":+$", "").isin(*HEADINGS) | loud(raw))


def section(lines: Column, *names: str) -> Column:
    """The lines below the first heading of these names, to the next heading, trimmed, without blank ones."""
    place = lambda tests: F.array_position(tests, F.lit(True)).cast("int")

    def inside(rest: Column) -> Column:
        upto = once(place(F.transform(rest, is_heading)), lambda stop: F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rest))))
        return F.filter(F.transform(upto, trimmed), lambda x: x != "")

    start = place(F.transform(lines, lambda x: _key(x).isin(*[n.lower() for n in names])))
    # each step is computed once for a text, not once for each of its lines
    return once(start, lambda at: F.when(at > 0, once(F.slice(lines, at + 1, F.size(lines)), inside)).otherwise(F.array().cast("array<string>")))


def _plain(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~F.substring(x, 1, 1).isin("-", "•", "*", "·"))


def skills_of(lines: Column, text: Column) -> Column:
    """What the skills section lists, then known skills named anywhere; spellings that differ in case only once."""

    def tokens(line: Column) -> Column:
        label = F.substring_index(line, ":", 1)
        rest = F.when(line.contains(":") & (F.length(label) <= 25) & ~label.contains(","), F.substring(line, F.length(label) + 2, F.length(line))).otherwise(line)
        parts = F.transform(F.split(F.regexp_replace(rest, r"\([^)]*\)", ""), "[,;|•]"), lambda t: F.regexp_replace(t, r"^[ .\-]+|[ .\-]+$", ""))
        return F.filter(parts, lambda t: (t != "") & (F.length(t) <= 40) & t.rlike("[A-Za-z]"))

    listed = F.flatten(F.transform(section(lines, "Technical Skills", "Skills"), tokens))
    first = lambda said, lower: F.filter(said, lambda s, i: F.array_position(lower, F.get(lower, i)) == i + 1)
    return once(F.concat(listed, skills.mentioned(text)), lambda said: once(F.transform(said, F.lower), lambda lower: first(said, lower)))


def jobs(lines: Column) -> Column:
    """"Title at Company (start to end)", or "Title | Company | start - end"."""
    none = F.lit(None).cast("string")

    def job(line: Column) -> Column:
        span = F.split(F.regexp_extract(line, JOB, 3), r"\s+(?:to|until|–|—)\s+", 2)
        strict = F.struct(trimmed(F.regexp_extract(line, JOB, 2)).alias("company"), trimmed(F.regexp_extract(line, JOB, 1)).alias("title"), trimmed(F.get(span, F.lit(0))).alias("start"), trimmed(F.get(span, F.lit(1))).alias("end"), none.alias("summary"))
        head = F.regexp_replace(F.get(F.split(line, RANGE, 2), F.lit(0)), r"^[ |\-–—]+|[ |\-–—]+$", "")
        parts = F.filter(F.transform(F.split(head, r"\|"), trimmed), lambda s: s != "")
        loose = F.struct(F.get(parts, F.lit(1)).alias("company"), F.get(parts, F.lit(0)).alias("title"), F.regexp_extract(line, RANGE, 1).alias("start"), F.regexp_extract(line, RANGE, 2).alias("end"), none.alias("summary"))
        return F.when(line.rlike(JOB), strict).when(line.rlike(RANGE) & (F.size(parts) > 0), loose)

    return F.array_compact(F.transform(_plain(section(lines, "Experience", "Work Experience", "Professional Experience")), job))


def studies(lines: Column) -> Column:
    """"Degree in Field, Institution, Year", or a line with a degree or bars; a year of the section stands in for a missing one."""
    none = F.lit(None).cast("string")

    def study(line: Column, some_year: Column) -> Column:
        degree = trimmed(F.regexp_extract(line, STUDY, 1))
        has_field = degree.contains(" in ")
        strict = F.struct(
            trimmed(F.regexp_extract(line, STUDY, 2)).alias("institution"),
            F.when(has_field, trimmed(F.substring_index(degree, " in ", 1))).otherwise(degree).alias("degree"),
            F.when(has_field, trimmed(F.substring(degree, F.instr(degree, " in ") + 4, F.length(degree)))).otherwise(none).alias("field"),
            F.regexp_extract(line, STUDY, 3).alias("end_year"),
        )
        parts = F.filter(F.transform(F.split(line, r"\|"), trimmed), lambda s: s != "")
        first = F.coalesce(F.get(parts, F.lit(0)), line)
        token = found(first, f"({DEGREE})")
        after = F.regexp_replace(F.get(F.split(first, DEGREE, 2), F.lit(1)), r"^[ \-–—:,]+|[ \-–—:,]+$", "")
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        school = F.coalesce(F.get(F.filter(rest, lambda s: s.rlike(SCHOOL)), F.lit(0)), F.get(parts, F.lit(1)))
        loose = F.struct(trimmed(F.substring_index(school, ",", 1)).alias("institution"), token.alias("degree"), F.when(token.isNotNull() & (after != ""), after).alias("field"), F.coalesce(found(line, YEAR), some_year).alias("end_year"))
        return F.when(line.rlike(STUDY), strict).when(line.rlike(DEGREE) | line.contains("|"), loose)

    every = lambda inside: once(found(F.concat_ws(" ", inside), YEAR), lambda year: F.transform(_plain(inside), lambda line: study(line, year)))
    return F.array_compact(once(section(lines, "Education"), every))


def folded(text: Column) -> Column:
    return F.translate(text, FOLDED, "-" * len(FOLDED))


def resumes(rows: DataFrame, place: list[str], column: str = "text", urls: Column | None = None) -> DataFrame:
    """A record of each resume's text. Links of the document (`urls`) come before those its text shows."""
    rows = rows.withColumn("_folded", folded(F.col(column))).withColumn("_lines", lines_of(F.col("_folded")))
    text, lines = F.col("_folded"), F.col("_lines")
    fields = _basics(text, portfolio=True)
    if urls is not None:
        of, own = fields["links"], links_of(urls)
        parts = {x: F.coalesce(own[x], of[x]) if x in ("github", "linkedin") else of[x] for x in ("linkedin", "github", "portfolio")}
        fields["links"] = F.when(F.coalesce(*parts.values()).isNotNull(), F.struct(*[c.alias(x) for x, c in parts.items()], F.lit(None).cast("array<string>").alias("other")))
    return record(rows, "resume", "regex", place, **fields, skills=_filled(skills_of(lines, text)), experience=_filled(jobs(lines)), education=_filled(studies(lines)))


def links_of(urls: Column) -> Column:
    """(github, linkedin): the first handle and the first profile among a document's links."""
    handle = lambda u: F.substring_index(F.substring_index(F.substring_index(F.regexp_replace(u, "/+$", ""), "github.com/", -1), "/", 1), "?", 1)
    fine = lambda u: F.lower(F.regexp_replace(u, "/+$", "")).contains("github.com/") & (handle(u) != "") & ~F.lower(handle(u)).isin("about", "login", "features")
    github = F.get(F.transform(F.filter(urls, fine), handle), F.lit(0))
    profile = F.get(F.transform(F.filter(urls, lambda u: F.lower(u).contains("linkedin.com/in/")), lambda u: F.substring_index(u, "?", 1)), F.lit(0))
    return F.struct(github.alias("github"), profile.alias("linkedin"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return notes(texts(spark, path).withColumn("at", F.lit(0)), ["path", "at"])


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """Resumes whose text was extracted to .txt files, as that of PDF must be, for which no library is here."""
    return resumes(texts(spark, path).withColumn("at", F.lit(0)), ["path", "at"])


def read_docx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Resumes in DOCX files; links of a document come before those its text shows."""
    return resumes(docx.texts(spark, path).withColumn("at", F.lit(0)), ["path", "at"], urls=F.col("urls"))
