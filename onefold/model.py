"""Records, canonical people, and the constants of trust."""

from __future__ import annotations

#: A source record: `ord` is its place in the batch, `method` how its fields were extracted. Absent fields are null.
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:string>"
LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
FIELDS = {
    "full_name": "string",
    "headline": "string",
    "years_experience": "double",
    "emails": "array<string>",
    "phones": "array<string>",
    "location": LOCATION,
    "location_text": "string",
    "links": LINKS,
    "skills": "array<string>",
    "experience": f"array<{EXPERIENCE}>",
    "education": f"array<{EDUCATION}>",
}
RECORD = {"ord": "long", "source": "string", "method": "string", **FIELDS}
RECORD_DDL = ", ".join(f"{name} {kind}" for name, kind in RECORD.items())

#: Trust in sources, best first, and in methods of extraction.
SOURCE_WEIGHT = {"recruiter_override": 1.00, "ats_json": 0.90, "recruiter_csv": 0.85, "github": 0.75, "resume": 0.55, "recruiter_notes": 0.50}
UNKNOWN_SOURCE, UNKNOWN_METHOD = 0.4, 0.6
METHOD_CERTAINTY = {"human": 1.00, "field_map": 1.00, "api": 0.95, "llm": 0.80, "regex": 0.70}
#: Trust in a source for one field, whatever its weight.
FIELD_SOURCE_WEIGHT = {("full_name", "github"): 0.30}
CONFLICT_PENALTY, AGREEMENT_BONUS = 0.85, 0.07
PRIORITY = tuple(SOURCE_WEIGHT)
REVIEW_THRESHOLD, SPARSE = 0.6, 0.5
REFERENCE_YEAR, MOST_YEARS = 2026, 60
DAMPING, FLOOR = 0.6, 0.4
CORE_FIELDS = ("full_name", "emails", "phones", "location.country", "headline", "years_experience", "skills", "experience", "education")
