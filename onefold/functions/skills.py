"""Skills: aliases by a map, near misses by a fuzzy ratio, anything else as it was written."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from onefold.functions.text import once, table, trimmed

#: Names of skills and other ways to write them.
SKILLS = {
    "JavaScript": ["javascript", "js", "java script", "ecmascript"],
    "TypeScript": ["typescript", "ts"],
    "Python": ["python", "py", "python3"],
    "Java": ["java"],
    "Go": ["go", "golang"],
    "C++": ["c++", "cpp", "cplusplus"],
    "C#": ["c#", "csharp", "c sharp"],
    "React": ["react", "reactjs", "react.js"],
    "Node.js": ["node", "nodejs", "node.js"],
    "Django": ["django"],
    "Flask": ["flask"],
    "SQL": ["sql"],
    "PostgreSQL": ["postgresql", "postgres", "psql"],
    "MySQL": ["mysql"],
    "MongoDB": ["mongodb", "mongo"],
    "Docker": ["docker"],
    "Kubernetes": ["kubernetes", "k8s"],
    "AWS": ["aws", "amazon web services"],
    "GCP": ["gcp", "google cloud", "google cloud platform"],
    "Machine Learning": ["machine learning", "ml"],
    "REST": ["rest", "rest api", "restful"],
    "GraphQL": ["graphql"],
    "Terraform": ["terraform"],
    "Kafka": ["kafka", "apache kafka"],
    "Redis": ["redis"],
    "Spark": ["spark", "apache spark"],
}
LEAST = 88.0

#: Ways to write a skill, in lower case, in the order of SKILLS.
ALIASES = {alias: name for name, others in SKILLS.items() for alias in (name.lower(), *others)}


def indel(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with any part of the longer one of its length, cut at the ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    return max(indel(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str, ratio=indel) -> float:
    one, two = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if not one or not two:
        return 0.0
    if both and (not left or not right):
        return 100.0
    with_left, with_right = (f"{both} {x}".strip() for x in (left, right))
    found = [ratio(with_left, with_right)]
    if both:
        found += [ratio(both, with_left), ratio(both, with_right)]
    return max(found)


def weighted(a: str, b: str) -> float:
    """The best of plain, token and, where the lengths differ much, partial ratios, each scaled by how much it overlooks."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(indel(a, b), 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    sorted_tokens = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    common = 100.0 if set(a.split()) & set(b.split()) else token_set(a, b, partial)
    return max(indel(a, b), scale * partial(a, b), 0.95 * scale * max(sorted_tokens, common))


@lru_cache(maxsize=100_000)
def nearest(skill: str) -> str:
    """The first known skill with the best weighted ratio, if that is high enough; else the skill itself."""
    name = max(SKILLS, key=lambda known: weighted(skill, known))
    return name if weighted(skill, name) >= LEAST else skill


def _nearest(unknown: pd.Series) -> pd.Series:
    return unknown.map(lambda values: None if values is None else [x if x is None else nearest(x) for x in values])


def known(c: Column) -> Column:
    """The name that a skill is an alias of, or null."""
    return F.try_element_at(table(ALIASES), F.lower(trimmed(c)))


def skills(c: Column, fuzzy: bool = True) -> Column:
    """Normalized skills of an array, in place; blank ones are null. Only skills without an alias reach Python."""
    given = F.transform(c, trimmed)
    if not fuzzy:
        return F.transform(given, lambda x: F.when(x != "", F.coalesce(known(x), x)))
    unknown = F.transform(given, lambda x: F.when((x != "") & known(x).isNull(), x))
    return F.zip_with(given, F.pandas_udf(_nearest, "array<string>")(unknown), lambda x, near: F.when(x != "", F.coalesce(known(x), near)))


def mentioned(text: Column) -> Column:
    """Aliases that stand by themselves in a text, in the order of ALIASES."""
    escaped = lambda alias: "".join(ch if ch.isalnum() or ch == " " else f"\\{ch}" for ch in alias)
    alone = lambda low, alias: low.contains(alias) & low.rlike(f"(?<![a-z0-9]){escaped(alias)}(?![a-z0-9])")
    return once(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(alone(low, alias), F.lit(alias)) for alias in ALIASES])))
