"""Views of canonical records that a configuration describes, compiled to columns, with a check of each row.

A configuration has fields of (path, from, type, required, normalize), include_confidence, include_provenance and on_missing:
null, omit or error. Paths are name, a.b, a[0] and a[].b.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onefold.functions import contact, skills
from onefold.model import CORE_FIELDS  # noqa: F401

CANONICAL = ("candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence")
_STEP = re.compile(r"([A-Za-z0-9_]+)(\[(\d*)\])?\Z")
#: Types that a field may declare, and the Spark types that have them.
TYPES = {"string": T.StringType, "string[]": T.ArrayType, "number": (T.DoubleType, T.IntegerType, T.LongType), "integer": (T.IntegerType, T.LongType), "boolean": T.BooleanType, "object": T.StructType}


def parsed(path: str) -> list[tuple[str, int | None, bool]]:
    """(name, index, whether all elements are meant) of each step; a step that is no such thing is a ValueError."""
    out = []
    for step in path.split("."):
        if not (found := _STEP.match(step)):
            raise ValueError(f"{step!r} is no step of a path, in {path!r}")
        out.append((found[1], int(found[3]) if found[3] else None, found[2] == "[]"))
    return out


def at(path: str, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    """The value of a path and its type; None if the schema has no such value."""

    def walk(value: Column | None, kind: T.DataType, steps: list) -> tuple[Column, T.DataType] | None:
        if not steps:
            return value, kind
        (name, index, every), *rest = steps
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        value, kind = F.col(name) if value is None else value[name], kind[name].dataType
        if index is None and not every:
            return walk(value, kind, rest)
        if not isinstance(kind, T.ArrayType):
            return None
        if index is not None:
            return walk(F.get(value, F.lit(index)), kind.elementType, rest)
        inner = walk(F.lit(None), kind.elementType, rest)
        if inner is None:
            return F.array().cast("array<string>"), T.ArrayType(T.StringType())
        return F.filter(F.transform(value, lambda x: walk(x, kind.elementType, rest)[0]), lambda x: x.isNotNull()), T.ArrayType(inner[1])

    return walk(None, schema, parsed(path))


def _normalized(value: Column, kind: T.DataType, name: str | None) -> Column:
    if name == "E164" and isinstance(kind, T.StringType):
        return contact.phone(value)
    if name == "canonical" and isinstance(kind, T.ArrayType):
        return F.array_compact(skills.skills(value))
    if name == "canonical" and isinstance(kind, T.StringType):
        return F.get(skills.skills(F.array(value)), F.lit(0))
    return value


def projected(people: DataFrame, config: dict | None) -> DataFrame:
    """The view, with candidate_id as _id and errors as _errors: what is missing under "error", and what breaks a declared type.

    Under "omit" the fields are in `view`, a map from a field to its JSON, without those that are missing. Without a
    configuration the view is the canonical record.
    """
    if config is None:
        return people.select(F.col("candidate_id").alias("_id"), F.array().cast("array<string>").alias("_errors"), *CANONICAL)
    policy, columns, errors = config.get("on_missing", "null"), {}, []
    for field in config.get("fields", []):
        key, source = field["path"], field.get("from", field["path"])
        found = at(source, people.schema)
        value = F.lit(None).cast("string")
        if found:
            value = _normalized(*found, field.get("normalize"))
            if isinstance(found[1], T.ArrayType):
                value = F.when(F.size(found[0]) > 0, value)
            wanted = TYPES.get(field.get("type", "string"), T.StringType)
            if not isinstance(found[1], wanted):
                errors.append(F.when(value.isNotNull(), F.lit(f"'{key}' is not of type {field.get('type', 'string')}")))
        if policy == "error":
            errors.append(F.when(value.isNull(), F.concat(F.lit(f"missing value for '{key}' (from '{source}') on candidate '"), F.col("candidate_id"), F.lit("'"))))
        elif field.get("required"):
            errors.append(F.when(value.isNull(), F.lit(f"'{key}' is required")))
        columns[key] = value
    if config.get("include_confidence"):
        columns["overall_confidence"] = F.col("overall_confidence")
    if config.get("include_provenance"):
        columns["provenance"] = F.col("provenance")
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    if policy == "omit":
        whole = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), "$.v").alias("value"), v.isNotNull().alias("there")) for k, v in columns.items()])
        view = F.map_from_entries(F.transform(F.filter(whole, lambda x: x["there"]), lambda x: F.struct(x["key"], x["value"])))
        return people.select(F.col("candidate_id").alias("_id"), found.alias("_errors"), view.alias("view"))
    return people.select(F.col("candidate_id").alias("_id"), found.alias("_errors"), *[v.alias(k) for k, v in columns.items()])


def parted(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are valid, and (candidate_id, error) of the others. One bad row spoils no other."""
    good = view.where(F.size("_errors") == 0).drop("_id", "_errors")
    return good, view.where(F.size("_errors") > 0).select(F.col("_id").alias("candidate_id"), F.get("_errors", F.lit(0)).alias("error"))


def violations(people: DataFrame) -> Column:
    """What breaks the canonical schema: no id, or dates of jobs that are neither YYYY nor YYYY-MM."""
    wrong = lambda d: d.isNotNull() & ~d.rlike("^[0-9]{4}(-[0-9]{2})?$")
    tests = (("candidate_id", F.col("candidate_id").isNull()), ("experience", F.exists("experience", lambda e: reduce(lambda x, y: x | y, (wrong(e["start"]), wrong(e["end"]))))))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))
