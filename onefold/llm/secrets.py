"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy for each character class. DataFrame functions only.

Candidate strings are the longest runs of base64's characters; one of hexadecimal digits alone is of that class. A window of fixed width slides over each candidate;
its counts change by the character that enters and the one that leaves, and with them the sum of c * log2(c), from which
the entropy is log2(width) - sum / width. The sum is kept in whole numbers of 2**-20, so it does not drift. Windows of
enough entropy that touch are one span. Candidates that match the allow list give none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.llm import common

#: Patterns of secrets by kind, with the length that the match or its second group must have.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

WIDTH, SCALE = 20, 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Its characters, a pattern that tells its candidates from others, and the bits a character that a window must have."""

    name: str
    characters: str
    pattern: str
    bits: float

    @property
    def most(self) -> int:
        """The largest scaled sum of c * log2(c) of a window of enough entropy."""
        return math.floor(WIDTH * (math.log2(WIDTH) - self.bits) * SCALE)


CANDIDATE = "A-Za-z0-9+/_-"
CLASSES = (
    CharacterClass("entropy_hex", "0123456789ABCDEFabcdef", "^[0-9A-Fa-f]+$", 3.0),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "[^0-9A-Fa-f]", 3.8),
)
#: Candidates that are no secrets: without digits (words, paths), of digits alone (numbers), UUIDs, and examples.
ALLOWED = (r"^[^0-9]*$", r"^[0-9+/_-]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i:example|sample|dummy|placeholder)")

KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
_SPAN = "struct<start:int,kind:int,end:int,text:string>"


def scaled(count: int) -> int:
    """c * log2(c) in whole numbers of 2**-20."""
    return round(count * math.log2(count) * SCALE) if count else 0


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose `group` has `least` characters, as spans in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("text")).cast(_SPAN)
        return F.struct(end.alias("at"), F.when(F.length(x["group"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), _none().alias("spans")), step, lambda acc: acc["spans"])


def _windows(candidate: Column, kind: int, of: CharacterClass) -> Column:
    """Spans of a candidate in which every window has enough entropy."""
    rises = F.array(*[F.lit(scaled(c + 1) - scaled(c)) for c in range(WIDTH + 1)])
    codes = F.transform(F.split(candidate["text"], ""), lambda ch: F.instr(F.lit(of.characters), ch))
    size = F.size(codes)
    steps = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), F.get(codes, i - 1).alias("new"), F.coalesce(F.get(codes, i - 1 - WIDTH), F.lit(0)).alias("old")))

    def step(acc: Column, x: Column) -> Column:
        old = F.coalesce(F.get(acc["counts"], x["old"] - 1), F.lit(0)) + F.when(x["old"] == x["new"], 1).otherwise(0)
        total = acc["total"] + F.get(rises, F.get(acc["counts"], x["new"] - 1)) - F.when(x["old"] > 0, F.get(rises, old - 1)).otherwise(F.lit(0))
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == x["new"], 1).otherwise(0) - F.when(k + 1 == x["old"], 1).otherwise(0))
        start, end = candidate["start"] + x["i"] - WIDTH, candidate["start"] + x["i"]
        touches = (F.size(acc["spans"]) > 0) & (F.get(acc["spans"], F.size(acc["spans"]) - 1)["end"] >= start)
        last = F.get(acc["spans"], F.size(acc["spans"]) - 1)
        span = F.struct(F.when(touches, last["start"]).otherwise(start).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.lit("").alias("text")).cast(_SPAN)
        before = F.when(touches, F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1)).otherwise(acc["spans"])
        spans = F.when((x["i"] >= WIDTH) & (total <= of.most), F.concat(before, F.array(span))).otherwise(acc["spans"])
        return F.struct(counts.alias("counts"), total.alias("total"), spans.alias("spans"))

    start = F.struct(F.array_repeat(F.lit(0), len(of.characters)).alias("counts"), F.lit(0).cast("long").alias("total"), _none().alias("spans"))
    return F.aggregate(steps, start, step, lambda acc: acc["spans"])


def _entropy(text: Column) -> Column:
    run = f"(?<![{CANDIDATE}])[{CANDIDATE}]{{{WIDTH},}}"
    fine = lambda x: ~F.greatest(*[x["text"].rlike(allowed) for allowed in ALLOWED])
    candidates = F.filter(_matches(text, run, 0, 0, WIDTH), fine)
    of_class = lambda of: F.filter(candidates, lambda x: x["text"].rlike(of.pattern))
    found = F.flatten(F.concat(*[F.transform(of_class(of), lambda x: _windows(x, 3 + i, of)) for i, of in enumerate(CLASSES)]))  # noqa: B023
    return F.when(text.rlike(run), found).otherwise(_none())


def _spans(text: Column) -> tuple[Column, Column]:
    """The spans of the fixed patterns, and those of the entropy."""
    assign = F.when(text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), _matches(text, ASSIGN, 0, 2, ASSIGN_LEAST)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS, 1, 0, ACCESS_LEAST)).otherwise(_none())
    # a longest run of 16 or more is the match of the pattern, as such runs don't overlap
    digits = F.when(text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), _matches(text, f"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}", 2, 0, HEX_LEAST)).otherwise(_none())
    return F.concat(assign, access, digits), _entropy(text)


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and the arrays base and more of spans (start, kind as a number in `KINDS`, end, text) of every whole text.

    Offsets are code points, ends exclusive. Null texts are empty; a null doc_id stays null; repeated rows are scanned
    each by itself; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    base, more = _spans(F.col("text"))
    return docs.withColumns({"base": base, "more": more})


def digests(docs: DataFrame) -> DataFrame:
    """Counts of each fixed kind and the listed spans of every document."""
    found = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts (overlapping spans as one) as `mark`; columns as they were, n_chars counted anew where there is one.

    Nulls and texts without secrets stay as they are.
    """
    base, more = _spans(common.text_of(docs))
    spans = F.array_sort(F.concat(base, more))

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        over = (F.size(acc) > 0) & (x["start"] < last["end"])
        one = F.struct(F.when(over, last["start"]).otherwise(x["start"]).alias("start"), F.when(over, F.greatest(last["end"], x["end"])).otherwise(x["end"]).alias("end"))
        return F.concat(F.when(over, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc), F.array(one))

    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), merge)
    text, found = F.col("text").cast("string"), F.col("__spans")
    begin = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
    parts = F.transform(found, lambda x, i: F.concat(F.substring(text, begin(i) + 1, x["start"] - begin(i)), F.lit(mark)))
    tail = F.substring(text, begin(F.size(found)) + 1, F.length(text))
    new = F.when(F.size(found) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    out = docs.withColumn("__spans", merged).withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def sql() -> str:
    """The digests in DuckDB's SQL, each window counted by itself."""

    def spans(kind: str, order: int, pattern: str, length: str, group: int) -> str:
        return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS s, m[i] AS found
        FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM
              (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {group}) AS g, string_split_regex(t, {pattern}) AS p FROM d))
        WHERE {length}"""

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = quote(ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", either))
    table = "[" + ", ".join(str(scaled(c)) for c in range(1, WIDTH + 1)) + "]"
    classes = []
    for i, of in enumerate(CLASSES):
        allowed = " OR ".join(f"regexp_matches(found, {quote(a)})" for a in ALLOWED)
        total = f"list_sum([({table})[{WIDTH} - length(replace(w, x, ''))] for x in list_distinct(string_split(w, ''))])"
        classes.append(
            f"""c{i} AS ({spans(of.name, 3 + i, quote(f"[{CANDIDATE}]{{{WIDTH},}}"), f"regexp_matches(m[i], {quote(of.pattern)})", 0)}),
     w{i} AS (SELECT doc_id, kind, o, s, s + b AS ws, row_number() OVER (PARTITION BY doc_id, s ORDER BY b) AS r, b FROM
              (SELECT *, substr(found, b + 1, {WIDTH}) AS w FROM (SELECT *, unnest(range(0, length(found) - {WIDTH - 1})) AS b FROM c{i} WHERE NOT ({allowed}))) WHERE {total} <= {of.most}),
     j{i} AS (SELECT *, CASE WHEN ws - lag(ws) OVER (PARTITION BY doc_id, s ORDER BY b) <= {WIDTH} THEN 0 ELSE 1 END AS fresh FROM w{i}),
     k{i} AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY b) AS island FROM j{i}),
     e{i} AS (SELECT doc_id, kind, o, min(ws) AS s, max(ws) + {WIDTH} AS e FROM k{i} GROUP BY doc_id, kind, o, s, island)"""
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     b AS ({spans("assign", 0, assign, f"length(g[i]) >= {ASSIGN_LEAST}", 2)} UNION ALL {spans("access", 1, quote(ACCESS), f"length(m[i]) >= {ACCESS_LEAST}", 0)}
           UNION ALL {spans("hex", 2, quote(HEX), f"length(m[i]) >= {HEX_LEAST}", 0)}),
     {", ".join(classes)},
     a AS (SELECT doc_id, kind, o, s, s + length(found) AS e FROM b UNION ALL {" UNION ALL ".join(f"SELECT doc_id, kind, o, s, e FROM e{i}" for i in range(len(CLASSES)))}),
     l AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
                  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l ON d.doc_id = l.doc_id"""
