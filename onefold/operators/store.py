"""A store of people that grows: batches of records are linked to who is known, and only people they touch are resolved anew.

A store is six tables: records (with record_id, candidate_id, origin), keys (of each record), people, reviewed
(candidate_id), corrections (candidate_id, field, value, seq) and displaced (source, one row for each corrected value that a source had
won). The first three are kept in parts: a batch adds a part of what is new, which counts instead of rows with the same
key in earlier parts, and when there are many they become one. So a batch is read against the store's keys, but
writes no more than it touches. Every step gives a new state; none changes a table in place.

`save` makes a state the next version below its root, and `load` gives it back, in another session too.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from onefold.functions.skills import token_sort
from onefold.model import FIELDS, REVIEW_THRESHOLD
from onefold.operators import calibration, trust
from onefold.operators.components import components
from onefold.operators.durable import Versions
from onefold.operators.records import identity_keys, normalized
from onefold.operators.resolve import gathered, resolved
from onefold.scratch import joined, written

STRONG = ("email", "phone", "github")
NAME_LEAST, LINK_LEAST = 92.0, 0.9
#: Parts of a table before they become one.
PARTS = 6
_RECORDS = "record_id string, candidate_id string, origin string, ord long, source string, method string, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items())
_KEYS = "record_id string, candidate_id string, key_type string, key_value string"
#: Corrections that have a field of their own in a record; others are kept, but resolve nothing.
_TEXTS = ("full_name", "headline")


@dataclass(frozen=True)
class Parts:
    """A table in parts, the latest last."""

    key: str
    frames: tuple[DataFrame, ...]

    def whole(self) -> DataFrame:
        """The rows whose key no later part has."""
        out = [self.frames[-1]]
        for i in range(len(self.frames) - 1):
            later = reduce(DataFrame.unionByName, [x.select(self.key) for x in self.frames[i + 1 :]])
            out.append(joined(self.frames[i], later, self.key, "left_anti"))
        return reduce(lambda a, b: a.unionByName(b.select(a.columns)), out)


@dataclass(frozen=True)
class State:
    spark: SparkSession
    parts: dict[str, Parts]
    reviewed: DataFrame
    corrections: DataFrame
    displaced: DataFrame
    threshold: float = REVIEW_THRESHOLD
    root: str | None = None
    #: What each stream has brought: its last batch.
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def records(self) -> DataFrame:
        return self.parts["records"].whole()

    @property
    def keys(self) -> DataFrame:
        """(record_id, candidate_id, key_type, key_value)"""
        return self.parts["keys"].whole().where("key_type is not null")

    @property
    def people(self) -> DataFrame | None:
        return self.parts["people"].whole() if "people" in self.parts else None


def empty(spark: SparkSession, root: str | None = None) -> State:
    """A store without people. Its tables go below `root`, or to the scratch folder where nothing is to outlive the session."""
    make = lambda ddl: spark.createDataFrame([], ddl)
    parts = {"records": Parts("record_id", (make(_RECORDS),)), "keys": Parts("record_id", (make(_KEYS),))}
    return State(spark, parts, make("candidate_id string"), make("candidate_id string, field string, value string, seq long"), make("source string"), root=root)


def _put(state: State, df: DataFrame, name: str) -> DataFrame:
    return written(df, name, state.root and f"{state.root.rstrip('/')}/tables")


def _added(state: State, name: str, key: str, new: DataFrame) -> State:
    """The state with `new` as the latest part of a table."""
    known = state.parts[name].frames if name in state.parts else ()
    parts = Parts(key, (*known, _put(state, new, name)))
    if len(parts.frames) > PARTS:
        parts = Parts(key, (_put(state, parts.whole(), name),))
    return replace(state, parts=state.parts | {name: parts})


def save(state: State) -> int:
    """Makes the state the next version below its root and returns its number. An error if another writer was first."""
    if not state.root:
        raise ValueError("a store without a root can't be saved")
    versions = Versions(state.spark, state.root)
    path = lambda df, name: _path(df) or _path(_put(state, df, name))
    tables = {name: [path(x, name) for x in parts.frames] for name, parts in state.parts.items()}
    small = {name: path(getattr(state, name), name) for name in ("reviewed", "corrections", "displaced")}
    schemas = {name: parts.frames[-1].schema.json() for name, parts in state.parts.items()}
    number = versions.latest() + 1
    versions.commit(number, {"parts": tables, "schemas": schemas, "small": small, "threshold": state.threshold, "streams": state.streams})
    return number


def _path(df: DataFrame) -> str | None:
    """The folder of a table that `written` made."""
    return getattr(df, "_onefold_path", None)


def load(spark: SparkSession, root: str, version: int | None = None) -> State:
    """The state of a version below `root`, the latest by default; an empty one if there is none."""
    versions, none = Versions(spark, root), empty(spark, root)
    number = versions.latest() if version is None else version
    if not number:
        return none
    found = versions.read(number)

    def read(path: str, schema) -> DataFrame:
        out = spark.read.schema(schema).parquet(path)
        out._onefold_path = path
        return out

    keys = {"records": "record_id", "keys": "record_id", "people": "candidate_id"}
    parts = {name: Parts(keys[name], tuple(read(x, StructType.fromJson(json.loads(found["schemas"][name]))) for x in paths)) for name, paths in found["parts"].items()}
    small = {name: read(path, getattr(none, name).schema) for name, path in found["small"].items()}
    return replace(none, parts=parts, threshold=found["threshold"], streams=found["streams"], **small)


def record_id(origin: Column) -> Column:
    """A hash of the source and the record, or of the source and its origin, which stays when what it says changes."""
    content = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "true"})
    return F.sha1(F.when(origin.isNull(), F.concat_ws("|", "source", content)).otherwise(F.concat_ws("|", F.col("source"), F.lit("origin"), origin)))


def score(known: set[tuple[str, str]], new: set[tuple[str, str]]) -> float:
    """1 for a shared strong key; a name decides only between two without strong keys."""
    strong = [{k for k in keys if k[0] in STRONG} for keys in (known, new)]
    if strong[0] & strong[1]:
        return 1.0
    if strong[0] or strong[1]:
        return 0.0
    names = [min((v for t, v in keys if t == "name"), default="") for keys in (known, new)]
    ratio = token_sort(*names) if all(names) else 0.0
    return round(ratio / 100, 4) if ratio >= NAME_LEAST else 0.0


def _linked(rows: Iterable[tuple]) -> Iterator[tuple[int, str]]:
    """In order, links each new record of a block to the best known or new person, or makes one. A new person's id is its base and its record's ord.

    `rows` are (ord, candidate_id, key_type, key_value), the keys of known people first, with ord -1, then those of new records by ord.
    """
    people: dict[str, set[tuple[str, str]]] = defaultdict(set)
    who: dict[tuple[str, str], set[str]] = defaultdict(set)
    for at, own in groupby(rows, itemgetter(0)):
        if at < 0:
            for _, cid, *key in own:
                people[cid].add(tuple(key))
                who[tuple(key)].add(cid)
            continue
        keys = {(kind, value) for _, _, kind, value in own if kind is not None}
        best, found = 0.0, None
        for cid in sorted(set().union(*(who[key] for key in keys))):
            if (s := score(people[cid], keys)) > best:
                best, found = s, cid
            if best == 1.0:  # none is better, and the ones to come are later
                break
        if found is None or best < LINK_LEAST:
            emails, names = (sorted(v for t, v in keys if t == kind) for kind in ("email", "name"))
            base = emails[0] if emails else names[0].replace(" ", "-") if names else "candidate"
            found = f"\0{base}\0{at}"
        people[found] |= keys
        for key in keys:
            who[key].add(found)
        yield at, found


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, token) of rows (block, ord, candidate_id, key_type, key_value) in the order of blocks and ords, a block at a time."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
    tokens = (token for _, block in groupby(rows, itemgetter(0)) for token in _linked(row[1:] for row in block))
    while some := list(islice(tokens, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), (pa.int64(), pa.string()), strict=True)], names=["ord", "token"])


def _named(tokens: DataFrame, taken: DataFrame) -> DataFrame:
    """(token, candidate_id): ids for new people, with -2, -3 … after those that are taken."""
    new = tokens.where(F.col("token").startswith("\0")).select("token").distinct()
    new = new.select("token", F.split("token", "\0")[1].alias("base"), F.split("token", "\0")[2].cast("long").alias("first"))
    used = taken.select(F.regexp_replace("candidate_id", "-[0-9]+$", "").alias("base"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(candidate_id, '-([0-9]+)$', 1), '') AS int)"), F.lit(1)).alias("n"))
    plain = taken.select(F.col("candidate_id").alias("base"), F.lit(1).alias("n"))
    last = used.unionByName(plain).groupBy("base").agg(F.max("n").alias("last"))
    turn = F.row_number().over(Window.partitionBy("base").orderBy("first"))
    number = F.coalesce("last", F.lit(0)) + turn
    return joined(new, last, "base", "left").select("token", F.when(number == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string"))).alias("candidate_id"))


def ingest(state: State, batch: DataFrame, origin: str | None = None) -> State:
    """The state with the records of `batch` (model.RECORD; `origin` names a column of stable ids).

    A record that is known is passed over; one with a known origin replaces what that origin said and stays with its person.
    Within the batch the least ord of equal ids counts. Records that share keys are linked in the order of ord, those of
    different blocks apart from each other; a name is a key only of records without strong ones.
    """
    own = F.col(origin) if origin else F.lit(None).cast("string")
    new = batch.withColumn("origin", own).withColumn("record_id", record_id(own))
    new = new.withColumn("_turn", F.row_number().over(Window.partitionBy("record_id").orderBy("ord"))).where("_turn = 1").drop("_turn")
    known = state.records.select("record_id", F.col("candidate_id").alias("known_id"))
    new = written(joined(new, known, "record_id", "left").where("known_id is null or origin is not null"), "batch")
    refreshed = new.where("known_id is not null").withColumn("candidate_id", F.col("known_id"))
    fresh = new.where("known_id is null")

    every = written(identity_keys(normalized(new, fuzzy=False)), "keys")  # ord tells the records of a batch apart
    keys = joined(every, fresh.select("ord"), "ord", "left_semi")
    usable = written(keys.where("key_type <> 'name'").unionByName(joined(keys, keys.where("key_type <> 'name'").select("ord"), "ord", "left_anti")), "usable")
    old = state.keys.drop("record_id").distinct()
    touched = joined(old, usable.select("key_type", "key_value").distinct(), ["key_type", "key_value"], "left_semi").select("candidate_id").distinct()
    old = written(joined(old, touched, "candidate_id", "left_semi"), "known")  # the keys of people whom the batch may mean
    strong_ids = old.where("key_type <> 'name'").select("candidate_id").distinct()
    candidates = old.where("key_type <> 'name'").unionByName(joined(old.where("key_type = 'name'"), strong_ids, "candidate_id", "left_anti").select(old.columns))
    nodes = usable.select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("node"), "key_type", "key_value", "ord", F.lit(None).cast("string").alias("candidate_id"))
    nodes = written(nodes.unionByName(candidates.select(F.concat(F.lit("c"), F.col("candidate_id")).alias("node"), "key_type", "key_value", F.lit(None).cast("long").alias("ord"), "candidate_id")), "nodes")
    hubs = nodes.groupBy("key_type", "key_value").agg(F.min("node").alias("hub"))
    blocks = components(joined(nodes, hubs, ["key_type", "key_value"]).select("node", "hub"), "node", "hub")
    blocked = joined(nodes, blocks, "node", "left").withColumn("block", F.coalesce("component", "node"))
    # a number of partitions of our own, as blocks are small but many, and Spark would put them all into one by their bytes
    dealt = blocked.select("block", F.coalesce("ord", F.lit(-1)).alias("ord"), "candidate_id", "key_type", "key_value").repartition(int(state.spark.conf.get("spark.sql.shuffle.partitions")), "block")
    tokens = dealt.sortWithinPartitions("block", "ord").mapInArrow(_blocks, "ord long, token string")
    bare = joined(fresh, usable.select("ord").distinct(), "ord", "left_anti").select("ord", F.concat(F.lit("\0candidate\0"), F.col("ord").cast("string")).alias("token"))
    tokens = written(tokens.unionByName(bare), "tokens")
    ids = _named(tokens, state.parts["records"].whole().select("candidate_id").distinct())
    linked = joined(joined(fresh, tokens, "ord"), ids, "token", "left").withColumn("candidate_id", F.coalesce(ids["candidate_id"], F.col("token")))
    columns = state.parts["records"].frames[0].columns
    added = _put(state, linked.select(columns).unionByName(refreshed.select(columns)), "records")
    state = _added(state, "records", "record_id", added)
    # a record without keys has a row too, so that the keys it had count no more
    state = _added(state, "keys", "record_id", joined(added.select("record_id", "candidate_id", "ord"), every, "ord", "left").select("record_id", "candidate_id", "key_type", "key_value"))
    return _saved(state, added.select("candidate_id").distinct())


def overrides(corrections: DataFrame) -> DataFrame:
    """One record of the most trusted source for each person's latest corrections; those that are no value of their field are none."""
    latest = corrections.groupBy("candidate_id", "field").agg(F.max_by("value", "seq").alias("value"))
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("value")))
    rows = latest.groupBy("candidate_id").agg(*[value(f).alias(f) for f in (*_TEXTS, "years_experience", "emails", "phones", "location")])
    given = {f: F.col(f) for f in _TEXTS} | {
        "years_experience": F.expr("try_cast(years_experience AS double)"),
        "emails": F.when(F.col("emails").isNotNull(), F.array("emails")),
        "phones": F.when(F.col("phones").isNotNull(), F.array("phones")),
        "location_text": F.col("location"),
    }
    return rows.select("candidate_id", F.lit("recruiter_override").alias("source"), F.lit("human").alias("method"), F.lit(1 << 62).alias("ord"), *[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()])


def resolve(state: State, only: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Reported people, or those of `only`. A person's records are in the order of their ids, corrections last."""
    records, fixes = state.records, overrides(state.corrections)
    if only is not None:
        records, fixes = (joined(x, only, "candidate_id", "left_semi") for x in (records, fixes))
    order = F.row_number().over(Window.partitionBy("candidate_id").orderBy("record_id")).cast("long")
    rows = records.withColumn("ord", order).drop("record_id", "origin").unionByName(fixes, allowMissingColumns=True)
    learned = None if state.displaced.isEmpty() else calibration.weights(calibrated(state))
    people = trust.reported(resolved(gathered(normalized(rows, fuzzy), "candidate_id"), "candidate_id", learned), state.threshold)
    reviewed = state.reviewed.distinct().withColumn("_reviewed", F.lit(True))
    status = F.when(F.col("_reviewed"), "reviewed").when(F.col("needs_review"), "needs_review").otherwise("accepted")
    return joined(people, reviewed, "candidate_id", "left").withColumn("status", status).drop("_reviewed", "recs")


def _saved(state: State, touched: DataFrame) -> State:
    """The people that were touched resolved anew; others stay as they were, whatever their sources weigh now."""
    return _added(state, "people", "candidate_id", resolve(state, touched))


def reindex(state: State, threshold: float | None = None) -> State:
    state = replace(state, threshold=threshold if threshold is not None else state.threshold)
    return replace(state, parts=state.parts | {"people": Parts("candidate_id", (_put(state, resolve(state), "people"),))})


def winner_source(people: DataFrame, corrections: DataFrame) -> DataFrame:
    """(source): for each correction the source that had won the field, or the first that gave it values."""
    fields = {f: F.coalesce(F.get(F.filter(f"considered_{f}", lambda o: o["won"]), F.lit(0))["source"], F.get(F.col(f"considered_{f}"), F.lit(0))["source"]) for f in ("full_name", "headline", "years_experience")}
    fields |= {f: F.get(F.col(f"considered_{f}"), F.lit(0))["source"] for f in ("emails", "phones")}
    found = people.select("candidate_id", *[c.alias(f) for f, c in fields.items()]).unpivot("candidate_id", list(fields), "field", "source")
    return joined(corrections, found, ["candidate_id", "field"]).where("source is not null and source <> 'recruiter_override'").select("source")


def correct(state: State, corrections: DataFrame) -> State:
    """The state with corrections (candidate_id, field, value, seq): the latest of a field counts, and who was overruled loses weight everywhere."""
    overruled = written(winner_source(state.people, corrections), "overruled")
    new = replace(state, corrections=_put(state, state.corrections.unionByName(corrections.select(state.corrections.columns)), "corrections"), displaced=_put(state, state.displaced.unionByName(overruled), "displaced"))
    return _saved(new, corrections.select("candidate_id").distinct()) if overruled.isEmpty() else reindex(new)


def review(state: State, ids: DataFrame) -> State:
    """A person who was signed off stays so, whatever comes in."""
    return _saved(replace(state, reviewed=_put(state, state.reviewed.unionByName(ids.select("candidate_id")).distinct(), "reviewed")), ids.select("candidate_id").distinct())


def delete(state: State, ids: DataFrame) -> State:
    """Forgets people. What their sources lost in weight stays lost."""
    without = lambda df, name: _put(state, joined(df, ids, "candidate_id", "left_anti").select(df.columns), name)
    parts = {name: Parts(x.key, (without(x.whole(), name),)) for name, x in state.parts.items()}
    return replace(state, parts=parts, reviewed=without(state.reviewed, "reviewed"), corrections=without(state.corrections, "corrections"))


def calibrated(state: State) -> DataFrame:
    return calibration.report(state.spark, state.displaced, state.records)
