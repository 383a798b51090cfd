"""Sharding by size-tiered compaction.

Arrivals are appended as small shards that never change. Compaction takes runs of similar size (a tier) and merges
them into files of the target size, tier by tier, until no tier has enough runs. Either ends in a new version of the
manifest, a file that lists the live shards and appears by one atomic rename; readers see one whole version or
another. A job that dies before the rename leaves only files that no version lists, and ``vacuum`` deletes those.

A merge is one read of the tier's files and one write without a shuffle: neighbouring splits are joined into as many tasks as
files are wanted. The driver holds the list of files, as Spark itself does, and no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES, SHARD_ROWS = 128 << 20, 2_000
#: A tier: sizes from half of its mean to one and a half, and at least so many runs.
LOW, HIGH, RUNS = 0.5, 1.5, 4


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    bytes: int
    rows: int


def tiers(shards: list[Shard], target: int, runs: int = RUNS) -> list[list[Shard]]:
    """Runs of similar size that are to be merged, smallest first. Shards of the target size or more are done."""
    found: list[list[Shard]] = []
    mean = 0.0
    for shard in sorted((s for s in shards if s.bytes < target), key=lambda s: (s.bytes, s.path)):
        if found and LOW * mean <= shard.bytes <= HIGH * mean:
            found[-1].append(shard)
            mean += (shard.bytes - mean) / len(found[-1])
        else:
            found.append([shard])
            mean = float(shard.bytes)
    return [tier for tier in found if len(tier) >= runs]


class ShardStore:
    """A table of immutable shards below `root`, a path that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = SHARD_ROWS):
        self.spark, self.root, self.target, self.shard_rows = spark, root.rstrip("/"), target_bytes, shard_rows
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, at: str):
        return self._hadoop.Path(f"{self.root}/{at}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self._conf)

    # versions

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        fs, at = self._files, self._path("manifest")
        if not fs.exists(at):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return max((int(name[1:-5]) for name in names if name.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> tuple[StructType | None, list[Shard]]:
        version = self.version() if version is None else version
        if not version:
            return None, []
        stream = self._files.open(self._path(f"manifest/v{version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return StructType.fromJson(found["schema"]), [Shard(**x) for x in found["shards"]]

    def _commit(self, base: int, schema: StructType, shards: list[Shard]) -> bool:
        """Makes version base + 1, unless another writer has. Renaming to a name that exists fails."""
        fs, temporary = self._files, self._path(f"manifest/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(temporary.toUri() if ":" in self.root else fs.getUri(), self._conf)
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(self._path(f"manifest/v{base + 1:020d}.json")), options)
        except Exception as failed:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(failed):
                return False
            raise
        return True

    def _change(self, schema: StructType, gone: list[Shard], new: list[Shard]) -> int:
        while True:
            base = self.version()
            _, live = self.manifest(base)
            if any(s not in live for s in gone):
                raise RuntimeError("another compaction has merged these shards")
            taken = set(gone)
            if self._commit(base, schema, [s for s in live if s not in taken] + new):
                return base + 1

    # shards

    def _write(self, rows: DataFrame) -> list[Shard]:
        run = f"data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.shard_rows if rows is not None else 0).option("compression", "zstd").parquet(f"{self.root}/{run}")
        return self._listed(run, rows.schema)

    def _listed(self, run: str, schema: StructType) -> list[Shard]:
        files = self.spark.read.schema(schema).parquet(f"{self.root}/{run}")
        found = files.groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")).count().collect()
        return sorted((Shard(f"{run}/{x['name']}", x["bytes"], x["count"]) for x in found), key=lambda s: s.path)

    def append(self, rows: DataFrame) -> int:
        """Adds rows as small shards; returns the new version. No rows: no shards, but a version."""
        known, _ = self.manifest()
        if known is not None and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError("the rows have other columns than the table")
        return self._change(rows.schema, [], self._write(rows))

    def compact(self, runs: int = RUNS) -> int:
        """Merges tiers until none has enough runs; returns the last version."""
        while True:
            schema, live = self.manifest()
            if not (found := tiers(live, self.target, runs)):
                return self.version()
            merged = False
            for tier in found:
                wanted = max(1, round(sum(s.bytes for s in tier) / self.target))
                if wanted >= len(tier):
                    continue
                run = f"data/{uuid.uuid4().hex}"
                self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in tier]).coalesce(wanted).write.option("compression", "zstd").parquet(f"{self.root}/{run}")
                self._change(schema, tier, self._listed(run, schema))
                merged = True
            if not merged:
                return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that none of the `keep` latest versions lists; returns how many. No writer may be at work."""
        last = self.version()
        kept = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)[1]}
        fs, gone = self._files, 0
        for run in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            name = run.getPath().getName()
            for file in fs.listStatus(run.getPath()):
                if f"data/{name}/{file.getPath().getName()}" not in kept and file.getPath().getName().startswith("part-"):
                    fs.delete(file.getPath(), False)
                    gone += 1
        for v in range(1, last - keep + 1):
            fs.delete(self._path(f"manifest/v{v:020d}.json"), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("the store has no version")
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def shards(self, version: int | None = None) -> DataFrame:
        """shard_id, file, bytes and rows of each live shard of a version: a row for each file of about the target size."""
        _, found = self.manifest(version)
        return self.spark.createDataFrame([(i, s.path.rsplit("/", 1)[1], s.bytes, s.rows) for i, s in enumerate(sorted(found, key=lambda s: s.path))], "shard_id long, file string, bytes long, rows long")


def resharded(docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Appends `docs` to a new store at `root`, compacts it and gives its rows back: doc_id, n_chars, text_sha256, shard_id, shard_rows.

    All columns are stored as they are, so nulls, repeated rows and clashing names keep their values. n_chars and the hash are
    of the stored text; of a null text they are null. An empty table gives no rows.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, shard_rows)
    store.append(docs)
    store.compact()
    store.vacuum()
    rows = store.read()
    named = rows.select(rows["doc_id"].cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.col("_metadata.file_name").alias("file")) if store.manifest()[1] else rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.lit("").alias("file"))
    return named.join(F.broadcast(store.shards()), "file").select("doc_id", "n_chars", "text_sha256", "shard_id", F.col("rows").alias("shard_rows"))
