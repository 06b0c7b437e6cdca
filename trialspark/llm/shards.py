"""Sharding: size-tiered compaction of immutable Parquet shards under an atomically committed, versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Shard:
    """An immutable file: its rows and bytes, and the arrivals that its rows came with."""

    path: str
    rows: int
    bytes: int
    first: int
    last: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class CommitConflict(Exception):
    """Another writer has committed the version; read again and retry."""


def tier(size: int, least: int, fanout: int) -> int:
    """Shards of one tier are within a factor of fanout of each other; all under `least` bytes are of tier 0."""
    return 0 if size <= least else 1 + int(math.log(size / least, fanout))


def plan(shards: tuple[Shard, ...], target: int, least: int, fanout: int) -> list[list[Shard]]:
    """Runs to merge: neighbours by arrival within a tier, cut where a run reaches the target size.

    Shards of over half the target are done. A run is merged if it has `fanout` shards or fills a target file.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.first, s.last, s.path)):
        if s.bytes <= target // 2:
            tiers.setdefault(tier(s.bytes, least, fanout), []).append(s)
    found = []
    for own in tiers.values():
        run: list[Shard] = []
        for s in [*own, None]:
            if s is None or run and sum(x.bytes for x in run) + s.bytes > target:
                if len(run) >= fanout or len(run) > 1 and sum(x.bytes for x in run) > target // 2:
                    found.append(run)
                run = []
            if s is not None:
                run.append(s)
    return found


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class ShardStore:
    """A table as shards under `root`: data/ holds immutable files, manifests/ a JSON file for each version.

    Files are written first; a version is committed by renaming its manifest into place, which fails if the version is
    there. A job that dies leaves files that no manifest names, and readers never see them. A writer that comes second takes
    its change to the version it missed and tries again. Readers of an older version are safe until vacuum() is called,
    which drops what only older versions name.

    Columns come back as they were, whatever their names and nulls: the store's own columns (_arrival, _shard, _shard_rows)
    get more underscores where a column has their name. Repeated rows stay. An empty arrival is a version without new
    shards; reading a store without shards gives no rows (and an error where there is no version to tell the columns).
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, least: int = 1 << 20, fanout: int = 4, wave: int = 32, tries: int = 20):
        self.spark, self.root, self.target, self.least, self.fanout, self.wave, self.tries = spark, root.rstrip("/"), target, least, fanout, wave, tries
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the latest by default; version 0 is the empty store."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return Manifest(0, "", ())
        text = self.spark.read.text(f"{self.root}/manifests/v{version:010d}.json", wholetext=True).first()[0]
        told = json.loads(text)
        return Manifest(told["version"], told["schema"], tuple(Shard(**s) for s in told["shards"]))

    def commit(self, before: Manifest, shards: tuple[Shard, ...], schema: str) -> Manifest:
        """The next version after `before`, or CommitConflict; all of it is seen, or none."""
        after = Manifest(before.version + 1, schema, tuple(shards))
        final, draft = (f"{self.root}/manifests/v{after.version:010d}.json", f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps({"version": after.version, "schema": schema, "shards": [asdict(s) for s in after.shards]}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(draft), self._path(final), none)
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in str(e) or final.rpartition("/")[2] in {f"v{v:010d}.json" for v in self.versions()}:
                raise CommitConflict(final) from e
            raise
        return after

    def _exchange(self, gone: set[str], new: tuple[Shard, ...], schema: str) -> Manifest | None:
        """Commits the latest version without `gone` and with `new`; None if some of `gone` is no longer in it."""
        for _ in range(self.tries):
            now = self.manifest()
            if gone - {s.path for s in now.shards}:
                return None
            try:
                return self.commit(now, tuple(s for s in now.shards if s.path not in gone) + new, schema)
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.root}: {self.tries} times")

    def _write(self, df: DataFrame, by: str | None = None) -> list[Shard]:
        """df (its last column the arrival) as new files, one for each partition that has rows, and value of `by`."""
        at, arrival = f"{self.root}/data/{uuid.uuid4().hex}", df.columns[-1]
        if by:
            part = free_name("_part", df.columns)
            df.withColumn(part, F.col(f"`{by}`")).write.option("compression", "zstd").partitionBy(part).parquet(at)
        else:
            df.write.option("compression", "zstd").parquet(at)
        back = self.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(at)
        file = back.metadataColumn("_metadata")
        told = back.select(file["file_path"].alias("path"), file["file_size"].alias("bytes"), F.col(f"`{arrival}`").alias("arrival"))
        told = told.groupBy("path", "bytes").agg(F.count("*").alias("rows"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))
        return [Shard(r.path, r.rows, r.bytes, r.first, r.last) for r in told.collect()]

    def append(self, df: DataFrame, arrival: int) -> Manifest:
        """df's rows as new small shards, one for each partition, committed as one version."""
        tagged = df.withColumn(free_name("_arrival", df.columns), F.lit(arrival).cast("long"))
        return self._exchange(set(), tuple(self._write(tagged)), tagged.schema.json())

    def append_arrivals(self, df: DataFrame, arrival: Column) -> Manifest:
        """All rows of df by the arrival that the expression gives: each as its own small shards and its own version, from one pass."""
        name = free_name("_arrival", df.columns)
        tagged = df.withColumn(name, arrival.cast("long"))
        shards = self._write(tagged, name)
        now = self.manifest()
        for k in sorted({s.first for s in shards}):
            now = self._exchange(set(), tuple(s for s in shards if s.first == k), tagged.schema.json())
        return now

    def compact(self) -> Manifest:
        """Merges runs until no tier has one. A wave of runs is one job without a shuffle: each run's files are read in as
        many tasks as it will have files, and written; then a version swaps them. The merged files stay for readers of older
        versions until vacuum(). A wave whose shards another writer has merged meanwhile is planned anew."""
        now = self.manifest()
        while runs := plan(now.shards, self.target, self.least, self.fanout):
            for at in range(0, len(runs), self.wave):
                some = runs[at : at + self.wave]
                schema = self._schema(now)
                frames = [self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(max(1, math.ceil(sum(s.bytes for s in run) / self.target))) for run in some]
                new = tuple(self._write(reduce(DataFrame.unionByName, frames)))
                if self._exchange({s.path for run in some for s in run}, new, now.schema) is None:
                    self._delete({s.path for s in new})
                    break
            now = self.manifest()
        return now

    def _delete(self, paths: set[str]) -> None:
        for p in paths:
            self._fs.delete(self._path(p), False)

    def vacuum(self, keep: int = 2, orphans_after: float = 86_400) -> int:
        """Deletes manifests but the last `keep`, and the files that older manifests alone name; returns how many files.

        Files that no manifest names, which jobs that died have left, go when they are orphans_after seconds old.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        live = {s.path for v in kept for s in self.manifest(v).shards}
        dead = {s.path for v in old for s in self.manifest(v).shards} - live
        data, before = self._path(f"{self.root}/data"), (time.time() - orphans_after) * 1000
        found = self._fs.listFiles(data, True) if self._fs.exists(data) else None
        names = {p.rpartition("/data/")[2] for p in live | dead}
        while found is not None and found.hasNext():
            status = found.next()
            at = status.getPath().toString()
            if at.endswith(".parquet") and status.getModificationTime() < before and at.rpartition("/data/")[2] not in names:
                dead.add(at)
        self._delete(dead)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        return len(dead)

    def _schema(self, m: Manifest) -> StructType:
        return StructType.fromJson(json.loads(m.schema))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with _arrival, _shard (the rank of a row's file among the version's, by arrival) and _shard_rows."""
        m = self.manifest(version)
        order = sorted(m.shards, key=lambda s: (s.first, s.last, s.path))
        schema = self._schema(m)
        rows = self.spark.read.schema(schema).parquet(*[s.path for s in order]) if order else self.spark.createDataFrame([], schema)
        path, shard, n = (free_name(x, schema.names) for x in ("_path", "_shard", "_shard_rows"))
        told = self.spark.createDataFrame([(s.path, k, s.rows) for k, s in enumerate(order)], f"`{path}` string, `{shard}` int, `{n}` long")
        at = rows.metadataColumn("_metadata")["file_path"] if order else F.lit(None).cast("string")
        return rows.withColumn(path, at).join(F.broadcast(told) if len(order) <= 100_000 else told, path).drop(path)
