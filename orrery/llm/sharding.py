"""Shards of a growing corpus with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable shards, just as their partitions come.
Compaction looks at the shards of a version by size tier (powers of ``ratio``); where a
tier below the target has ``min_run`` shards, the shards of that tier are merged into
files of about the target size, without a shuffle: the scan packs small files into read
tasks of the target size and each task writes one file. Smaller tiers go first.

A version is a folder of the manifest: the shards it adds and removes, or, after a
compaction, all it holds, so that a version is read from the last such base on. It is
written aside and then renamed into place; a rename never replaces a version, so of two
writers one finds its version taken and commits again on top of the other's. Every folder
of data being written has a mark until it is committed, and vacuum() leaves marked
folders alone. Readers of older versions keep their shards until vacuum().

Only DataFrame operations touch rows; the driver handles file names, as it does for any
table it reads.

Edge cases: an empty arrival adds a version without shards; reading a version without
shards gives an empty table of the store's schema; null values, repeated rows and any
column names, ``_metadata`` included, are kept as they are; texts of any length stay in
their rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MANIFEST = "path string, bytes long, rows long, tier int, arrival int, added boolean"


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class TierRules:
    target_bytes: int = 32 << 20
    ratio: int = 4
    min_run: int = 4
    round_files: int = 20_000  # shards merged at once; more rounds follow

    def tier(self, size):
        """Column: 0 for shards of the target size or more, then one more for each factor of ``ratio`` below."""
        short = F.greatest(F.lit(self.target_bytes) / F.greatest(size, F.lit(1)), F.lit(1.0))
        return F.floor(F.log(short) / math.log(self.ratio) + 0.5).cast("int")


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, rules: TierRules | None = None):
        self.spark, self.path, self.schema, self.rules = spark, path.rstrip("/"), schema, rules or TierRules()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for folder in ("manifest", "data", "open"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))

    # versions

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.path}/manifest"))), default=0)

    def _place(self, version: int) -> str:
        return f"{self.path}/manifest/{version:08d}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version: path, bytes, rows, tier, arrival."""
        version = self.version() if version is None else version
        folders: list[str] = []
        for v in range(version, 0, -1):
            base = self._fs.exists(self._path(f"{self._place(v)}/base"))
            folders.append(f"{self._place(v)}/{'base' if base else 'delta'}")
            if base:
                break
        if not folders:
            return self.spark.createDataFrame([], MANIFEST).drop("added")
        entries = self.spark.read.schema(MANIFEST).parquet(*folders)
        live = entries.groupBy("path").agg(*[F.max(c).alias(c) for c in ("bytes", "rows", "tier", "arrival")], F.bool_and("added").alias("added"))
        return live.where("added").drop("added")

    def commit(self, entries: DataFrame, version: int, base: bool = False) -> int:
        """Makes ``entries``, added and removed shards or all of a ``base``, the given version, or raises VersionTaken."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(f"{aside}/{'base' if base else 'delta'}")
        try:
            self._files.rename(self._path(aside), self._path(self._place(version)), self._rename)
        except Exception as e:
            self._fs.delete(self._path(aside), True)
            if self._fs.exists(self._path(self._place(version))):
                raise VersionTaken(f"version {version}") from e
            raise
        return version

    def _on_top(self, attempt: Callable[[int], int]) -> int:
        """``attempt`` on the last version, again and again while others commit first."""
        while True:
            try:
                return attempt(self.version())
            except VersionTaken:
                continue

    # data

    def _begin(self) -> str:
        """A fresh folder of data, marked as being written."""
        name = uuid.uuid4().hex
        self._fs.create(self._path(f"{self.path}/open/{name}")).close()
        return name

    def _end(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/open/{name}"), False)

    def _data(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def described(self, folder: str, arrival: StructField | None = None) -> DataFrame:
        """Manifest entries of the shards under ``folder``."""
        fields = [f for f in self.schema.fields if f.name.lower() != "_metadata"]  # a column of that name hides the files'
        files = self.spark.read.schema(StructType([*fields, *([arrival] if arrival else [])])).parquet(folder)
        name = F.col(arrival.name) if arrival else F.lit(-1)
        own = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), name.cast("int").alias("arrival"))
        out = own.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"), F.max("arrival").alias("arrival"))
        return out.select("path", "bytes", "rows", self.rules.tier(F.col("bytes")).alias("tier"), "arrival", F.lit(True).alias("added"))

    def append(self, rows: DataFrame) -> int:
        """One arrival as small shards, one per partition of ``rows``."""
        name = self._begin()
        rows.write.parquet(self._data(name))
        entries = self.described(self._data(name))
        done = self._on_top(lambda at: self.commit(entries.withColumn("arrival", F.lit(at + 1)), at + 1))
        self._end(name)
        return done

    def append_all(self, rows: DataFrame, arrival) -> list[int]:
        """Many arrivals in one pass over ``rows``: shards by the value of ``arrival``, then a version for each.

        Versions are committed one after another in the order of the arrivals.
        """
        name = self._begin()
        mark = StructField(f"_arrival_{uuid.uuid4().hex[:8]}", IntegerType())
        rows.withColumn(mark.name, arrival.cast("int")).write.partitionBy(mark.name).parquet(self._data(name))
        by: dict[int, list] = {}
        for e in self.described(self._data(name), mark).collect():
            by.setdefault(e.arrival, []).append(e)
        done = []
        for a in sorted(by, key=lambda a: (a is None, a)):
            own = lambda at, es=by[a]: self.spark.createDataFrame([(e.path, e.bytes, e.rows, e.tier, at + 1, True) for e in es], MANIFEST)
            done.append(self._on_top(lambda at, own=own: self.commit(own(at), at + 1)))
        self._end(name)
        return done

    def plan(self, entries: DataFrame, skip: frozenset[int] = frozenset()) -> DataFrame | None:
        """The shards to merge: those of the tier of the smallest shards that is full and below the target."""
        full = entries.where("tier > 0").groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.rules.min_run)
        tiers = [r.tier for r in full.collect() if r.tier not in skip]
        return entries.where(F.col("tier") == max(tiers)).orderBy("path").limit(self.rules.round_files) if tiers else None

    def compact(self) -> int:
        """Merges similarly sized shards until no tier is full; returns the version reached."""
        skip: frozenset[int] = frozenset()
        while True:
            at = self.version()
            chosen = self.plan(self.manifest(at), skip)
            if chosen is None:
                return at
            merge = chosen.collect()
            own = self.spark.newSession()  # the size of read tasks is a setting of the session
            own.conf.set("spark.sql.files.maxPartitionBytes", str(self.rules.target_bytes))
            own.conf.set("spark.sql.files.openCostInBytes", "0")
            own.conf.set("spark.sql.files.minPartitionNum", "1")
            name = self._begin()
            own.read.schema(self.schema).parquet(*[e.path for e in merge]).write.parquet(self._data(name))
            made = self.described(self._data(name)).collect()
            if len(made) >= len(merge):  # no fewer files: nothing to gain in this tier
                self._fs.delete(self._path(self._data(name)), True)
                self._end(name)
                skip |= {merge[0].tier}
                continue
            self._on_top(lambda last, merge=merge, made=made: self._replace(last, merge, made))
            self._end(name)

    def _replace(self, last: int, merge: list, made: list) -> int:
        """A base on top of version ``last`` with ``made`` in the place of ``merge``; nothing if one of those has gone."""
        now = self.manifest(last)
        gone = self.spark.createDataFrame([(e.path,) for e in merge], "path string")
        if now.join(gone, "path", "left_semi").count() < len(merge):
            return last  # another writer has merged them; the copies stay unlisted until vacuum()
        kept = now.join(gone, "path", "left_anti").withColumn("added", F.lit(True))
        return self.commit(kept.unionByName(self.spark.createDataFrame([tuple(e) for e in made], MANIFEST)), last + 1, base=True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with _metadata of their shards."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def vacuum(self) -> int:
        """Deletes shards that the last version doesn't list and no writer is about to commit; returns how many.

        Files are listed first, then marks, then the version: a file that was there and has
        neither a mark nor a line in the manifest belongs to no one.
        """
        files, walk = [], self._fs.listFiles(self._path(f"{self.path}/data"), True)
        while walk.hasNext():
            files.append(walk.next().getPath())
        marked = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/open"))}
        held = {r.path.rpartition("/data/")[2] for r in self.manifest().select("path").collect()}
        gone = 0
        for p in files:
            own = p.toString().rpartition("/data/")[2]
            if own not in held and own.partition("/")[0] not in marked and p.getName().startswith("part-"):
                gone += bool(self._fs.delete(p, False))
        return gone
