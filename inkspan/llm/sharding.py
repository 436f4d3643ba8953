"""Size-tiered compaction of immutable shards under versioned manifests, by DataFrame reads and writes alone.

A store is a folder: shards/ holds immutable Parquet files, manifests/ a JSON file for each version that lists the shards
of that version. A version exists once its manifest has its name, which one writer alone can give it; the others apply
their change to the version that was first. Shards that no manifest lists are not part of the store. All file access goes
through Hadoop's file systems. A store on one that cannot rename without overwriting (some object stores) needs one writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, text_or_empty

#: Bytes of a full shard, how many shards of a tier are merged at least, the ratio of neighbouring tiers, the least tier's bytes.
TARGET_BYTES, RUN, RATIO, LEAST_BYTES = 128 << 20, 4, 4, 1 << 20
#: Versions whose shards stay when a store is tidied.
KEEP_VERSIONS = 2
#: Shards that no version has ever listed are deleted at this age: a writer may yet commit younger ones.
ORPHAN_SECONDS = 24 * 3600
#: How often a change that another writer was faster than is applied again.
TRIES = 50
#: Arrivals that the query appends.
ARRIVALS = 8


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Appends, compactions and reads of one store. Numbers of files, not of rows, pass through the driver."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, run: int = RUN):
        self.spark, self.path, self.target, self.run = spark, path.rstrip("/"), target_bytes, run
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        return sorted(int(f.getPath().getName()[1:9]) for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("v")) if self._fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        """The latest, or the asked-for, version: its number and its shards (file, bytes, tier)."""
        known = self.versions()
        if not known:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"manifests/v{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, aside, place) -> bool:
        """Give a finished file its name, unless the name is taken: a step that one writer alone can take."""
        try:
            if self._fs.getScheme() == "file":
                paths = [self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri()) for p in (place, aside)]
                self._jvm.java.nio.file.Files.createLink(*paths)
            else:
                self._rename(aside, place)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        return True

    def _rename(self, aside, place) -> None:
        """Rename without overwriting."""
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(aside, place, options)

    def _put(self, path, manifest: dict) -> None:
        stream = self._fs.create(path, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def commit(self, before: dict, shards: list[dict]) -> dict:
        """Publish the version after ``before``: write its manifest aside, then name it, which only one writer can."""
        now = {"version": before["version"] + 1, "shards": sorted(shards, key=lambda s: s["file"])}
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        self._put(aside, now)
        try:
            if not self._publish(aside, self._path(f"manifests/v{now['version']:08d}.json")):
                raise ConcurrentCommit(f"version {now['version']} exists")
        finally:
            self._fs.delete(aside, False)
        return now

    def update(self, change: Callable[[list[dict]], list[dict] | None]) -> dict:
        """Commit ``change`` of the latest version's shards, again if another writer was first; None changes nothing."""
        for _ in range(TRIES):
            before = self.manifest()
            shards = change(before["shards"])
            if shards is None:
                return before
            try:
                return self.commit(before, shards)
            except ConcurrentCommit:
                continue
        raise ConcurrentCommit(f"{TRIES} other writers were faster")

    def tier(self, size: int) -> int:
        """0 for the smallest shards, one more for each RATIO times the size."""
        tier = 0
        while size >= LEAST_BYTES * RATIO**tier:
            tier += 1
        return tier

    def _written(self, df: DataFrame) -> list[dict]:
        """Write rows as new shards and tell their files. A job that fails leaves files that no manifest lists."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._files(folder)

    def _files(self, folder: str) -> list[dict]:
        """Shards under a folder: their files, bytes, tiers and times."""
        out, listed = [], self._fs.listFiles(self._path(folder), True)
        while listed.hasNext():
            f = listed.next()
            path = f.getPath().toString()
            if path.endswith(".parquet"):
                out.append({"file": path[path.rindex(f"/{folder}/") + 1 :], "bytes": f.getLen(), "tier": self.tier(f.getLen()), "written": f.getModificationTime()})
        return out

    def append(self, arrival: DataFrame) -> dict:
        new = self._written(arrival)
        return self.update(lambda shards: shards + new)

    def dealt(self, docs: DataFrame, arrivals: int) -> list[list[dict]]:
        """Write ``docs``, read once, as the shards of several arrivals, none of them committed yet. Rows are dealt by a hash
        of all they hold, so that no source is an arrival of its own."""
        folder, arrival = f"shards/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        key = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(arrivals))
        docs.withColumn(arrival, key).write.option("compression", "zstd").partitionBy(arrival).parquet(f"{self.path}/{folder}")
        dealt: list[list[dict]] = [[] for _ in range(arrivals)]
        for f in self._files(folder):
            dealt[int(f["file"].split("/")[2].rpartition("=")[2])].append(f)
        return dealt

    def runs(self, shards: list[dict], run: int | None = None) -> list[list[dict]]:
        """Runs to merge: the shards of each tier below the target, if there are ``run`` of them."""
        tiers: dict[int, list[dict]] = defaultdict(list)
        for s in shards:
            if s["bytes"] < self.target:
                tiers[s["tier"]].append(s)
        return [sorted(held, key=lambda s: s["file"]) for _, held in sorted(tiers.items()) if len(held) >= (run or self.run)]

    def compact(self, run: int | None = None) -> dict:
        """Merge runs of similar size into target-sized shards until no tier has a run; each round is one version.

        Rows stay in their files' order and are not shuffled: a merging task reads whole shards, about a target's bytes of them.
        """
        now = self.manifest()
        while runs := [r for r in self.runs(now["shards"], run) if self._files_of(r) < len(r)]:
            merged = [m for held in runs for m in self._written(self.read_shards(held).coalesce(self._files_of(held)))]
            gone = {s["file"] for held in runs for s in held}

            def swapped(shards: list[dict], gone=gone, merged=merged) -> list[dict] | None:
                """None if another writer has merged some of them meanwhile: what is merged here then stays unlisted."""
                left = [s for s in shards if s["file"] not in gone]
                return left + merged if len(left) == len(shards) - len(gone) else None

            now = self.update(swapped)
        return now

    def _files_of(self, shards: list[dict]) -> int:
        return -(-sum(s["bytes"] for s in shards) // self.target)

    def read_shards(self, shards: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found.get("emptied"):
            raise LookupError(f"the shards of version {found['version']} have been deleted")
        return self.read_shards(found["shards"])

    def vacuum(self, keep: int = 1, orphan_seconds: float = ORPHAN_SECONDS) -> int:
        """Delete what versions before the last ``keep`` listed and these do not: readers of older versions must have ended.

        Shards that no version has listed may be a writer's that has yet to commit, and go only at ``orphan_seconds`` of age.
        Manifests of versions that can be read no more are emptied, and keep their names, which no writer can then take.
        """
        known = self.versions()
        live = {s["file"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        old = {v: self.manifest(v) for v in known[:-keep]}
        dead = {s["file"] for m in old.values() for s in m["shards"]} - live
        dead |= {f["file"] for f in self._files("shards") if f["file"] not in live and f["written"] < (time.time() - orphan_seconds) * 1000}
        gone = sum(self._fs.delete(self._path(file), False) for file in dead)
        for v, m in old.items():
            if m["shards"]:
                self._put(self._path(f"manifests/v{v:08d}.json"), {"version": v, "shards": [], "emptied": True})
        return gone


def shard(docs: DataFrame, path: str, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append ``docs`` to a store in ``arrivals`` parts, compact it, and read the committed version back, with each row's shard.

    The source is read once. All columns are kept, nulls, very long texts and repeated rows too; a column named shard is
    replaced. No rows give no rows.
    """
    store = ShardStore(docs.sparkSession, path, target_bytes)
    docs = docs.drop("shard")
    for new in store.dealt(docs, arrivals):
        store.update(lambda shards, new=new: shards + new)
        store.compact()
        store.vacuum(KEEP_VERSIONS)
    held = store.manifest()["shards"]
    rows = store.read_shards(held) if held else docs.limit(0)
    return rows.withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, a digest of the text and the source of each document, as read back from the compacted store."""
    held = shard(table(spark, sf_dir, "documents"), scratch(spark, "op5-shards"))
    return held.select("doc_id", "source", F.length(text_or_empty()).cast("long").alias("n_chars"), F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"))
