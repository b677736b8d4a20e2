"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

An arrival is appended as small shards. When a tier of similar sizes holds enough of them, they are merged into
larger ones, up to a target size. A change becomes visible with its manifest version, which is created in one step
and never replaced, so a reader sees one version whole, and of two writers one fails.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ShardStore:
    """Shards and manifests below one folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan: int = 4, smallest: int = 1 << 16, keep_versions: int = 2):
        self.spark, self.path, self.target, self.fan, self.smallest, self.keep = spark, path.rstrip("/"), target_bytes, fan, smallest, keep_versions

    # --- manifest -------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The shards of a version (the last one by default): path, bytes, rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/v{version:08d}.json", wholetext=True).first()[0])

    def commit(self, base: int, shards: list[dict], schema: str) -> int:
        """Publish the version after ``base``; fails if another writer did so first."""
        version = base + 1
        fs, draft = self._fs(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest/v{version:08d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception:
            fs.delete(draft, False)
            raise
        return version

    # --- shards ---------------------------------------------------------------------------------

    def _written(self, folder: str, schema: str) -> list[dict]:
        rows = self.spark.read.schema(schema).parquet(folder).groupBy("_metadata.file_path", "_metadata.file_size").count().collect()
        return [{"path": r.file_path, "bytes": r.file_size, "rows": r["count"]} for r in rows]

    def append(self, df: DataFrame, rows_per_shard: int = 20_000) -> int:
        """Write an arrival as new shards and publish them.

        The first arrival gives the store its columns; a later one must have them, and its other columns are an error
        rather than lost. Rows are kept as they are: nulls, repeated rows and texts of any length. An arrival without
        rows publishes a version without new shards.
        """
        now = self.manifest()
        schema = now["schema"] or df.schema.json()
        ddl = self._ddl(schema)
        if extra := set(df.columns) - {f.name for f in ddl.fields}:
            raise ValueError(f"the store has no columns {sorted(extra)}")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.select(*[f.name for f in ddl.fields]).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        return self._publish(folder, now["version"], lambda made: now["shards"] + made, ddl, schema)

    def _publish(self, folder: str, base: int, shards, ddl, schema: str) -> int:
        """Commit what was written to ``folder``; if another writer was first, the folder goes again."""
        try:
            return self.commit(base, shards(self._written(folder, ddl)), schema)
        except Exception:
            fs, p = self._fs(folder)
            fs.delete(p, True)
            raise

    @staticmethod
    def _ddl(schema: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(schema))

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.smallest, self.fan))) if size > self.smallest else 0

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: of each tier below the target with ``fan`` shards or more, in order of size, up to the target."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        groups = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fan:
                continue
            group, size = [], 0
            for s in sorted(members, key=lambda s: (s["bytes"], s["path"])):
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group, size = [*group, s], size + s["bytes"]
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, groups_per_job: int = 64) -> int:
        """Merge until no tier is full; each merged shard is one task's work, bounded by the target size. Returns the version."""
        while groups := self.plan((now := self.manifest())["shards"])[:groups_per_job]:
            ddl = self._ddl(now["schema"])
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            parts = [self.spark.read.schema(ddl).parquet(*[s["path"] for s in g]).coalesce(1) for g in groups]
            reduce(DataFrame.union, parts).write.option("compression", "zstd").parquet(folder)
            gone = {s["path"] for g in groups for s in g}
            self._publish(folder, now["version"], lambda made: [s for s in now["shards"] if s["path"] not in gone] + made, ddl, now["schema"])  # noqa: B023
            self.expire()
        return self.manifest()["version"]

    def expire(self) -> None:
        """Delete versions before the last ``keep_versions`` and the shards that only they name.

        A reader of the version before a compaction so keeps its files until the next one.
        """
        versions = self.versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        needed = {s["path"] for v in kept for s in self.manifest(v)["shards"]}
        for path in {s["path"] for v in old for s in self.manifest(v)["shards"]} - needed | {f"{self.path}/manifest/v{v:08d}.json" for v in old}:
            fs, p = self._fs(path)
            fs.delete(p, False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``shard`` (its number in the manifest's order of paths), which takes the place of a column of that name. No rows: an empty table."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing has been appended to the store, so it has no schema")
        if not now["shards"]:
            return self.spark.createDataFrame([], self._ddl(now["schema"])).withColumn("shard", F.lit(None).cast("long"))
        paths = sorted(s["path"] for s in now["shards"])
        df = self.spark.read.schema(self._ddl(now["schema"])).parquet(*paths)
        numbers = self.spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "_shard_path string, shard long")
        if len(paths) <= 10_000:  # a few MB; beyond that the join shuffles
            numbers = F.broadcast(numbers)
        return df.withColumn("_shard_path", F.col("_metadata.file_path")).drop("shard").join(numbers, "_shard_path").drop("_shard_path")


def arrive_and_compact(docs: DataFrame, path: str, arrivals: int = 4, target_bytes: int = 64 << 20, rows_per_shard: int = 20_000) -> ShardStore:
    """Append ``docs`` in ``arrivals`` by a hash of ``doc_id`` (null ids too), compacting after each. An empty table is stored as such."""
    store = ShardStore(docs.sparkSession, path, target_bytes)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(turn == i), rows_per_shard)
        store.compact()
    return store
