"""A stored table with one row per key that changes are merged into.

Keys are dealt out to a fixed number of buckets by their hash. A merge reads and rewrites only the buckets
that its changes touch, in a folder of its own; a small version file then lists the folder of every bucket
and takes effect as a whole when it is renamed into place. Readers see one version, a merge that fails leaves
the last one, and a merge whose label was committed before changes nothing, so a stream may repeat a batch.
Folders that no kept version lists are removed: the number of files stays bounded by the buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
KEEP_VERSIONS = 2  # readers of the version before the newest still find their files
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedStore:
    """``schema`` has the ``keys``; ``buckets`` should make a bucket fit a task and cannot change later."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bytes = jvm.org.apache.commons.io.IOUtils
        self.rewritten: list[int] = []

    # Versions

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _load(self, number: int) -> dict:
        stream = self._files.open(self._path(f"{self.path}/_versions/{number}.json"))
        try:
            return json.loads(self._bytes.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """``version``, ``label`` of the merge that made it and the folder of each bucket."""
        found = self._versions()
        return self._load(found[-1]) if found else {"version": 0, "label": None, "folders": {}}

    def _commit(self, state: dict) -> None:
        target = self._path(f"{self.path}/_versions/{state['version']}.json")
        draft = self._path(f"{self.path}/_versions/.{state['version']}.draft")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            raise RuntimeError(f"version {state['version']} of {self.path} was committed by another writer")

    def _clean(self) -> None:
        found = self._versions()
        kept = [self._load(v) for v in found[-KEEP_VERSIONS:]]
        for old in found[:-KEEP_VERSIONS]:
            self._files.delete(self._path(f"{self.path}/_versions/{old}.json"), False)
        used = {f for state in kept for f in state["folders"].values()}
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if not name.startswith("merge="):
                continue
            inside = [s.getPath() for s in self._files.listStatus(status.getPath()) if s.getPath().getName().startswith(f"{BUCKET}=")]
            live = [p for p in inside if f"{name}/{p.getName()}" in used]
            for p in inside:
                if p not in live:
                    self._files.delete(p, True)
            if not live:
                self._files.delete(status.getPath(), True)

    # Data

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self._rows(sorted(set(self.current()["folders"].values())))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Stored rows of the keys in ``wanted``, read from their buckets only."""
        state = self.current()
        touched = self._touched(wanted)
        stored = self._rows([f for b, f in state["folders"].items() if int(b) in touched])
        return stored.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, changes: DataFrame) -> set[int]:
        return {r[BUCKET] for r in self._placed(changes).select(BUCKET).distinct().collect()}

    def merge(self, changes: DataFrame, combine: Merge, label: str) -> bool:
        """Merge ``changes``; False where ``label`` is that of the last merge, which is not repeated.

        ``combine(stored, changes)`` gets the stored rows of the touched buckets and gives their new rows,
        with one row per key. Changes are read twice: give a stored table, or a cached one.
        """
        state = self.current()
        if state["label"] == label:
            return False
        touched = self._touched(changes)
        self.rewritten = sorted(touched)
        version = state["version"] + 1
        folders = dict(state["folders"])
        if touched:
            stored = self._rows([f for b, f in folders.items() if int(b) in touched])
            new = self._placed(combine(stored, changes).select(*self.schema.fieldNames()))
            folder = f"merge={version}"
            tasks = min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            new.repartition(tasks, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            for b in touched:
                at = f"{folder}/{BUCKET}={b}"
                if self._files.exists(self._path(f"{self.path}/{at}")):
                    folders[str(b)] = at
                else:
                    folders.pop(str(b), None)
        self._commit({"version": version, "label": label, "folders": folders})
        self._clean()
        return True


def upsert(keys: Sequence[str]) -> Merge:
    """Changed rows replace stored ones of the same key."""

    def combine(stored: DataFrame, changes: DataFrame) -> DataFrame:
        kept = stored.join(changes.select(*keys), list(keys), "left_anti")
        return kept.unionByName(changes.select(*kept.columns))

    return combine
