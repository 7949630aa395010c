"""Tables of a folder under versions: readers see whole commits only.

Data are written to folders of their own and never changed.  A version is one
small manifest that names the folders of every table; it appears by an atomic
rename that fails if another writer took the number first.  A run that dies
before that leaves the snapshot before it, and a batch that is repeated is
recognised by its id.
"""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "_versions"


class Snapshots:
    """The versions of the tables under `root`, which any file system of Spark may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs.Path("/".join((self.root, *parts)))

    def new_folder(self) -> str:
        """Where the tables of one commit are written; nobody reads it before the commit."""
        return f"{self.root}/data/{uuid4().hex}"

    def versions(self) -> list[int]:
        log = self._path(_LOG)
        store = log.getFileSystem(self._conf)
        if not store.exists(log):
            return []
        names = [f.getPath().getName() for f in store.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """Tables of a version, the latest by default: name -> folders in order and the key of changes."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "batches": [], "tables": {}}
        if version not in known:
            raise ValueError(f"no version {version}")
        text = self.spark.read.text(f"{self.root}/{_LOG}/{version:012d}.json", wholetext=True).first().value
        return json.loads(text)

    def commit(self, replaced: dict[str, str] | None = None, appended: dict[str, str] | None = None, changed: dict[str, tuple[str, str]] | None = None, batch: str | None = None) -> int:
        """A new version, in which tables are replaced by, or grow by, the rows of written folders.

        `changed` names a folder and the key by which its rows take the place of
        earlier ones.  With a `batch` that a version already holds nothing
        happens.  The result is the version that holds the batch.  A writer that
        loses the race for a number tries again on top of the winner.
        """
        while True:
            before = self.manifest()
            if batch is not None and batch in before["batches"]:
                return before["version"]
            tables = {name: dict(entry) for name, entry in before["tables"].items()}
            for name, folder in (replaced or {}).items():
                tables[name] = {"folders": [folder], "key": None}
            for name, folder, key in [*((n, f, None) for n, f in (appended or {}).items()), *((n, f, k) for n, (f, k) in (changed or {}).items())]:
                old = tables.get(name, {"folders": [], "key": key})
                if old["key"] != key and old["folders"]:
                    if old["key"] is not None or key is None:
                        raise ValueError(f"{name} changes by {old['key']}, not by {key}")
                tables[name] = {"folders": [*old["folders"], folder], "key": key}
            version = before["version"] + 1
            batches = before["batches"] + ([batch] if batch is not None else [])
            if self._publish(version, {"version": version, "batches": batches, "tables": tables}):
                return version

    def _publish(self, version: int, manifest: dict) -> bool:
        target, draft = self._path(_LOG, f"{version:012d}.json"), self._path(_LOG, f".{uuid4().hex}")
        store = target.getFileSystem(self._conf)
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(target.toUri(), self._conf) if target.toUri().getScheme() else self._fs.FileContext.getFileContext(self._conf)
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
                raise
            store.delete(draft, False)
            return False
        return True

    def read(self, name: str, version: int | None = None, schema: str | None = None) -> DataFrame:
        """A table as of a version; of rows with one key, those of the last change."""
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            raise ValueError(f"no table {name}")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        if entry["key"] is None:
            return reader.parquet(*entry["folders"])
        rows = reduce(DataFrame.unionByName, [reader.parquet(folder).withColumn("_commit", F.lit(i)) for i, folder in enumerate(entry["folders"])])
        rest = [c for c in rows.columns if c not in (entry["key"], "_commit")]
        last = rows.groupBy(entry["key"]).agg(F.max_by(F.struct(*rest), "_commit").alias("_row"))
        return last.select(entry["key"], "_row.*")
