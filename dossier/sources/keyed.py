"""A table kept by document on shared files: replaced copy-on-write, committed by a numbered manifest, read at any version."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, one of our own where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="dossier-shared-"))
    return sc.getCheckpointDir()


class Files:
    """The few file operations that Spark's readers and writers lack, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._root.getFileSystem(self._conf)
        self._rename = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file that must not exist yet; False if it does. It appears at once or not at all."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self.path(name), self._rename)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class Conflict(RuntimeError):
    """Other commits came first at every attempt."""


class KeyedTable:
    """Rows under a path, of which whole documents (the values of one key column) are replaced at a time.

    Data files are dealt to buckets by a hash of the key and never change. A version is a manifest, log/<number>.json,
    of the files that make it up; committing one is creating that file, which only one of several writers can. So a
    reader sees a whole version, an interrupted write leaves files that no manifest names, and old versions can be read until `vacuum`.

    A change reads the key column of the touched buckets' files, rewrites the files that hold a document at hand, and
    takes the others over as they are. Lists of file names and buckets are all that the driver holds. Large buckets are
    split over tasks and files (`rows_per_file`), so a document that holds most rows is the work of many.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, *, buckets: int = 64, rows_per_file: int = 1_000_000) -> None:
        self.spark, self.root, self.key, self.buckets, self.rows_per_file = spark, path.rstrip("/"), key, buckets, rows_per_file
        self._files = Files(spark, self.root)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._files.names("log") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, the last one if none is named: its number, schema, number of buckets, and [file, bucket] of its files."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "buckets": self.buckets, "files": []}
        return json.loads(self._files.read(f"log/{version:020d}.json"))

    def _rows(self, manifest: dict, files: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"nothing was committed under {self.root}")
        return self._rows(manifest, [f for f, _ in manifest["files"]])

    def replace(self, rows: DataFrame, documents: DataFrame | None = None) -> int:
        """Put rows in place of all rows of their documents, and of `documents` (the key column) that have no rows now."""
        own = rows.select(self.key)
        return self.change(own if documents is None else own.unionByName(documents.select(self.key)), lambda old: rows, rows.schema)

    def delete(self, documents: DataFrame) -> int:
        """Drop all rows of documents (the key column)."""
        return self.change(documents.select(self.key), lambda old: old.limit(0), None)

    def patch(self, rows: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> int:
        """Replace the documents of rows by merge(their old rows, rows, keys)."""
        return self.change(rows.select(self.key), lambda old: merge(old, rows, keys), rows.schema)

    def change(self, documents: DataFrame, build: Callable[[DataFrame], DataFrame], schema: T.StructType | None, *, attempts: int = 5) -> int:
        """Put build(old rows of documents) in their place and return the new version. A null key is a document too.

        If another commit comes first, the change starts over from that one's version.
        """
        keys = documents.distinct().persist()
        try:
            for _ in range(attempts):
                base = self.manifest()
                if base["schema"] is None and schema is None:
                    raise ValueError(f"nothing was committed under {self.root}")
                base = base | {"schema": base["schema"] or schema.json()}
                added, touched = self._write(base, keys, build)
                left = [f for f in base["files"] if f[0] not in touched]
                if self._commit(base | {"version": base["version"] + 1, "files": left + added}):
                    return base["version"] + 1
            raise Conflict(f"{attempts} attempts at a commit under {self.root}")
        finally:
            keys.unpersist()

    def _commit(self, manifest: dict) -> bool:
        return self._files.create(f"log/{manifest['version']:020d}.json", json.dumps(manifest))

    def _write(self, base: dict, keys: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[list[list], set[str]]:
        """New files in place of those that hold a row of keys, and the names of these."""
        same = lambda rows: rows[self.key].eqNullSafe(keys[self.key])
        bucket = F.pmod(F.xxhash64(self.key), F.lit(base["buckets"])).cast("int")
        wanted = {r[0] for r in keys.select(bucket).distinct().collect()}  # `buckets` at most
        near = [f for f, b in base["files"] if b in wanted]
        named = self._rows(base, near).select(self.key, F.input_file_name().alias("file"))
        last = lambda path: tuple(path.rsplit("/", 3)[-3:])  # noqa: E731  the write's folder, the bucket and the file: a task gives its files of all buckets one name
        names = {last(f): f for f in near}
        touched = {names[last(r[0])] for r in named.join(keys, same(named), "left_semi").select("file").distinct().collect()}
        old = self._rows(base, sorted(touched))
        order = old.columns
        new = build(old.join(keys, same(old), "left_semi")).select(*order)
        out = old.join(keys, same(old), "left_anti").unionByName(new).withColumn("_bucket", bucket)
        folder = f"data/{uuid.uuid4().hex}"
        out.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key).write.option("maxRecordsPerFile", self.rows_per_file).partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        parts = [n for n in self._files.names(folder) if n.startswith("_bucket=")]
        return [[f"{folder}/{p}/{f}", int(p.removeprefix("_bucket="))] for p in parts for f in self._files.names(f"{folder}/{p}") if f.endswith(".parquet")], touched

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all but the last `keep` versions and delete the files that none of these names, those of interrupted writes too.

        Only for times without writers, whose files no manifest names yet. Returns the folders that went.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            self._files.delete(f"log/{v:020d}.json")
        live = {f for v in versions[-keep:] for f, _ in self.manifest(v)["files"]}
        gone = []
        for folder in self._files.names("data"):
            own = [f"data/{folder}/{p}/{f}" for p in self._files.names(f"data/{folder}") if p.startswith("_bucket=") for f in self._files.names(f"data/{folder}/{p}") if f.endswith(".parquet")]
            if not live.intersection(own):
                self._files.delete(f"data/{folder}")
                gone.append(folder)
            else:
                for f in set(own) - live:
                    self._files.delete(f)
        return gone
