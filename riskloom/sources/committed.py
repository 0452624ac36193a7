"""A build of tables that is committed as a whole, reused where its inputs are unchanged, and bucketed for its joins.

Layout of a build folder::

    tables/<name>-<uuid>/          Parquet, one file for each bucket of the table's key
    manifests/<number>.json        the committed builds; the largest number is the current one

A table is written to a folder of its own, which nothing names until all tables are there; then the next manifest
is written under a hidden name and renamed into place. That rename is the commit: a job that dies before it leaves
the last build as it was, and one that dies after it has finished. Two jobs that commit at once get an error in
the one that finds its number taken; its tables stay unnamed. ``vacuum`` deletes what no kept manifest names.

A table's fingerprint covers the fingerprints of its inputs (size and time of each file, read and summed by Spark) and
its definition. Where the current build holds a table of the same name and fingerprint, it is taken over unread.

The shuffle files of a table go when it is written. Tables of one build share the number of buckets, so those with the same key join without an exchange. Empty
tables are written like others. Null keys share one bucket, so a key should not be null in many rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import ChainMap
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks


@dataclass(frozen=True)
class Table:
    """``make(inputs)`` gets the DataFrames of ``inputs``: sources, or tables that stand before this one."""

    name: str
    key: str
    inputs: Sequence[str]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]
    definition: str = ""  # what else decides the content: feature lists, a version of the code


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of all files below ``paths``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    row = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    total = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(row).alias("files")).first()
    return _digest(total["n"], total["bytes"], total["files"])


def _digest(*parts) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


class Build:
    """The build kept in ``folder``. ``with Build(...)`` drops the session's names of its tables at the end."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._names: dict[str, str] = {}

    def __enter__(self) -> Build:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Drop the catalog's names; the files stay."""
        while self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.popitem()[1]}")

    def exists(self) -> bool:
        return bool(self.numbers())

    # ------------------------------------------------------------ manifests
    def _path(self, relative: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{relative}" if relative else self.folder)

    def _children(self, relative: str) -> list[str]:
        path = self._path(relative)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._children("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """The current build, or an earlier one; empty before the first commit."""
        if number is None:
            number = max(self.numbers(), default=0)
            if not number:
                return {"number": 0, "buckets": None, "tables": {}}
        stream = self._fs.open(self._path(f"manifests/{number:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        target = self._path(f"manifests/{manifest['number']:08d}.json")
        hidden = self._path(f"manifests/_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(hidden, target):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"{self.folder}: another job committed build {manifest['number']} first")

    # ------------------------------------------------------------ tables
    def run(self, tables: Sequence[Table], sources: Mapping[str, DataFrame], fingerprints: Mapping[str, str],
            buckets: int | None = None) -> list[str]:
        """Bring the build up to date with ``sources``; the names of the tables that had to be computed.

        ``buckets`` is that of the current build unless given, and the session's shuffle partitions for the first one;
        another number writes all tables again.
        """
        old = self.manifest()
        buckets = buckets or old["buckets"] or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        prints, entries, made = dict(fingerprints), {}, []
        frames = ChainMap({}, sources)  # a source is asked for only by a table that is computed
        for t in tables:
            prints[t.name] = _digest(t.name, t.key, buckets, t.definition, *[prints[i] for i in t.inputs])
            entry = old["tables"].get(t.name)
            if entry is None or entry["fingerprint"] != prints[t.name]:
                entry = self._write(t, t.make({i: frames[i] for i in t.inputs}), prints[t.name], buckets)
                made.append(t.name)
            entries[t.name] = entry
            frames[t.name] = self._open(entry)
        if made or set(entries) != set(old["tables"]):
            self._commit({"number": old["number"] + 1, "buckets": buckets, "tables": entries})
        return made

    def _write(self, t: Table, df: DataFrame, print_: str, buckets: int) -> dict:
        folder = f"tables/{t.name}-{uuid.uuid4().hex}"
        name = f"riskloom_write_{uuid.uuid4().hex}"
        try:
            # rows meet in the task of their bucket first: one file for each bucket, not one for each task and bucket
            with sinks.shuffles_freed(self.spark):
                df.repartition(buckets, t.key).write.format("parquet").bucketBy(buckets, t.key) \
                    .option("path", f"{self.folder}/{folder}").saveAsTable(name)
            columns = self.spark.table(name)._jdf.schema().toDDL()  # quotes the names of nested fields too
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files of a table with a path stay
        return {"folder": folder, "fingerprint": print_, "key": t.key, "buckets": buckets, "columns": columns}

    def _open(self, entry: dict) -> DataFrame:
        """The table under a name of this session that knows its buckets."""
        folder = entry["folder"]
        if folder not in self._names:
            name = f"riskloom_built_{uuid.uuid4().hex}"
            key = "`" + entry["key"].replace("`", "``") + "`"
            place = f"{self.folder}/{folder}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({entry['columns']}) USING parquet CLUSTERED BY ({key}) "
                           f"INTO {entry['buckets']} BUCKETS LOCATION '{place}'")
            self._names[folder] = name
        return self.spark.table(self._names[folder])

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """A committed table."""
        tables = self.manifest(number)["tables"]
        if name not in tables:
            raise KeyError(f"{self.folder} holds no committed table {name}; it has {sorted(tables)}")
        return self._open(tables[name])

    def path(self, name: str) -> str:
        return f"{self.folder}/{self.manifest()['tables'][name]['folder']}"

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` manifests and every table folder they do not name.

        Not while a job builds in the same folder: its tables are not named yet.
        """
        if keep < 1:
            raise ValueError("the current build cannot be deleted")
        kept = self.numbers()[-keep:]
        named = {e["folder"].split("/")[1] for n in kept for e in self.manifest(n)["tables"].values()}
        for n in self._children("manifests"):
            if n not in {f"{k:08d}.json" for k in kept}:
                self._fs.delete(self._path(f"manifests/{n}"), False)
        gone = sorted(f for f in self._children("tables") if f not in named)
        for f in gone:
            self._fs.delete(self._path(f"tables/{f}"), True)
        return gone
