"""Maps on disk: versions of Parquet tables below one folder on any Hadoop path, and import of SQLite maps.

A map's folder has a folder for each version, and a manifest for each commit, numbered from 1. A writer makes a version's tables and
search indexes first and then commits them by the next manifest, which only one writer can make. A reader takes the latest manifest once, so that
all its tables are of one version, whatever is committed meanwhile; old versions go when collect_versions() is called.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import postings, search
from ..operators.storage import located
from ..schema import CORE, SCHEMA_VERSION, TABLES, aligned, empty
from ..testmap import TestMap
from . import sqlite

#: Marks a map as older writers left it: tables right below its folder.
VERSION_FILE = "_schema_version"
MANIFESTS, VERSIONS = "_manifests", "versions"
#: Seconds for which collect_versions() leaves a version that was replaced, as readers may still have it.
KEPT_SECONDS = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed since the writer began; its version stays."""


class Folder:
    """Small files below a Hadoop path, by Spark's own file systems."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.root = located(path, self.spark).rstrip("/") or "/"
        self._jvm, self._conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def fs(self):
        return self.path().getFileSystem(self._conf)

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.has(name) else []

    def changed(self, name: str) -> float:
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, made: str, name: str) -> bool:
        """Gives the file `made` its name, whole, unless there is a file of that name: then False."""
        if self.fs.getUri().getScheme() == "file":  # a local rename would replace a file; a link doesn't
            local = lambda n: self.path(n).toUri().getPath()
            try:
                os.link(local(made), local(name))
            except FileExistsError:
                return False
            finally:
                self.drop(made)
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(self.path(made), self.path(name), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self.drop(made)
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))


def _commits(at: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in at.names(MANIFESTS) if n.endswith(".json") and n[:-5].isdigit())


def _manifest(number: int) -> str:
    return f"{MANIFESTS}/{number:08d}.json"


def current(path: str, spark: SparkSession | None = None) -> int:
    """Number of the latest commit, 0 without one; what save() takes as `base`."""
    return max(_commits(Folder(path, spark)), default=0)


def save(m: TestMap, path: str, base: int | None = None) -> int:
    """Writes a version and commits it; the commit's number.

    base: the commit on which the map builds, by default the latest as writing begins. Conflict is raised if there is a later one by the time of
    the commit; then, and if anything fails before, the map stays as it was.
    """
    spark = m.meta.sparkSession
    at = Folder(path, spark)
    base = current(path, spark) if base is None else base
    version = f"{VERSIONS}/{uuid.uuid4().hex}"
    try:
        for name, df in m.tables().items():
            aligned(df, name).write.parquet(f"{at.root}/{version}/{name}")
        written = TestMap(**{t: spark.read.schema(TABLES[t]).parquet(f"{at.root}/{version}/{t}") for t in TABLES})
        for name, (make, columns) in search.INDEXES.items():
            postings.write_index(make(written), "id", columns, f"{at.root}/{version}/{search.FOLDER}/{name}")
        at.make(MANIFESTS)
        made = f"{MANIFESTS}/.{uuid.uuid4().hex}"
        at.write(made, json.dumps({"schema_version": SCHEMA_VERSION, "version": version, "tables": list(TABLES), "indexes": list(search.INDEXES)}))
        if current(path, spark) != base or not at.publish(made, _manifest(base + 1)):
            at.drop(made)
            raise Conflict(f"{path}: another writer has committed since commit {base}")
    except BaseException:
        at.drop(version)
        raise
    return base + 1


def collect_versions(path: str, spark: SparkSession | None = None, kept_seconds: float = KEPT_SECONDS) -> int:
    """Removes versions that the latest manifest doesn't name and that are older than kept_seconds; how many.

    Versions of writers that are still at work are younger than that. All manifests stay but those whose version goes.
    """
    at = Folder(path, spark)
    commits = _commits(at)
    named = {k: json.loads(at.read(_manifest(k)))["version"] for k in commits}
    kept = {named[commits[-1]]} if commits else set()
    old = [f"{VERSIONS}/{n}" for n in at.names(VERSIONS) if f"{VERSIONS}/{n}" not in kept and at.changed(f"{VERSIONS}/{n}") < time.time() - kept_seconds]
    for version in old:
        for k in commits[:-1]:
            if named[k] == version:
                at.drop(_manifest(k))
        at.drop(version)
    return len(old)


def _pinned(path: str, spark: SparkSession | None = None, commit: int | None = None) -> tuple[str, int, dict]:
    """(folder of tables, schema version, manifest) of a commit, by default the latest; a map of an older writer is its own folder."""
    at = Folder(path, spark)
    commits = _commits(at)
    if commit is not None and commit not in commits:
        raise ValueError(f"{path}: no commit {commit}")
    if commits:
        known = json.loads(at.read(_manifest(commit or commits[-1])))
        return f"{at.root}/{known['version']}", known["schema_version"], known
    return at.root, int(at.read(VERSION_FILE)) if at.has(VERSION_FILE) else 0, {}


def validate(path: str, spark: SparkSession | None = None) -> tuple[int, str]:
    """(schema version, '') of a map, or (0, what is wrong)."""
    root, version, _ = _pinned(path, spark)
    missing = [t for t in CORE if not Folder(root, spark).has(t)]
    if missing:
        return 0, f"not a map: no table {', '.join(missing)}"
    return (version, "") if version else (0, "not a map: no schema version")


def load(spark: SparkSession, path: str, commit: int | None = None) -> TestMap:
    """A map as of its latest commit, or of one that is named; tables and nullable columns that an older version lacks are empty."""
    root, version, known = _pinned(path, spark, commit)
    there = {t for t in TABLES if Folder(root, spark).has(t)}
    if (missing := [t for t in CORE if t not in there]) or not version:
        raise ValueError(f"{path}: not a map: no " + (f"table {', '.join(missing)}" if missing else "schema version"))
    m = TestMap(**{t: aligned(spark.read.parquet(f"{root}/{t}"), t) if t in there else empty(spark, t) for t in TABLES})
    m.indexes = {n: f"{root}/{search.FOLDER}/{n}" for n in known.get("indexes", [])}
    return m


def import_sqlite(spark: SparkSession, path: str) -> TestMap:
    """A map from a SQLite file with the schema's tables, read in the tasks; missing optional tables are empty, missing columns null."""
    there = sqlite.tables(path)
    if missing := [t for t in CORE if t not in there]:
        raise ValueError(f"{path}: no table {', '.join(missing)}")
    spark.dataSource.register(sqlite.SqliteSource)
    reader = {"path": path}
    if spark.sparkContext.master.partition("[")[0] != "local":
        spark.sparkContext.addFile(path)
        reader["shipped"] = os.path.basename(path)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return TestMap(**{t: _sqlite_table(spark, reader | {"table": t, "pushdown": pushed}, t) if t in there else empty(spark, t) for t in TABLES})


def _sqlite_table(spark: SparkSession, options: dict, table: str) -> DataFrame:
    # The data source can't promise that a column has no nulls; aligned() gives the table's own types.
    from pyspark.sql.types import StructField, StructType

    loose = StructType([StructField(f.name, f.dataType, True) for f in TABLES[table]])
    return spark.read.format("sqlite").schema(loose).options(**options).load()


def discover(path: str) -> str:
    """The map or solution meant by a path: itself, or the only solution, else the only project, in a folder."""
    if not os.path.isdir(path) or os.path.exists(f"{path}/{VERSION_FILE}") or os.path.isdir(f"{path}/{MANIFESTS}"):
        return path
    for ending in (".sln", ".csproj"):
        found = sorted(f for f in os.listdir(path) if f.lower().endswith(ending))
        if len(found) == 1:
            return os.path.join(path, found[0])
        if found:
            raise ValueError(f"{path} has {len(found)} {ending} files; name one")
    raise ValueError(f"{path} has no .sln or .csproj file")
