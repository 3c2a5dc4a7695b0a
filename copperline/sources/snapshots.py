"""Tables whose current state is named by a manifest.

Data folders are written first and never changed. A manifest, one small JSON file per version, names
the folders that make up each table; creating the next one publishes a state. Versions are created
without overwriting, so of two writers one fails and nobody reads half a state. Folders that no
manifest names are left-overs of failed jobs and harmless.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "manifests"


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _file(root: str, version: int) -> str:
    return f"{root}/{MANIFESTS}/{version:010d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first. Lists names only."""
    fs, folder = _file_system(spark, root), _path(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, the latest by default; null where nothing is published."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    return json.loads(spark.read.text(_file(root, version), wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """Make ``manifest`` the state of its ``version``; that version must be new."""
    fs = _file_system(spark, root)
    staged = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, staged), False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    # the rename of a file context never replaces a file
    never_replace = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    context = jvm.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, staged), _path(spark, _file(root, manifest["version"])), never_replace)
    except Py4JJavaError as error:
        fs.delete(_path(spark, staged), False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise Conflict(f"version {manifest['version']} of {root} is published already") from error
        raise


def new_folder(table: str) -> str:
    """A folder name for new data of a table, below the root."""
    return f"{table}/{uuid.uuid4().hex}"


def unreferenced(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Data folders that none of the last ``keep`` versions names, relative to the root."""
    known = versions(spark, root)
    named = {f["folder"] for v in known[-keep:] for folders in read(spark, root, v)["tables"].values() for f in folders}
    fs, found = _file_system(spark, root), []
    for table in fs.listStatus(_path(spark, root)):
        name = table.getPath().getName()
        if table.isDirectory() and name != MANIFESTS:
            found += [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(table.getPath()) if s.isDirectory()]
    return sorted(f for f in found if f not in named)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete what ``unreferenced`` lists and the manifests before the last ``keep``. No job may be running on the tables."""
    gone = unreferenced(spark, root, keep)
    fs = _file_system(spark, root)
    for folder in gone:
        fs.delete(_path(spark, f"{root}/{folder}"), True)
    for version in versions(spark, root)[:-keep]:
        fs.delete(_path(spark, _file(root, version)), False)
    return gone


def table(spark: SparkSession, root: str, manifest: dict, name: str) -> DataFrame:
    """All rows of a table of single folders."""
    return spark.read.parquet(*[f"{root}/{f['folder']}" for f in manifest["tables"][name]])
