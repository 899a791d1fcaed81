"""Versions of a table of lists in a shared folder: data folders beside a log of commits, one small file a version.

A version names the folder of each list, so that a run writes its own list alone. Its file is made whole beside the log and published under the
next number only if that number is free (a hard link on a local file system, a rename that does not overwrite elsewhere; the file system must do either
in one step, as local ones and HDFS do). Of two writers that began from the same version one fails to publish and begins again from the
version of the other. A stop at any point leaves the log as it was: data folders that no version names are left over, and vacuum() removes them.
Nothing that a version names is ever written again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

LOG = "_commits"


@dataclass(frozen=True)
class Commit:
    """A version: the folder of each list (relative to the table) and, of each stream that writes here, the last batch that is in it."""

    version: int = 0
    lists: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of its own is made only where none is named and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def files(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    at, fs = files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = files(spark, path)
    fs.delete(at, True)


def _text(spark: SparkSession, path: str) -> str:
    at, fs = files(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in children(spark, f"{path}/{LOG}") if n.endswith(".json") and n[:-5].isdigit())


def _parsed(text: str) -> Commit | None:
    """None for a file that is not whole, which only a file system without the step named above can leave."""
    try:
        return Commit(**json.loads(text))
    except (ValueError, TypeError):
        return None


def latest(spark: SparkSession, path: str) -> Commit:
    """The highest complete version; version 0 without lists if there is none."""
    for v in reversed(_versions(spark, path)):
        found = _parsed(_text(spark, f"{path}/{LOG}/{v:010d}.json"))
        if found is not None:
            return found
    return Commit()


def claim(spark: SparkSession, made: str, to: str) -> bool:
    """Gives a file its final name if nothing has that name; False if something has."""
    jvm = spark.sparkContext._jvm
    source, fs = files(spark, made)
    target, _ = files(spark, to)
    if fs.getScheme() == "file":
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(target), local(source))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        fs.delete(source, False)
        return True
    if fs.exists(target):
        return False
    return bool(fs.rename(source, target)) and not fs.exists(source)


def publish(spark: SparkSession, path: str, base: Commit, lists: dict[str, str], batches: dict[str, int] | None = None) -> Commit | None:
    """The version after base with some lists replaced; None if another writer was faster. Numbers of files that are not whole stay taken."""
    if latest(spark, path).version != base.version:
        return None
    number = max([base.version, *_versions(spark, path)[-1:]]) + 1
    made = Commit(number, base.lists | lists, base.batches | (batches or {}))
    beside = f"{path}/{LOG}/.{uuid.uuid4().hex}"
    at, fs = files(spark, beside)
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    if claim(spark, beside, f"{path}/{LOG}/{number:010d}.json"):
        return made
    remove(spark, beside)
    return None


def vacuum(spark: SparkSession, path: str, keep: int = 5) -> list[str]:
    """Removes data folders that belong to none of the last ``keep`` versions and are no newer than the oldest of them."""
    kept = [c for c in (_parsed(_text(spark, f"{path}/{LOG}/{v:010d}.json")) for v in _versions(spark, path)[-keep:]) if c]
    if not kept:
        return []
    named = {folder for c in kept for folder in c.lists.values()}
    gone = []
    for v in children(spark, path):
        if v.startswith("v=") and v[2:].isdigit() and int(v[2:]) <= kept[0].version:
            gone += [f"{v}/{part}" for part in children(spark, f"{path}/{v}") if f"{v}/{part}" not in named]
    for folder in gone:
        remove(spark, f"{path}/{folder}")
    return gone
