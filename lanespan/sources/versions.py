"""Published versions of a table: a log of numbered entries, each written only if it is absent.

A version's rows lie in a folder of their own and are complete before their entry exists. Entries never change and readers take the
last one, so a writer that fails or is beaten by another leaves what was published before as it was.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

ENTRY = "version bigint, folder string"
#: File systems whose rename refuses an existing target in one step.
RENAMING = ("hdfs", "viewfs")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(stream, text: str) -> None:
    stream.write(text.encode())
    stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one; of writers at the same moment one gets True. Readers see it whole or not at all.

    A local file is linked into place, HDFS renames without overwriting, and object stores take a conditional write.
    """
    jvm = spark._jvm
    target, fs = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    scheme = fs.getUri().getScheme()
    if scheme != "file" and scheme not in RENAMING:
        try:
            _write(fs.createFile(target).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build(), text)
        except Py4JJavaError:
            if fs.exists(target):
                return False
            raise
        return True
    whole = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    _write(fs.create(whole, False), text)
    try:
        if scheme == "file":
            places = [jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri()) for p in (target, whole)]
            jvm.java.nio.file.Files.createLink(*places)
        else:
            plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(whole, target, plain)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(whole, False)
    return True


def latest(spark: SparkSession, path: str) -> Row | None:
    """Version and folder of the last entry, or None where nothing was published."""
    place, fs = _file_system(spark, f"{path.rstrip('/')}/log")
    if not fs.exists(place):
        return None
    return spark.read.schema(ENTRY).json(place.toString()).orderBy(F.desc("version")).first()


def new_folder(path: str) -> str:
    """Where the rows of a version to come may be written."""
    return f"{path.rstrip('/')}.versions/{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Remove rows that will not be published."""
    place, fs = _file_system(spark, folder)
    fs.delete(place, True)


def require_latest(spark: SparkSession, path: str, version: int) -> None:
    """Refuse to go on from a version that is not the last; 0 stands for none."""
    place, fs = _file_system(spark, path)
    last = latest(spark, path)
    if (last.version if last else 0) != version or (last is None and fs.exists(place)):
        raise FileExistsError(f"{path} is at version {last.version if last else 'unknown'}, not {version}")


def publish(spark: SparkSession, path: str, folder: str, replaces: int) -> None:
    """Make a complete folder the version after ``replaces``; an error where another writer was first."""
    entry = json.dumps({"version": replaces + 1, "folder": folder})
    if not put_if_absent(spark, f"{path.rstrip('/')}/log/{replaces + 1:012d}.json", entry):
        raise FileExistsError(f"{path} has a version {replaces + 1}")
