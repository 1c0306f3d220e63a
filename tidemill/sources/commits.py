"""Commit numbers of a store: each is taken by creating a file that must not exist yet, so no two writers get the same one."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

TRIES = 1000


def claim_number(spark: SparkSession, root: str) -> int:
    """The next free number under ``root``/commits. A writer that is overtaken tries the next; a number whose writer fails stays unused.

    On a store like HDFS creating without overwriting is atomic; Hadoop's own local file system only looks first, so there
    the file is created by the operating system.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    folder = path(f"{root}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    local = fs.getUri().getScheme() == "file"
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    number = max((int(n) for n in names if n.isdigit()), default=0)
    for _ in range(TRIES):
        number += 1
        name = fs.makeQualified(path(folder, f"{number:010d}"))
        try:
            if local:
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(name.toUri()), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
                return number
            if fs.createNewFile(name):
                return number
        except Py4JJavaError as e:
            if not fs.exists(name):
                raise e
    raise RuntimeError(f"no free commit number in {root} after {TRIES} tries")
