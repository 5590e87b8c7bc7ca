"""Small files in the shared store, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path) of a path in any store Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with its whole content, unless it exists; says whether it did.

    The content goes to a file of another name first, which then takes the name: by a
    hard link on a local disk, else by a rename that refuses to overwrite."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, p = hadoop_fs(spark, path)
    if fs.exists(p):
        return False
    p = fs.makeQualified(p)
    fs.mkdirs(p.getParent())
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}-{uuid.uuid4().hex[:12]}")
    out = fs.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if p.toUri().getScheme() == "file":
            place = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(place.get(p.toUri()), place.get(part.toUri()))
        else:
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            rename = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(part, p, rename)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(part, False)
