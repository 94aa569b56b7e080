"""Tables that are replaced as a whole: data under a fresh name, then a pointer to it by one rename."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


@dataclass(frozen=True)
class Entry:
    """What a pointer says: the folder of the data, the versions of its format and of what made it, and what it holds."""

    data: str
    format: int
    maker: int
    rows: int
    checksum: str


def _path(spark: SparkSession, *parts: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _tally(data: DataFrame) -> tuple[int, str]:
    """Rows and an order-free checksum of all values."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in data.columns]) if data.columns else F.lit(0)
    r = data.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return r["n"], f"{r['x']}/{r['s']}"


def publish(data: DataFrame, path: str, format: int = 1, maker: int = 1) -> Entry:
    """Puts data in place of what path holds. Readers see the old rows or the new ones, never a mixture or nothing.

    The data are written under a name of their own and counted as they lie there; only then does a small pointer,
    written beside its place, take that place by an atomic rename. A write that fails at any point leaves the pointer
    and the old rows; what it has left behind goes at the next success. The data of the last pointer stay, for readers
    that hold it.
    """
    spark = data.sparkSession
    before = pointer(spark, path)
    name = f"data-{uuid.uuid4().hex}"
    data.write.parquet(f"{path}/{name}")
    rows, checksum = _tally(spark.read.schema(data.schema).parquet(f"{path}/{name}"))
    new = Entry(name, format, maker, rows, checksum)
    fs, beside, place = _files(spark, path), _path(spark, path, f".{uuid.uuid4().hex}.json"), _path(spark, path, POINTER)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(asdict(new)).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.java.lang.Enum.valueOf(option, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(place), options)
    held = {name, before.data if before else name, POINTER, f".{POINTER}.crc"}
    for f in fs.listStatus(_path(spark, path)):
        if f.getPath().getName() not in held:
            fs.delete(f.getPath(), True)
    return new


def pointer(spark: SparkSession, path: str) -> Entry | None:
    """The pointer at path, or None where there is none or it can't be read."""
    fs, place = _files(spark, path), _path(spark, path, POINTER)
    try:
        if not fs.exists(place):
            return None
        source = fs.open(place)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return Entry(**json.loads(text))
    except (Py4JJavaError, ValueError, TypeError):
        return None


def current(spark: SparkSession, path: str, format: int = 1, maker: int = 1, verify: bool = True) -> DataFrame | None:
    """What was published last at path, or None where nothing is, another version made it, or it is broken.

    verify reads all of it once and compares rows and checksum; a broken entry is removed.
    """
    p = pointer(spark, path)
    if p is None:
        if _files(spark, path).exists(_path(spark, path, POINTER)):
            forget(spark, path)
        return None
    if (p.format, p.maker) != (format, maker):
        return None
    try:
        data = spark.read.parquet(f"{path}/{p.data}")
        if not verify or _tally(data) == (p.rows, p.checksum):
            return data
    except (PySparkException, Py4JJavaError):
        pass
    forget(spark, path)
    return None


def forget(spark: SparkSession, path: str) -> None:
    """Removes whatever path holds."""
    _files(spark, path).delete(_path(spark, path), True)
