"""Paths on any file system that Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasepivot.sources.members import member_lines, write_members


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_dir(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a directory) of what lies in a directory, in order."""
    p, fs = _path(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p))


def readable(spark: SparkSession, path: str) -> str:
    """The path, or the path with .gz where only that exists."""
    if is_file(spark, path) or is_dir(spark, path):
        return path
    if is_file(spark, path + ".gz") or is_dir(spark, path + ".gz"):
        return path + ".gz"
    raise FileNotFoundError(f"neither {path} nor {path}.gz can be read")


def _text(spark: SparkSession, path: str) -> DataFrame:
    """value of every line, file, begin and at: where in it the part that a task reads begins, and a number that rises
    within the part."""
    found = readable(spark, path)
    if found.endswith(".gz") and is_file(spark, found) and (read := member_lines(spark, found)) is not None:
        return read.select("value", F.lit(found).alias("file"), "begin", "at")
    text = spark.read.option("lineSep", "\n").text(found)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row, column value, for each line; .gz is unpacked, by a task for each of its members if these are indexed."""
    return _text(spark, path).select("value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 1) and value of every line, in the order of the file, and of a directory's files by name.

    A line's number is its place in the part that its task reads and the lines of all parts before; these are a row for
    each split or member of a file, which is what is broadcast."""
    text = _text(spark, path)
    parts = text.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("many"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("many").over(Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = parts.select("file", "begin", "first", before.alias("before"))
    return text.join(F.broadcast(begins), ["file", "begin"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("n"), "value")


def write_lines(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Writes column value in the order of df; .gz packs, - prints.

    Every partition of df is written by its own task.  single_file: the parts then become one file at path, in order;
    packed parts are members of one packed file, of which an index is kept beside it.  Else a directory of parts."""
    if path == "-":
        for row in df.toLocalIterator():
            print(row.value)
        return
    spark, codec = df.sparkSession, "gzip" if path.endswith(".gz") else "none"
    if not single_file:
        df.write.mode("overwrite").option("compression", codec).text(path)
        return
    parts = f"{path}.parts"
    df.write.mode("overwrite").option("compression", codec).text(parts)
    sizes = join_parts(spark, parts, path)
    if codec == "gzip":
        write_members(spark, path, sizes)


def join_parts(spark: SparkSession, parts: str, path: str) -> list[int]:
    """Makes one file at path of the part files of a directory, which goes; their sizes, in order.

    A file system that can joins them without reading them; elsewhere their bytes are copied as they are, in a stream."""
    folder, fs = _path(spark, parts)
    found = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    found.sort(key=lambda s: (int(re.match(r"part-(\d+)", s.getPath().getName())[1]), s.getPath().getName()))
    sizes, paths, to = [s.getLen() for s in found], [s.getPath() for s in found], _path(spark, path)[0]
    jvm = spark.sparkContext._jvm
    whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
    if not paths:
        fs.create(whole, True).close()
    else:
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths) - 1)
        for i, part in enumerate(paths[1:]):
            rest[i] = part
        try:
            if len(rest):
                fs.concat(paths[0], rest)
            whole = paths[0]
        except UnsupportedOperationException:
            out = fs.create(whole, True)
            try:
                for part in paths:
                    source = fs.open(part)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 4 << 20, False)
                    finally:
                        source.close()
            finally:
                out.close()
    fs.delete(to, False)  # what was there till now, which df may have been read from
    if not fs.rename(whole, to):
        raise OSError(f"{path} can't be written")
    fs.delete(folder, True)
    return sizes


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: what is read more than once and is costly to make again.

    by: a column whose values have folders of their own, so that a filter on it reads no others."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system, from the driver; - prints."""
    if path == "-":
        print(text, end="")
        return
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def numbered_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with n (from 1), its place in this order: of sorted parts, a place in the part and the rows of all parts before,
    which are a row for each part.  Goes through the shared folder, so that parts stay as they are."""
    sorted_rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    rows = staged(sorted_rows, "sorted")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_many"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = parts.select("_part", "_first", before.alias("_before"))
    return rows.join(F.broadcast(begins), "_part").select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("n"))


def work_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); where that is unset, as in
    tests, a local one.  It goes when the process ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{(found or 'file://' + tempfile.gettempdir()).rstrip('/')}/phrasepivot-{uuid.uuid4().hex}"
    p, fs = _path(spark, folder)
    fs.mkdirs(p)

    def clean() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            fs.delete(p, True)

    atexit.register(clean)
    return folder
