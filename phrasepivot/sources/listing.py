"""Listings of many directories, each by a task.

Spark's own listing leaves out empty files and gathers all names in the driver, so tasks list by pyarrow's file systems.
Where pyarrow doesn't open the file system, the driver lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasepivot.sources.files import names, write_text
from phrasepivot.sources.members import pyarrow_uri
from phrasepivot.sources.shipping import ship

#: Most tasks that list.
TASKS = 1000


def _listing(uri: str):
    """Of batches of directory names below uri: each with the names of its files."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        sums = uri.startswith("file:")  # of files that Spark wrote to a local folder: no files of the user's
        for b in batches:
            for d in b.column(0).to_pylist():
                found = [i.base_name for i in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{d}")) if i.type != fs.FileType.Directory]
                found = [n for n in found if not (sums and n.startswith(".") and n.endswith(".crc"))]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.string()), pa.array(found, pa.string())], ["dir", "name"])

    return run


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """dir, name of every file two levels below root; the driver has the names of the first level, tasks those of the second."""
    base = root.rstrip("/")
    folders = [d for d, is_dir in names(spark, base) if is_dir]
    uri = pyarrow_uri(spark, base)
    if uri is None or not folders:
        rows = [(d, f) for d in folders for f, deeper in names(spark, f"{base}/{d}") if not deeper]
        return spark.createDataFrame(rows, "dir string, name string")
    ship(spark)
    rows = spark.createDataFrame([(d,) for d in folders], "dir string").repartition(min(len(folders), TASKS))
    return rows.mapInArrow(_listing(uri), "dir string, name string")


def _creating(uri: str):
    """Of batches of paths below uri: makes each an empty file, again where a task is run again."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for path in b.column(0).to_pylist():
                path = f"{base.rstrip('/')}/{path}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                system.open_output_stream(path).close()
            yield b

    return run


def create_empty(files: DataFrame, root: str) -> int:
    """Makes an empty file below root of each path in the only column of files; how many."""
    spark = files.sparkSession
    uri = pyarrow_uri(spark, root.rstrip("/"))
    if uri is None:
        made = 0
        for row in files.toLocalIterator():
            write_text(spark, f"{root.rstrip('/')}/{row[0]}", "")
            made += 1
        return made
    ship(spark)
    return files.select(F.col(files.columns[0]).alias("path")).mapInArrow(_creating(uri), "path string").count()
