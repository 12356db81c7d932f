"""Shared plumbing: tables, the shared folder, staging, packing of texts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import time
import uuid
import zipfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper to lower case, for text that is compared as UTF-8 bytes.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Most rows of a batch that goes to a worker, and of one that is read from Parquet.
ARROW_ROWS, READ_ROWS = 2000, 1024
#: Bytes of text that a worker looks at in one step, where each takes several objects or numbers.
STEP_BYTES = 1 << 20
#: Bits of the largest bitmap that is broadcast, as a power of two: 32 MB.
LARGEST_FILTER = 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds what is read and what is sent to
    their workers at a time: by default that is 4,096 and 10,000 rows, of long texts hundreds of megabytes."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(int(spark.conf.get(rows)), ARROW_ROWS) if int(spark.conf.get(rows)) > 0 else ARROW_ROWS)
    read = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(read, min(int(spark.conf.get(read)), READ_ROWS))
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="package-")
    path = os.path.join(folder, f"{package}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(os.path.join(root, package)):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(d, f), os.path.relpath(os.path.join(d, f), root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def tidy(run):
    """A function of batches that gives memory back when it ends: workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, as in tests, a folder of this process is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before the process
        pass


_scopes: list[list] = []


@contextlib.contextmanager
def scratch():
    """Deletes, at its end, the tables that were staged inside, but for those in the list that it gives."""
    kept: list[Staged] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        for made in _scopes.pop():
            if made in kept:
                if _scopes:
                    _scopes[-1].append(made)
            else:
                made.drop()


class Staged:
    """A DataFrame written to the shared folder and read again: its lineage
    is cut, and any executor can read it after another is lost."""

    def __init__(self, spark: SparkSession, df: DataFrame, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_delete_quietly, spark, self.path)
        if _scopes:
            _scopes[-1].append(self)
        sweep(spark)

    def drop(self) -> None:
        delete(self.spark, self.path)


_swept = [0.0, 0.0]


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does when the driver collects its garbage.

    That takes a twentieth of the driver's time at most."""
    now = time.monotonic()
    if now - _swept[0] >= 20 * _swept[1]:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept[:] = time.monotonic(), time.monotonic() - now


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df.sparkSession, df, name).df


def split_of(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def split_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8_views(array) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string array: its bytes, of a slice only the slice's, and the n + 1 offsets. Nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "") if array.null_count else array
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data, offsets)


def texts_of(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; nulls count as empty."""
    data, offsets = utf8_views(column)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def small_batches(batches, max_bytes: int, column: str):
    """Cuts Arrow batches so that each holds about max_bytes of the column; a longer text stands alone."""
    import pyarrow as pa

    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        if col.nbytes <= max_bytes or b.num_rows <= 1:
            yield b
            continue
        sizes = np.diff(utf8_views(col if not pa.types.is_binary(col.type) else col.cast(pa.large_binary()).view(pa.large_string()))[1])
        block = (np.cumsum(sizes) - sizes) // max_bytes
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            yield b.slice(a, z - a)


class KeyFilter:
    """A bitmap over 64-bit keys: whether a key may be among some.  It saves work and decides nothing.

    It has about 16 bits for each key, and LARGEST_FILTER at most, which bounds what is sent; a key's lowest bits
    are its place."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def of(keys: DataFrame, column: str) -> KeyFilter:
        """keys: distinct or not, read twice."""
        bits = min(LARGEST_FILTER, max(16, (16 * keys.count()).bit_length()))
        place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("m"))
        words = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # 2 ** (bits - 6) rows at most
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
        return KeyFilter(bits, table)

    def may(self, keys: np.ndarray) -> np.ndarray:
        """Booleans of int64 keys."""
        at = keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class Carried:
    """Columns that an operator passes on unread, under names that can't clash with its own."""

    def __init__(self, df: DataFrame, names: list[str]):
        self.names = names
        self.inside = [f"_carried_{i}" for i in range(len(names))]
        self.columns = [df[n].alias(i) for n, i in zip(names, self.inside)]
        self.schema = "".join(f", {i} {df.schema[n].dataType.simpleString()}" for n, i in zip(names, self.inside))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "columns"}  # workers need the names only

    def of(self, batch) -> list:
        return [batch.column(batch.schema.get_field_index(i)) for i in self.inside]

    def named(self, df: DataFrame, own: list[str]) -> DataFrame:
        """own first, then the carried columns by their names; a carried one of an own name is left out."""
        return df.select(*own, *(F.col(i).alias(n) for i, n in zip(self.inside, self.names) if n not in own))
