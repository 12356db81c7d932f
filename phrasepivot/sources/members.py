"""An index of the members of a packed file, so that many tasks read it.

A gzip file that many tasks wrote is a row of members, each a gzip file of its own.  The index beside it says where each
begins; tasks then seek and unpack members of their own, in a stream.  Spark has no reader for a range of a packed file,
so these tasks read by pyarrow's file systems.  An index of another length or time than its file is passed over, and so is
one on a file system that pyarrow doesn't open; the file is then read by Spark, as one task's work.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from phrasepivot.sources.shipping import ship

#: Beside the packed files; Spark's readers pass over such a name.
FOLDER = "_members"
#: Bytes that are read at a time, and of lines in a batch.
_CHUNK, _BATCH = 1 << 20, 4 << 20


def _where(spark: SparkSession, path: str):
    """The file system, the file and its index."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    p = fs.makeQualified(p)
    return fs, p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"{FOLDER}/{p.getName()}")


def _state(status) -> str:
    return f"{status.getLen()} {status.getModificationTime()}"


def write_members(spark: SparkSession, path: str, sizes: list[int]) -> None:
    """The index of members of these sizes, in order; none for fewer than two."""
    fs, p, index = _where(spark, path)
    fs.delete(index, False)
    if len(sizes) < 2:
        return
    out = fs.create(index, True)
    try:
        out.write(bytearray("\n".join([_state(fs.getFileStatus(p)), *map(str, sizes)]).encode()))
    finally:
        out.close()


def members(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Begin and length of each member of a packed file; nothing without a good index."""
    fs, p, index = _where(spark, path)
    if not fs.exists(index):
        return []
    stream = fs.open(index)
    try:
        state, *sizes = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().split("\n")
    finally:
        stream.close()
    out, at = [], 0
    for size in map(int, sizes):
        out.append((at, size))
        at += size
    return out if state == _state(fs.getFileStatus(p)) else []


def _unpacked(file, length: int):
    """Pieces of text of a member, each of whole lines."""
    import zlib

    unpack, rest, left = zlib.decompressobj(31), [], length
    while left > 0:
        data = file.read(min(_CHUNK, left))
        if not data:
            raise OSError("a packed file is shorter than its index says")
        left -= len(data)
        text = unpack.decompress(data)
        cut = text.rfind(b"\n") + 1
        if cut:
            yield b"".join([*rest, text[:cut]])
            rest = []
        rest.append(text[cut:])
    if not unpack.eof:
        raise OSError("a member of a packed file is cut short")
    if last := b"".join([*rest, unpack.flush()]):
        yield last


def _reading(uri: str):
    """Of batches of (begin, length): the lines of these members, their member and their place in it."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)

        def batch(lines: list[bytes], begin: int, at: int):
            value = pc.cast(pa.array(lines, pa.binary()), pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([value, pa.array([begin] * len(lines), pa.int64()), pa.array(range(at, at + len(lines)), pa.int64())], ["value", "begin", "at"])

        for asked in batches:
            for begin, length in zip(*(c.to_pylist() for c in asked.columns)):
                with system.open_input_file(path) as file:
                    file.seek(begin)
                    held, size, at = [], 0, 0
                    for text in _unpacked(file, length):
                        held += (text[:-1] if text.endswith(b"\n") else text).split(b"\n")
                        size += len(text)
                        if size >= _BATCH:
                            yield batch(held, begin, at)
                            held, size, at = [], 0, at + len(held)
                    if held:
                        yield batch(held, begin, at)

    return run


def pyarrow_uri(spark: SparkSession, path: str) -> str | None:
    """The URI by which tasks open the path through pyarrow, nothing where pyarrow doesn't open its file system."""
    from pyarrow import fs

    uri = _where(spark, path)[1].toUri()
    # a local file has no host, and pyarrow asks for three strokes then
    uri = f"file://{quote(uri.getPath())}" if uri.getScheme() == "file" else uri.toASCIIString()
    try:
        system, p = fs.FileSystem.from_uri(uri)
        system.get_file_info(p)
    except (OSError, ValueError, NotImplementedError):
        return None
    return uri


def member_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """value, begin (of the member) and at (place in it, from 0) of every line of a packed file with an index, a task for
    each member; nothing where there is no good index, or pyarrow doesn't open the file system."""
    found = members(spark, path)
    if not found or (uri := pyarrow_uri(spark, path)) is None:
        return None
    ship(spark)
    rows = spark.createDataFrame(found, "begin long, length long").repartition(len(found), "begin")
    return rows.mapInArrow(_reading(uri), "value string, begin long, at long")
