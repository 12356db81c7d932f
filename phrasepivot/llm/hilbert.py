"""Shards cut from a Hilbert-curve ordering of several metadata dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasepivot.llm.common import Staged, ship_package, shuffle_partitions, tidy


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points; coords: (n, dims), each below 2**bits."""
    x = coords.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    assert dims * bits <= 63
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << one) | ((x[i] >> np.uint64(level)) & one)
    return index.astype(np.int64)


def _numbered(df: DataFrame, order: list) -> DataFrame:
    """df in that order, with _part and _at: the place of a row is that of its partition's first and _at."""

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*b.schema.names, "_part", "_at"])
            at += b.num_rows

    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return Staged(df.sparkSession, dealt.mapInArrow(tidy(place), T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])), "numbered").df


def _before(sums: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Of (partition, sum), a row for each partition: (partition, sum of those before) and the total."""
    out, total = [], 0
    for part, n in sorted(sums):
        out.append((part, total))
        total += n
    return out, total


def _value_bounds(df: DataFrame, value: Column, cells: int) -> tuple[list, int]:
    """At most cells values, in order, at which a cell begins, and how far cells are apart.

    All values if they are few, each with a cell of its own; else so that cells have about equally many rows, by the
    rows' counts in the values' order."""
    spark = df.sparkSession
    counts = Staged(spark, df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "values").df
    few = sorted(r[0] for r in counts.select("v").limit(cells + 1).collect())
    if len(few) <= cells:
        return few, max(1, cells // max(1, len(few)))
    placed = _numbered(counts, ["v"])
    offsets, total = _before([tuple(r) for r in placed.groupBy("_part").agg(F.sum("n")).collect()])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = spark.createDataFrame(offsets, "_part int, _before long")  # a row for each partition
    cell = F.floor(F.col("rank").cast("decimal(30,0)") * cells / F.lit(total)).cast("int")
    ranked = placed.withColumn("_sum", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_sum"))
    return sorted(r[0] for r in ranked.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).select("v").collect()), 1


def quantised(df: DataFrame, dims: list[str], bits: int) -> list:
    """A Column from 0 to 2**bits - 1 for each dimension; nulls count as the lowest.

    Numbers go by approximate quantiles of all rows; other values by their rank if at most 2**bits are distinct, else by
    the share of rows with a smaller one, so that their order holds.  The driver sees at most 2**bits + 1 values of a
    dimension."""
    cells, out = 1 << bits, []
    numeric = [c for c in dims if isinstance(df.schema[c].dataType, T.NumericType)]
    cuts = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [i / cells for i in range(1, cells)], 10_000).alias(c) for c in numeric)).first() if numeric else None

    def below(lo: int, hi: int, col: Column, bounds: list) -> Column:
        """The number of bounds at or below the value, by binary search in an expression."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col >= bounds[mid], below(mid + 1, hi, col, bounds)).otherwise(below(lo, mid, col, bounds))

    for c in dims:
        if c in numeric:
            bounds, col = sorted(set(cuts[c] or [])), F.col(c).cast("double")
            cell = below(0, len(bounds), col, bounds)
        else:
            col = F.col(c).cast("string")
            bounds, step = _value_bounds(df, col, cells)
            cell = F.least((below(0, len(bounds), col, bounds) - 1) * step, F.lit(cells - 1)) if bounds else F.lit(0)
        out.append(F.coalesce(F.when(col.isNull(), 0).otherwise(cell), F.lit(0)).cast("int"))
    return out


def hilbert_shards(df: DataFrame, dims: list[str], tie: list[str], shards: int, bits: int = 8) -> DataFrame:
    """df with curve (Hilbert index over dims), shard (0 to shards - 1) and slot (gapless from 0 in the shard).

    Rows are sorted by curve, then by a hash of the tie columns and by these, and
    cut into runs whose counts are at most one apart.  df should be a narrow
    table: texts need not be moved.  Nulls count as the lowest cell of a
    dimension; repeated rows get slots of their own; an empty table gives an empty
    result.  Columns curve, shard and slot of df are replaced."""
    spark = df.sparkSession
    ship_package(spark)
    names = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    inside = {c: f"_c{i}" for i, c in enumerate(names)}  # names that can't clash
    df = Staged(spark, df.select(*(F.col(c).alias(i) for c, i in inside.items())), "metadata").df
    dims, tie = [inside[c] for c in dims], [inside[c] for c in tie]
    n = len(dims)

    def curve(batches):
        import pyarrow as pa

        for b in batches:
            coords = np.stack([np.asarray(b.column(i)) for i in range(n)], axis=1) if b.num_rows else np.zeros((0, n))
            yield pa.RecordBatch.from_arrays([*b.columns[n:], pa.array(hilbert_index(coords, bits))], [*b.schema.names[n:], "curve"])

    cells = [q.alias(f"_{i}") for i, q in enumerate(quantised(df, dims, bits))]
    on_curve = df.select(*cells, *df.columns).mapInArrow(tidy(curve), T.StructType([*df.schema.fields, T.StructField("curve", T.LongType())]))
    on_curve = Staged(spark, on_curve, "metadata").df
    order = ["curve", F.xxhash64(*tie), *tie]
    placed = _numbered(on_curve, order)
    offsets, total = _before([tuple(r) for r in placed.groupBy("_part").count().collect()])  # a row for each partition
    starts = spark.createDataFrame(offsets, "_part int, _before long")
    rank = F.col("_before") + F.col("_at")
    shard = F.floor((F.lit(shards) * (rank + 1) - 1) / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int")
    out = placed.join(F.broadcast(starts), "_part").withColumn("_rank", rank).withColumn("shard", shard)
    first = F.floor(F.col("shard").cast("long") * F.lit(total).cast("decimal(20,0)") / F.lit(shards)).cast("long")
    return out.select(*(F.col(i).alias(c) for c, i in inside.items()), "curve", "shard", (F.col("_rank") - first).alias("slot"))
