"""What a worker holds at a time, so that an executor's workers stay small beside its JVM."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from phrasepivot.llm import common
from phrasepivot.llm.suffix_dedup import _scan

MB = 1 << 20


def peak_of(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_a_slice_of_a_batch_costs_its_own_bytes():
    texts = [("x%d " % i * 90_000)[:250_000] for i in range(128)]  # 32 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    def walk():
        for b in common.small_batches([batch], MB, "text"):
            common.texts_of(b.column(0))

    assert peak_of(walk) < 8
    assert [t.decode() for b in common.small_batches([batch], MB, "text") for t in common.texts_of(b.column(0))] == texts


def test_slices_with_nulls_have_their_own_offsets():
    array = pa.array(["ab", None, "", "çd", "e", None])
    for kind in (pa.string(), pa.large_string()):
        for a in range(7):
            for z in range(a, 7):
                part = array.cast(kind).slice(a, z - a)
                want = [(t or "").encode() for t in part.to_pylist()]
                assert common.texts_of(part) == want
                data, offsets = common.utf8_views(part)
                assert data.tobytes() == b"".join(want)
                assert offsets.tolist() == np.cumsum([0, *map(len, want)]).tolist()


def test_the_passage_scan_holds_little_at_a_time():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(2000)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    docs = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=T.LongType())}, mapInArrow=lambda run, _: run)
    run, rows = _scan(docs, 200), []
    assert peak_of(lambda: rows.extend(b.num_rows for b in run([batch]))) < 60
    assert sum(rows) == 2000


def test_few_rows_are_read_at_a_time(spark):
    common.ship_package(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= common.READ_ROWS
