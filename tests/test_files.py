"""Ordered files of many tasks, packed files by member, numbered lines, quarantine, indexed parts, progress, hot pivots."""

import gzip
import io
import os
import time

import pytest
from pyspark.sql import functions as F

from phrasepivot.operators.bridge import bridge, hot_pivots
from phrasepivot.operators.merge import aligned_paths, merge
from phrasepivot.operators.quality import Progress, reported
from phrasepivot.plans.decoder_config import find_tables
from phrasepivot.plans.triangulate import Plan
from phrasepivot.sources.files import lines, numbered_lines, numbered_rows, write_lines
from phrasepivot.sources.members import _unpacked, members, write_members
from phrasepivot.sources.part_index import INDEX, lookup, parts_of, write_indexed
from phrasepivot.sources.phrase_table import parse_phrase_table, phrase_table_lines, read_lexical_counts, read_phrase_table, sort_out, write_lexical, write_phrase_table

TABLE = "src string, tgt string, phi_st double, lex_st double, phi_ts double, lex_ts double, align array<struct<s:int,t:int>>, c_t long, c_s long, c_st long"


def phrases(spark, n, src=lambda i: f"s{i % 97:02d} é"):
    return spark.createDataFrame([(src(i), f"t{i}", 0.5, 0.25, 0.125, 1.0, [{"s": 0, "t": 0}], 1, 2, i) for i in range(n)], TABLE)


def tasks(spark, run):
    """Tasks of the stages that run started."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("none", "none")
    return [s.numTasks for s in stages if s]


@pytest.mark.parametrize("name", ["t.gz", "t"])
def test_one_ordered_file_of_many_tasks(spark, tmp_path, name):
    table, path = phrases(spark, 3000), f"{tmp_path}/{name}"
    written = tasks(spark, lambda: write_phrase_table(table, path, writers=6))
    raw = open(path, "rb").read()
    text = (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines()
    assert 6 in written and len(text) == 3000 and text == sorted(text, key=str.encode)
    assert read_phrase_table(spark, path).count() == 3000 and not os.path.exists(f"{path}.parts")


def test_counts_of_a_million_and_more_are_written_whole(spark, tmp_path):
    table = spark.createDataFrame([("a", "b", 0.5, 0.25, 0.125, 1.0, [], 12345678, 1234567, 1000001)], TABLE)
    write_phrase_table(table, f"{tmp_path}/t")
    r = read_phrase_table(spark, f"{tmp_path}/t").first()
    assert (r.c_t, r.c_s, r.c_st) == (12345678, 1234567, 1000001)
    assert phrase_table_lines(table, six_digit_counts=True).first().value.endswith("||| 1.23457e+07 1.23457e+06 1e+06 ||| |||")


def test_lexical_files_compute_their_lexicon_once(spark, tmp_path):
    """Four sorted files, each of which reads its rows twice."""
    seen = spark.sparkContext.accumulator(0)
    words = spark.createDataFrame([(f"s{i}", f"t{i % 7}", 1.0, 1.0, 3.0) for i in range(50)], "s string, t string, c double, c_e double, c_f double")
    write_lexical(words.withColumn("c", F.udf(lambda c: seen.add(1) or c, "double")("c")), f"{tmp_path}/t", "lex")
    assert seen.value == 50 == read_lexical_counts(spark, f"{tmp_path}/lex.count.e2f").count()


def test_packed_files_are_read_by_member(spark, tmp_path):
    path = f"{tmp_path}/model/phrase-table.gz"
    write_phrase_table(phrases(spark, 4000), path, writers=5)
    assert len(members(spark, path)) == 5
    read = tasks(spark, lambda: lines(spark, path).write.format("noop").mode("overwrite").save())
    assert 5 in read and lines(spark, path).count() == 4000
    want = gzip.decompress(open(path, "rb").read()).decode().splitlines()
    assert [r.value for r in numbered_lines(spark, path).orderBy("n").collect()] == want
    assert find_tables(spark, str(tmp_path)) == [path]  # the index is no table
    # another file in its place isn't read by the old index
    os.remove(f"{tmp_path}/model/.phrase-table.gz.crc")
    open(path, "wb").write(gzip.compress(b"other\n"))
    assert [r.value for r in lines(spark, path).collect()] == ["other"]
    write_lines(spark.createDataFrame([("x",)], "value string"), path)
    assert [r.value for r in lines(spark, path).collect()] == ["x"]


def test_lines_of_members(spark, tmp_path):
    """Empty lines, long ones, lines that aren't UTF-8, a member without lines; an index of a cut file."""
    texts = ["", "a", "é" * 3_000_000, "", "b" * 100, ""]
    write_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").repartitionByRange(3, "i").sortWithinPartitions("i").select("value"), f"{tmp_path}/t.gz")
    assert [r.value for r in numbered_lines(spark, f"{tmp_path}/t.gz").orderBy("n").collect()] == texts
    parts = [gzip.compress(b"x\n\xff y\nlast"), gzip.compress(b""), gzip.compress(b"\n")]
    (tmp_path / "u.gz").write_bytes(b"".join(parts))
    write_members(spark, f"{tmp_path}/u.gz", [len(p) for p in parts])
    assert [r.x for r in numbered_lines(spark, f"{tmp_path}/u.gz").orderBy("n").select(F.hex(F.col("value").cast("binary")).alias("x")).collect()] == ["78", "FF2079", "6C617374", ""]
    assert [len(x) for x in _unpacked(io.BytesIO(parts[0]), len(parts[0]))] == [6, 4]
    with pytest.raises(OSError):
        list(_unpacked(io.BytesIO(parts[0][:-9]), len(parts[0]) - 9))
    with pytest.raises(OSError):
        list(_unpacked(io.BytesIO(parts[0]), len(parts[0]) + 1))


def test_a_file_is_written_over_itself(spark, tmp_path):
    path = f"{tmp_path}/t.gz"
    write_lines(spark.range(50, numPartitions=3).select(F.col("id").cast("string").alias("value")), path)
    write_lines(lines(spark, path).where("value < '3'"), path)
    assert sorted(int(r.value) for r in lines(spark, path).collect()) == sorted(i for i in range(50) if str(i) < "3")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "kept").write_text("x")
    with pytest.raises(Exception):
        write_lines(spark.createDataFrame([("x",)], "value string"), f"{tmp_path}/d")
    assert (tmp_path / "d" / "kept").exists()


def test_an_empty_file(spark, tmp_path):
    for name in ("a.gz", "b"):
        write_lines(spark.createDataFrame([], "value string"), f"{tmp_path}/{name}")
        assert os.path.isfile(f"{tmp_path}/{name}") and lines(spark, f"{tmp_path}/{name}").count() == 0


def test_numbered_lines(spark, tmp_path):
    """Of a file in many splits, and of a directory's files by name, though Spark reads the largest first."""
    want = [f"line {i} {'x' * (i % 50)}" for i in range(20_000)]
    (tmp_path / "f").write_text("\n".join(want))
    os.mkdir(tmp_path / "d")
    for i, (a, z) in enumerate([(0, 10), (10, 15_000), (15_000, 15_001), (15_001, 20_000)]):
        (tmp_path / "d" / f"p{i}").write_text("\n".join(want[a:z]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        for path in ("f", "d"):
            got = numbered_lines(spark, f"{tmp_path}/{path}").orderBy("n").collect()
            assert [r.n for r in got] == list(range(1, 20_001)) and [r.value for r in got] == want
        assert lines(spark, f"{tmp_path}/f").rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbered_rows(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"), F.col("id").alias("n_")).repartition(7)
    got = numbered_rows(df, "x").collect()
    assert len(got) == 500 and all(r.n == r.x + 1 for r in got) and numbered_rows(df.where("x < 0"), "x").collect() == []


BAD = {
    "": "fewer than five fields", "a ||| b ||| 1 1 1 1 ||| 0-0": "fewer than five fields", "a ||| b ||| 1 1 1 ||| 0-0 ||| 1 1": "fewer than four features", "a ||| b ||| 1 x 1 1 ||| 0-0 ||| 1 1": "a feature is no number",
    "a ||| b ||| 1 1 1 1 ||| 0-0 ||| 1": "fewer than two counts", "a ||| b ||| 1 1 1 1 ||| 0-0 ||| 1 y": "a count is no number",
}
UNSOUND = {" ||| b ||| 1 1 1 1 ||| ||| 1 1": "an empty phrase", "a ||| b ||| 1 2.7 1 1 ||| 0-0 ||| 1 1": "a feature is no probability", "a ||| b ||| 1 1 1 1 ||| 0-1 ||| 1 1": "a point beyond the words", "a ||| b ||| 1 1 1 1 ||| 0-0 ||| 1 -1": "a negative count"}


@pytest.mark.parametrize("sound", [False, True])
def test_quarantine(spark, sound):
    good = ["a ||| b ||| 1 0.5 0 1 ||| 0-0 ||| 1 1 1", "c d ||| e ||| 1 1 1 1 2.718 ||| 1-0 x ||| 1 1 ||| |||"]
    text = [*good, *BAD, *UNSOUND, None]
    rows, bad = sort_out(spark.createDataFrame(list(enumerate(text)), "n int, value string"), sound)
    want = BAD | (UNSOUND if sound else {})
    assert {(r.n, r.value): r.reason for r in bad.collect()} == {(i, x): want.get(x, "fewer than five fields") for i, x in enumerate(text) if x is None or x in want}
    lines_kept = [x for x in text if x is not None and x not in want]
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, parse_phrase_table(spark.createDataFrame([(x,) for x in lines_kept], "value string")).collect()))


def test_triangulate_with_a_quarantine(spark, tmp_path, capsys):
    from phrasepivot.cli import main

    line = "p ||| {} ||| 0.5 0.5 0.5 0.5 ||| 0-0 ||| 1 1 1"
    (tmp_path / "s").write_text("\n".join(["broken", line.format("s"), line.format("u").replace("0.5", "x", 1)]))
    (tmp_path / "t").write_text(line.format("t") + "\n")
    main(["triangulate", "features_based", "-s", f"{tmp_path}/s", "-t", f"{tmp_path}/t", "-m", "pspt", "-o", f"{tmp_path}/o", "--quarantine", f"{tmp_path}/q", "--progress"])
    assert (tmp_path / "o").read_text() == "s ||| t ||| 0.25 0.25 0.25 0.25 ||| 0-0 ||| 1 1 1 ||| |||\n"
    bad = spark.read.option("sep", "\t").csv(f"{tmp_path}/q/source").collect()
    assert sorted(tuple(r) for r in bad) == [("1", "fewer than five fields", "broken"), ("3", "a feature is no number", line.format("u").replace("0.5", "x", 1))]
    assert "merged: 1 rows" in capsys.readouterr().err


def test_lookup_opens_few_parts(spark, tmp_path):
    path, table = f"{tmp_path}/t", phrases(spark, 2000, lambda i: None if i == 7 else f"s{i:05d}").repartition(3)
    write_indexed(table, path, 16)
    parts = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(parts) == 16
    asked = lambda *x: spark.createDataFrame([(v,) for v in x], "src string")
    for x in ("s00000", "s01234", "s01999"):
        assert len(parts_of(spark, path, asked(x))) == 1 and [r.src for r in lookup(spark, path, asked(x, x, None)).collect()] == [x]
    none = asked(*(f"s{i:05d}x" for i in range(0, 1900, 40)), "a", "z")
    assert len(parts_of(spark, path, none)) <= 3 and lookup(spark, path, none).collect() == []
    every = spark.createDataFrame([(f"s{i:05d}",) for i in range(2000)], "src string")
    assert lookup(spark, path, every).count() == 1999
    write_indexed(table.where("false"), f"{tmp_path}/e", 4)
    assert lookup(spark, f"{tmp_path}/e", every).collect() == [] and os.path.isdir(f"{path}/{INDEX}")


def test_progress_counts_in_the_job(spark, tmp_path):
    progress, out = Progress(), io.StringIO()
    table = progress.watch("rows", phrases(spark, 500))
    kept = progress.watch("kept", table.where("c_st < 100"))
    with reported(spark, 0.05, out):
        kept.write.parquet(f"{tmp_path}/t")
        spark.range(4, numPartitions=4).select(F.expr("java_method('java.lang.Thread', 'sleep', 400L)")).write.format("noop").mode("overwrite").save()
    assert progress.counts() == {"rows": 500, "kept": 100} and {tuple(r) for r in progress.table(spark).collect()} == {("rows", 500), ("kept", 100)}
    assert "of 4 tasks" in out.getvalue()


def largest_task(spark, df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_hot_pivots(spark):
    """A pivot with a third of both tables' rows: the same rows, the largest task with a fraction of its product."""
    a, b = (phrases(spark, 900, lambda i: "hot" if i % 3 == 0 else f"p{i}") for _ in "ab")
    assert [tuple(r) for r in hot_pivots(a, b, 50).collect()] == [("hot", 6, 6)]
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("false", "-1", "40")):
        spark.conf.set(k, v)
    try:
        plain, split = bridge(a, b), bridge(a, b, hot_rows=50)
        assert largest_task(spark, plain) >= 300 * 300 and largest_task(spark, split) <= 300 * 300 / 4
        assert split.count() == 300 * 300 + 600 and split.exceptAll(plain).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["sum", "max", "occ"])
def test_merging_paths_is_merging_rows(spark, how):
    bridged = bridge(*(phrases(spark, 60, lambda i: f"p{i % 7}").withColumn("tgt", F.concat(F.lit("t"), (F.col("c_st") % 4).cast("string"))) for _ in "ab"))
    shown = lambda x: sorted(repr(tuple(r)) for r in merge(x, how).collect())
    assert shown(aligned_paths(bridged, how)) == shown(bridged)


def test_counts_based_joins_pivots_once(spark):
    """The plan of the result reads a table; the pivots were joined when it was written."""
    a, b = phrases(spark, 50), phrases(spark, 50)
    plan = Plan("counts_based", "pspt")
    progress = Progress()
    paths = plan.paths(progress.watch("bridged", plan.bridged(a, b)))
    assert progress.counts()["bridged"] == bridge(a, b).count()
    text = plan.table(paths)._jdf.queryExecution().optimizedPlan().toString()
    assert "pvt" not in text and plan.table(paths).count() == merge(bridge(a, b)).count()
