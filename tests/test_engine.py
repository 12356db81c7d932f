"""The engine on small tables whose results are worked out by hand."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from phrasepivot.functions.columns import COUNT_FUNCTIONS, dot, format_g6
from phrasepivot.operators.bridge import bridge, invert, pivot_first, table_limit
from phrasepivot.operators.lexicon import build_lexicon
from phrasepivot.operators.merge import merge, with_marginals
from phrasepivot.plans.triangulate import Plan, triangulate
from phrasepivot.sources.phrase_table import lexical_tables, parse_phrase_table, phrase_table_lines, read_lexical, read_lexical_counts, read_phrase_table

A = """haus ||| budova ||| 0.4 0.3 0.2 0.1 ||| 0-0 ||| 5 12 4
haus ||| dum ||| 0.8 0.7 0.6 0.5 ||| 0-0 ||| 10 12 8
heim ||| dum ||| 0.2 0.3 0.5 0.4 ||| 0-0 ||| 10 4 2
rotes haus ||| cerveny dum ||| 0.9 0.6 0.7 0.5 ||| 0-0 1-1 ||| 6 7 5"""
B = """haus ||| house ||| 0.9 0.8 0.7 0.6 ||| 0-0 ||| 9 12 7
haus ||| the house ||| 0.5 0.4 0.3 0.2 ||| 0-1 ||| 4 12 3
heim ||| house ||| 0.1 0.2 0.5 0.5 ||| 0-0 ||| 9 4 1
rotes haus ||| red house ||| 0.8 0.7 0.6 0.5 ||| 0-0 1-1 ||| 6 7 4"""
COUNTS = {
    "budova|house": {"min": (12, 7, 4), "max": (17, 11, 7), "a-mean": (13, 8, 5), "g-mean": (13, 8, 5)},
    "budova|the house": {"min": (6, 7, 3), "max": (12, 11, 4), "a-mean": (8, 8, 3), "g-mean": (7, 8, 3)},
    "cerveny dum|red house": {"min": (4, 4, 4), "max": (5, 5, 5), "a-mean": (4, 4, 4), "g-mean": (4, 4, 4)},
    "dum|house": {"min": (12, 11, 8), "max": (17, 18, 10), "a-mean": (13, 13, 8), "g-mean": (13, 12, 8)},
    "dum|the house": {"min": (6, 11, 3), "max": (12, 18, 8), "a-mean": (8, 13, 5), "g-mean": (7, 12, 4)},
}
FEATURES = {
    "budova|house": ((0.18, 0.08, 0.28, 0.18), None, (0.333333, 0.318182, 0.571429, 1)),
    "budova|the house": ((0.1, 0.04, 0.12, 0.06), None, (0.5, 0.318182, 0.428571, 1)),
    "cerveny dum|red house": ((0.56, 0.35, 0.54, 0.3), None, (1, 0.681818, 1, 1)),
    "dum|house": ((0.59, 0.48, 0.66, 0.57), (0.54, 0.4, 0.56, 0.42), (0.666667, 0.681818, 0.727273, 1)),
    "dum|the house": ((0.3, 0.2, 0.24, 0.14), None, (0.5, 0.681818, 0.272727, 1)),
}


def table(spark, text, **options):
    return parse_phrase_table(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"), **options)


def rows(df):
    return {f"{r.src}|{r.tgt}": r for r in df.collect()}


def features(r):
    return (r.phi_st, r.lex_st, r.phi_ts, r.lex_ts)


@pytest.fixture(scope="module")
def ab(spark):
    return table(spark, A).persist(), table(spark, B).persist()


def test_premerge_rows(ab):
    x = bridge(*ab)
    assert x.count() == 6
    assert [(p.s, p.t) for p in x.where("src = 'budova' and tgt = 'the house'").first().align] == [(0, 1)]


@pytest.mark.parametrize("how", ["min", "max", "a-mean", "g-mean"])
def test_counts(ab, how):
    plan = Plan("features_based", "pspt", counts=how)
    got = rows(plan.table(plan.bridged(*ab)))
    assert {k: (r.c_t, r.c_s, r.c_st) for k, r in got.items()} == {k: v[how] for k, v in COUNTS.items()}


@pytest.mark.parametrize("column,action,weight", [(0, "features_based", "summation"), (1, "features_based", "maximization"), (2, "counts_based", "summation")])
def test_features(ab, column, action, weight):
    plan = Plan(action, "pspt", weight)
    got = rows(plan.table(plan.bridged(*ab)))
    assert got.keys() == FEATURES.keys()
    for k, values in FEATURES.items():
        assert features(got[k]) == pytest.approx(values[column] or values[0], rel=1e-5)


def test_lexicon_and_lexical_files(spark, ab):
    lexicon = build_lexicon(bridge(*ab))
    assert {tuple(r) for r in lexicon.collect()} == {("NULL", "the", 6, 6, 6), ("budova", "house", 7, 7, 22), ("cerveny", "red", 4, 4, 4), ("dum", "house", 15, 15, 22)}
    files = {k: [r.value for r in v.collect()] for k, v in lexical_tables(lexicon).items()}
    assert sorted(files["e2f"]) == sorted(["the NULL 1.0000000", "house budova 1.0000000", "red cerveny 1.0000000", "house dum 1.0000000"])
    assert sorted(files["f2e"]) == sorted(["NULL the 1.0000000", "budova house 0.3181818", "cerveny red 1.0000000", "dum house 0.6818182"])
    assert "house dum 15 15" in files["count.e2f"] and "dum house 15 22" in files["count.f2e"]


def test_missing_third_count_is_zero(spark):
    one = table(spark, "p ||| s ||| 0.5 0.5 0.5 0.5 2.7 ||| 0-0 ||| 10 10")
    assert bridge(one, one).first().c_st == 0
    plan = Plan("counts_based", "pspt")
    got = plan.table(plan.bridged(one, one)).first()
    assert features(got) == (0, 0, 0, 0)


def test_invert_keeps_lexical_weights(spark, ab):
    turned = invert(ab[0]).where("src = 'dum' and tgt = 'haus'").first()
    assert features(turned) == (0.6, 0.7, 0.8, 0.5)
    assert features(invert(ab[0], True).where("src = 'dum' and tgt = 'haus'").first()) == (0.6, 0.5, 0.8, 0.7)
    assert sorted(invert(invert(ab[1])).collect()) == sorted(ab[1].collect())


def test_modes_agree(ab):
    a, b = ab
    want = sorted(map(str, bridge(a, b).select("src", "tgt", "phi_st", "phi_ts", "c_st").collect()))
    for mode, x in (("sppt", (invert(a), b)), ("pstp", (a, invert(b))), ("sptp", (invert(a), invert(b)))):
        assert sorted(map(str, bridge(*pivot_first(*x, mode)).select("src", "tgt", "phi_st", "phi_ts", "c_st").collect())) == want
    with pytest.raises(ValueError):
        pivot_first(a, b, "pspp")
    with pytest.raises(ValueError):
        Plan("none", "pspt")


def test_sums_are_cut_to_one(spark):
    line = "{} ||| {} ||| 0.9 0.9 0.9 0.9 ||| 0-0 ||| 1 1 1"
    a = table(spark, "\n".join(line.format(p, "s") for p in ("p1", "p2")))
    b = table(spark, "\n".join(line.format(p, "t") for p in ("p1", "p2")))
    for plan, value in ((Plan("features_based", "pspt"), 1), (Plan("features_based", "pspt", "maximization"), 0.81), (Plan("counts_based", "pspt"), 1)):
        got = plan.table(plan.bridged(a, b)).first()
        assert features(got) == pytest.approx((value,) * 4)
        assert (got.c_t, got.c_s, got.c_st) == (2, 2, 2)


def test_a_row_of_its_own_is_not_cut(spark):
    one = table(spark, "p ||| s ||| 2 2 2 2 ||| 0-0 ||| 1 1 1")
    assert features(merge(bridge(one, one), "sum").first()) == (4, 4, 4, 4)


def test_prefix_pivots_are_met(spark):
    line = "{} ||| x ||| 1 1 1 1 ||| 0-0 ||| 1 1 1"
    of = lambda *pivots: table(spark, "\n".join(line.format(p) for p in pivots))
    assert bridge(of("der", "derart"), of("derart")).count() == 1
    assert bridge(of("der", "der é"), of("der é")).count() == 1


def test_parser_edges(spark):
    r = table(spark, "a b ||| c ||| 1 2 3 4 ||| 0-0 x 1-2-3 1-1 ||| 5808.7 1e+06 ||| more").first()
    assert [(p.s, p.t) for p in r.align] == [(0, 0), (1, 1)] and (r.c_t, r.c_s, r.c_st) == (5808, 1000000, None)
    bad = ["a ||| b ||| 1 2 3 4 ||| ||| 5", "a ||| b ||| 1 2 x 4 ||| ||| 5 5", "", "a ||| b"]
    for line in bad:
        with pytest.raises(Exception, match="no phrase table line"):
            table(spark, line).collect()
    assert table(spark, "\n".join([*bad, A]), lenient=True).count() == 4


def test_lines_round_trip(spark, ab):
    back = parse_phrase_table(phrase_table_lines(ab[0]))
    assert sorted(back.collect()) == sorted(ab[0].collect())
    empty = table(spark, "a ||| b ||| 1 1e-05 3 4 ||| ||| 5 6 7")
    assert phrase_table_lines(empty, 5).first().value == "a ||| b ||| 1 1e-05 3 4 0 ||| ||| 5 6 7 ||| |||"
    with pytest.raises(ValueError):
        phrase_table_lines(empty, 3)


def test_lines_are_in_byte_order(spark):
    line = "{} ||| {} ||| 1 1 1 1 ||| 0-0 ||| 1 1 1"
    text = "\n".join(line.format(*x) for x in (("derart", "c"), ("der é", "z"), ("der", "b"), ("der pass", "a")))
    assert [r.value.split(" |||")[0] for r in phrase_table_lines(table(spark, text)).collect()] == ["der pass", "der", "der é", "derart"]


def test_files(spark, tmp_path):
    (tmp_path / "m/model").mkdir(parents=True)
    with gzip.open(tmp_path / "m/model/phrase-table.gz", "wt") as f:
        f.write(A)
    (tmp_path / "b").write_text(B + "\n")
    out = tmp_path / "out"
    triangulate(spark, Plan("counts_based", "pspt"), str(tmp_path / "m"), str(tmp_path / "b"), str(out), "lex")
    assert out.read_text().split("\n")[0] == "budova ||| house ||| 0.333333 0.318182 0.571429 1 ||| 0-0 ||| 12 7 4 ||| |||"
    assert read_phrase_table(spark, str(out)).count() == 5
    assert {r.p for r in read_lexical(spark, str(tmp_path / "lex.f2e")).collect()} == {1.0, 0.3181818, 0.6818182}
    assert read_lexical_counts(spark, str(tmp_path / "lex.count.e2f")).count() == 4
    triangulate(spark, Plan("features_based", "pspt"), str(tmp_path / "m"), str(tmp_path / "b"), str(tmp_path / "o.gz"))
    with gzip.open(tmp_path / "o.gz", "rt") as f:
        assert len(f.readlines()) == 5
    with pytest.raises(TypeError):
        read_phrase_table(spark, str(tmp_path / "none"))


def test_marginals_hold(ab):
    t = with_marginals(merge(bridge(*ab), "sum"))
    assert all(r.c_s == r.x for r in t.groupBy("src").agg(F.max("c_s").alias("c_s"), F.sum("c_st").alias("x")).collect())
    assert all(r.c_t == r.x for r in t.groupBy("tgt").agg(F.max("c_t").alias("c_t"), F.sum("c_st").alias("x")).collect())


def test_table_limit(ab):
    assert {(r.src, r.tgt) for r in table_limit(merge(bridge(*ab), "sum"), 1).collect()} == {("budova", "house"), ("cerveny dum", "red house"), ("dum", "house")}


def test_scalars(spark):
    x = spark.createDataFrame([(4, 9)], "a long, b long").select(*(f(F.col("a"), F.col("b")).alias(k) for k, f in COUNT_FUNCTIONS.items())).first()
    assert (x["min"], x["max"], x["a-mean"], x["g-mean"]) == (4, 9, 6.5, 6.0)
    assert spark.range(1).select(dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == 11


def test_format_g6(spark):
    rng = random.Random(0)
    values = [0.0, -1.5, 1234565.0, 999999.5, 9999995.0, 1e-5, 0.0001, 1e22, 73564.15, *(rng.uniform(0, 1) * 10 ** rng.randint(-12, 15) for _ in range(500)), *(rng.randint(1, 9999999) / 10 ** rng.randint(0, 9) for _ in range(500))]
    for x, got in spark.createDataFrame([(v,) for v in values], "x double").select("x", format_g6(F.col("x"))).collect():
        assert got == "%.6g" % x, (x, got, math.frexp(x))


def test_points_out_of_range(spark):
    from phrasepivot.operators.quality import points_out_of_range

    t = table(spark, "a ||| b c ||| 1 1 1 1 ||| 0-0 1-0 0-2 ||| 1 1\na ||| b ||| 1 1 1 1 ||| 0-0 ||| 1 1")
    assert [tuple(r) for r in points_out_of_range(t).collect()] == [("a", "b c", 2)]
    assert build_lexicon(bridge(t, t)).count() > 0  # such points take no part


def test_empty_tables(spark, ab):
    none = ab[0].limit(0)
    plan = Plan("counts_based", "pspt")
    assert plan.table(plan.bridged(none, ab[1])).count() == 0


def test_streaming_counts(spark, tmp_path):
    from phrasepivot.streaming.counts import running_counts

    spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "c", 5)], "src string, tgt string, c_st long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, tgt string, c_st long").parquet(str(tmp_path / "in"))
    q = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("pair_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("pair_counts").collect()} == {("a", "b", 3), ("a", "c", 5)}
