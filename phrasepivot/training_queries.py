"""Registered queries of phrase extraction and training, and the same in SQL.

The tables hold no parallel texts, so sentences are derived: an order is a sentence, its source words the first words of
its items' part names in the items' order, its target words the parts' types, neighbours by price; an item aligns its two
words unless its quantity is under 10, and with a discount of 0.08 or more its source word also has the next target word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasepivot.cli import main
from phrasepivot.functions.columns import show_alignment
from phrasepivot.operators.extraction import extract_phrases
from phrasepivot.plans.training import phrase_table
from phrasepivot.queries import _read, _show, _shown, _sql_lexicon, _sql_weights
from phrasepivot.schema import COUNTS, FEATURES
from phrasepivot.sources.files import staged, work_folder, write_lines
from phrasepivot.sources.phrase_table import read_lexical, read_phrase_table


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, tgt, align."""
    item, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    more = ["l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_discount"]
    order = Window.partitionBy("id")  # as the sentences are grouped by, so that items are dealt once
    x = item.join(part, item.l_partkey == part.p_partkey).withColumnRenamed("l_orderkey", "id").select(
        "id", "l_quantity", "l_discount", F.split("p_name", " ")[0].alias("w"), F.lower("p_type").alias("x"),
        (F.row_number().over(order.orderBy("l_linenumber", *more)) - 1).alias("s"), (F.row_number().over(order.orderBy(F.floor(F.col("l_linenumber") / 2), *more)) - 1).alias("t"), F.count(F.lit(1)).over(order).cast("int").alias("n"),
    )
    point = lambda t: F.struct(F.col("s"), t.cast("int").alias("t"))
    own = F.when(F.col("l_quantity") >= 10, point(F.col("t")))
    next_one = F.when((F.col("l_quantity") >= 10) & (F.col("l_discount") >= 0.08) & (F.col("t") + 1 < F.col("n")), point(F.col("t") + 1))
    words = lambda at, word: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, word))), lambda y: y[word]), " ")
    points = F.filter(F.flatten(F.collect_list(F.array(own, next_one))), lambda p: p.isNotNull())
    return x.groupBy("id").agg(words("s", "w").alias("src"), words("t", "x").alias("tgt"), F.array_sort(F.array_distinct(points)).alias("align"))


def extracted_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_phrases(sentences(spark, sf_dir)).select("src", "tgt", show_alignment(F.col("align")).alias("align"), "n")


def trained_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(phrase_table(staged(sentences(spark, sf_dir), "sentences")))


def cli_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line from an alignment file and two corpora to the model's files, of phrases of up to four words."""
    root = work_folder(spark)
    rows = sentences(spark, sf_dir).orderBy("id")
    for name, value in (("C.encs.ali.gz", F.concat(show_alignment(F.col("align")), F.lit("\tx"))), ("C.en.tok.gz", F.concat("src", F.lit(" "))), ("C.cs.tok.gz", F.col("tgt"))):
        write_lines(rows.select(value.alias("value")), f"{root}/{name}")
    main(["train", f"{root}/C.encs.ali.gz", f"{root}/out", "--max-phrase-length", "4"])
    model = f"{root}/out/model.encs.C"
    empty = F.lit(None)
    table = _shown(read_phrase_table(spark, model)).select(F.lit("phrase-table").alias("file"), "*")
    for name in ("lex.e2f", "lex.f2e"):
        lexicon = read_lexical(spark, f"{model}/model/{name}").select(
            F.lit(name).alias("file"), F.col("w1").alias("src"), F.col("w2").alias("tgt"), F.col("p").alias("phi_st"), *(empty.cast("double").alias(f) for f in FEATURES[1:]), empty.cast("string").alias("align"), *(empty.cast("long").alias(c) for c in COUNTS)
        )
        table = table.unionByName(lexicon)
    return table


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (extracted_phrases, trained_table, cli_train)}

# ---- the same in SQL ----------------------------------------------------------------

_MORE = "l_extendedprice, l_quantity, l_partkey, l_suppkey, l_discount"
_SENTENCES = f"""item as (select l_orderkey as id, l_quantity, l_discount, split_part(p_name, ' ', 1) as w, lower(p_type) as x, row_number() over (partition by l_orderkey order by l_linenumber, {_MORE}) - 1 as s,
  row_number() over (partition by l_orderkey order by l_linenumber // 2, {_MORE}) - 1 as t, count(*) over (partition by l_orderkey) as n from lineitem join part on l_partkey = p_partkey),
text as (select id, string_agg(w, ' ' order by s) as src, string_agg(x, ' ' order by t) as tgt, count(*) as n from item group by id),
point as (select id, s, t from item where l_quantity >= 10 union select id, s, t + 1 from item where l_quantity >= 10 and l_discount >= 0.08 and t + 1 < n),
sentence as (select id, src, tgt, n, coalesce(align, []) as align from text left join (select id, list_sort(list({{'s': s, 't': t}})) as align from point group by id) using (id))"""


def _sql_extracted(length: int) -> str:
    """Spans of both sides that hold points, and none that leads out of one of them."""
    inside = lambda x, a, b: f"p.{x} between {a} and {b}"
    words = lambda c, a, b: f"array_to_string(string_split({c}, ' ')[{a} + 1:{b} + 1], ' ')"
    return f"""{_SENTENCES},
sides as (select id, a, b from (select id, n, unnest(range(n)) as a from text), range({length}) as r(d), lateral (select a + d as b) where b < n),
pairs as (select src, tgt, align, l.a as i, l.b as j, r.a as a, r.b as b from sentence join sides l using (id) join sides r using (id)
  where len(list_filter(align, lambda p: {inside('s', 'l.a', 'l.b')} and {inside('t', 'r.a', 'r.b')})) > 0 and len(list_filter(align, lambda p: ({inside('s', 'l.a', 'l.b')}) <> ({inside('t', 'r.a', 'r.b')}))) = 0),
shown as (select {words('src', 'i', 'j')} as src, {words('tgt', 'a', 'b')} as tgt, list_transform(list_filter(align, lambda p: {inside('s', 'i', 'j')}), lambda p: {{'s': p.s - i, 't': p.t - a}}) as align from pairs),
extracted as (select src, tgt, align, count(*) as n from shown group by all)"""


def _sql_trained(length: int) -> str:
    return f"""with {_sql_extracted(length)},
often as (select src, tgt, align, n, row_number() over (partition by src, tgt order by n desc, align) as r, sum(n) over (partition by src, tgt)::bigint as c_st from extracted),
merged as (select src, tgt, align, c_st from often where r = 1),
full_table as (select *, sum(c_st) over (partition by tgt)::bigint as c_t, sum(c_st) over (partition by src)::bigint as c_s from merged),
tri as (select src, tgt, align, 1.0::double as c_raw from sentence),
{_sql_lexicon()},
{_sql_weights()},
trained as (select src, tgt, c_st / c_t as phi_st, w_st as lex_st, c_st / c_s as phi_ts, w_ts as lex_ts, {_show('align')} as align, c_t, c_s, c_st from full_table join weights using (src, tgt))"""


_NINE = ", ".join(f"round({f}, 9) as {f}" for f in FEATURES)
_SIX = ", ".join(f"round(printf('%.6g', {f})::double, 9) as {f}" for f in FEATURES)
_LEXICAL = " union all ".join(f"select '{name}', {a}, {b}, printf('%.7f', c / {given})::double, null, null, null, null, null, null, null from lexicon" for name, a, b, given in (("lex.e2f", "s", "t", "c_f"), ("lex.f2e", "t", "s", "c_e")))
ORACLE_SQL: dict[str, str] = {
    "extracted_phrases": f"with {_sql_extracted(7)} select src, tgt, {_show('align')} as align, n from extracted",
    "trained_table": f"{_sql_trained(7)} select src, tgt, {_NINE}, align, c_t, c_s, c_st from trained",
    "cli_train": f"{_sql_trained(4)} select 'phrase-table' as file, src, tgt, {_SIX}, align, c_t, c_s, c_st from trained union all {_LEXICAL}",
}
