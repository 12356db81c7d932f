"""Registered queries that go through files and the command line, and the same in SQL.

They write the derived tables, corpora and alignments to a folder of their own in the shared one and read them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasepivot.cli import main
from phrasepivot.functions.columns import line_key, show_alignment
from phrasepivot.operators.bridge import MODES, pivot_first
from phrasepivot.operators.lexicon import build_lexicon
from phrasepivot.plans.catalog import scan_corpora
from phrasepivot.plans.triangulate import Plan
from phrasepivot.queries import _A, _A_ROWS, _FILES, _FIRST, _bridged, _corpus_files, _read, _shown, _show, _sql_bridge, _sql_features, _sql_lexicon, _sql_pivots, source_table, target_table
from phrasepivot.schema import COUNTS, FEATURES
from phrasepivot.sources.alignments import parse_alignment_name
from phrasepivot.sources.files import names, numbered_lines, work_folder, write_lines, write_text
from phrasepivot.sources.listing import create_empty
from phrasepivot.sources.part_index import lookup, write_indexed
from phrasepivot.sources.phrase_table import read_lexical, read_lexical_counts, read_phrase_table, resolve_model, sort_out, write_lexical, write_phrase_table


def files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as a plain file, as a packed file of a model directory, and as parts, each written by four tasks, and read
    again; numbers keep six digits."""
    folder, table, out = work_folder(spark), source_table(spark, sf_dir), None
    for kind, path, read, single in (("plain", "t.txt", "t.txt", True), ("model", "m/model/phrase-table.gz", "m", True), ("parts", "p/model/phrase-table", "p", False)):
        write_phrase_table(table, f"{folder}/{path}", 4, single, 4)
        rows = _shown(read_phrase_table(spark, f"{folder}/{read}")).select(F.lit(kind).alias("kind"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def written_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each line of a packed file that four tasks wrote: byte order of its phrases."""
    path = f"{work_folder(spark)}/t.gz"
    write_phrase_table(source_table(spark, sf_dir), path, writers=4)
    return numbered_lines(spark, path).select("n", F.substring_index("value", " ||| ", 2).alias("phrases"))


def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table, some of them spoilt by their counts, sorted out: rows that are sound, and reasons of all others."""
    table = source_table(spark, sf_dir).withColumn("spoilt", (F.col("c_st") % 10).cast("int"))
    line = lambda *fields: F.concat_ws(" ||| ", *(F.lit(f) if f not in ("src", "tgt") else F.col(f) for f in fields))
    rest = F.concat_ws(" ||| ", "tgt", F.concat_ws(" ", *(F.round(f, 6).cast("string") for f in FEATURES)), show_alignment(F.col("align")), F.concat_ws(" ", *(F.col(c).cast("string") for c in COUNTS)))
    value = F.concat_ws(" ||| ", "src", rest)
    cases = {
        1: line("src", "tgt"), 2: F.concat(F.lit(" ||| "), rest), 3: F.replace(value, F.lit(" ||| 0-"), F.lit(" ||| 9-")), 4: line("src", "tgt", "0.5 0.5 x 0.5", "", "1 1"),
        5: line("src", "tgt", "2 1 1 1", "0-0", "1 1"), 6: line("src", "tgt", "1 1 1 1", "0-0", "1"),
    }
    spoilt = value
    for case, text in cases.items():
        spoilt = F.when(F.col("spoilt") == case, text).otherwise(spoilt)
    rows, bad = sort_out(table.select(spoilt.alias("value")), sound=True)
    kept = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(F.lit("row").alias("kind"), F.col("src").alias("what"), "n")
    return kept.unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("quarantine").alias("kind"), F.col("reason").alias("what"), "n"))


def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table in eight indexed parts, by the names of some parts of the catalogue and by names that it lacks."""
    path, table = f"{work_folder(spark)}/table", source_table(spark, sf_dir)
    write_indexed(table, path, 8)
    asked = _read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x"))).alias("src"))
    return _shown(lookup(spark, path, asked))


def lexical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lexical files, read again."""
    folder = work_folder(spark)
    write_lexical(build_lexicon(_bridged(spark, sf_dir)), f"{folder}/t", "lex")
    out = None
    for name in ("e2f", "f2e"):
        p = read_lexical(spark, f"{folder}/lex.{name}").select(F.lit(name).alias("file"), "w1", "w2", F.round("p", 7).alias("p"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("n"))
        c = read_lexical_counts(spark, f"{folder}/lex.count.{name}").select(F.lit(f"count.{name}").alias("file"), "w1", "w2", F.lit(None).cast("double").alias("p"), "c", "n")
        out = p.unionByName(c) if out is None else out.unionByName(p).unionByName(c)
    return out


def _both_tables(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Files of both derived tables whose numbers are shown in full, as six digits would change the sums."""
    folder = work_folder(spark)
    for name, table in (("s.gz", source_table(spark, sf_dir)), ("t", target_table(spark, sf_dir))):
        points = F.array_join(F.transform("align", lambda p: F.concat_ws("-", p.s.cast("string"), p.t.cast("string"))), " ")
        value = F.concat_ws(" ||| ", "src", "tgt", F.concat_ws(" ", *(F.col(f).cast("string") for f in FEATURES)), points, F.concat_ws(" ", *(F.col(c).cast("string") for c in COUNTS)))
        write_lines(table.orderBy(line_key()).select(value.alias("value")), f"{folder}/{name}")
    return f"{folder}/s", f"{folder}/t"


def cli_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line from two files, one packed, to a packed one with lexical files beside it."""
    s, t = _both_tables(spark, sf_dir)
    folder = s.rsplit("/", 1)[0]
    main(["triangulate", "features_based", "-s", s, "-t", t, "-m", "pspt", "-o", f"{folder}/out.gz", "-l", "lex", "--partitions", "4", "--writers", "3"])
    counts = read_lexical_counts(spark, f"{folder}/lex.count.f2e").agg(F.sum("c").alias("words")).withColumn("words", F.col("words").cast("long"))
    return _shown(read_phrase_table(spark, f"{folder}/out.gz")).crossJoin(F.broadcast(counts))  # one row


def _corpora(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the listing of documents as empty files, which tasks make."""
    root = work_folder(spark)
    create_empty(_corpus_files(spark, sf_dir).select("file"), root)
    return root


def corpora_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two levels of a folder of corpora."""
    root = _corpora(spark, sf_dir)
    return scan_corpora(spark, root).select("dir", F.substring("file", len(root) + 2, 1 << 20).alias("file"))


def cli_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report that the command line writes, without the folder's own name."""
    root = _corpora(spark, sf_dir)
    out = f"{work_folder(spark)}/report"
    main(["catalog", "-s", "en", "-t", "fr", "-c", root, "-o", out])
    return numbered_lines(spark, out).select("n", F.replace("value", F.lit(f"{root}/"), F.lit("")).alias("line"))


def cli_decoder_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder's configuration over a model directory for each region and one table that is named itself."""
    root, models = work_folder(spark), []
    for r in sorted(r[0] for r in _read(spark, sf_dir, "region").select("r_name").collect()):
        write_text(spark, f"{root}/{r}/model/phrase-table.gz", "")
        write_text(spark, f"{root}/{r}/model/other", "")
        models.append(f"{root}/{r}")
    main(["decoder-config", "-TMS", ":".join([f"{root}/main/phrase-table", *models]), "-o", f"{root}/ini"])
    return numbered_lines(spark, f"{root}/ini").select("n", F.replace("value", F.lit(f"{root}/"), F.lit("")).alias("line"))


def cli_prepare_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trainer's inputs from an alignment file of three columns and two corpora: file, n, line."""
    root = work_folder(spark)
    nation = _read(spark, sf_dir, "nation").orderBy("n_nationkey")
    for name, value in (("C.encs.ali.gz", F.concat(F.col("n_nationkey").cast("string"), F.lit("-0\t"), "n_name", F.lit("\tx"))), ("C.en.tok.gz", F.lower("n_name")), ("C.cs.tok.gz", F.concat(F.col("n_regionkey").cast("string"), F.lit(" "), "n_name"))):
        write_lines(nation.select(value.alias("value")), f"{root}/{name}")
    main(["prepare-alignment", f"{root}/C.encs.ali.gz", f"{root}/out"])
    pipe = parse_alignment_name(f"{root}/C.encs.ali.gz").pipe
    out = numbered_lines(spark, f"{root}/C.encs.ali.gz").select(F.lit("source").alias("file"), "n", F.split("value", "\t")[0].alias("line"))
    for name, _ in names(spark, f"{root}/out/{pipe}"):
        if name.startswith("_"):  # an index of members
            continue
        rows = numbered_lines(spark, f"{root}/out/{pipe}/{name}")
        out = out.unionByName(rows.select(F.lit(name).alias("file"), "n", F.replace("value", F.lit(f"{root}/"), F.lit("")).alias("line")))
    return out


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, of options that the orders and customers name: guard, value, error (none if it is taken), orders."""
    table = source_table(spark, sf_dir)
    folder = work_folder(spark)
    for kind in ("AUTOMOBILE/model/phrase-table", "BUILDING"):
        write_text(spark, f"{folder}/{kind}", "")
    asked = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    modes = F.array(*(F.lit(m) for m in (*MODES, "xxxx", "")))
    options = {
        "mode": (F.get(modes, (F.col("o_orderkey") % 6).cast("int")), lambda x: pivot_first(table, table, x)), "action": (F.concat("o_orderstatus", F.lit("_based")), lambda x: Plan(x.replace("O_", "counts_").replace("F_", "features_"), "pspt")),
        "path": (F.col("c_mktsegment"), lambda x: resolve_model(spark, f"{folder}/{x}")), "name": (F.concat(F.lit("c."), F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 2 == 0, ".ali").otherwise(".txt")), parse_alignment_name),
    }
    out = None
    for guard, (value, call) in options.items():
        rows = asked.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        errors = {}
        for r in rows.select("value").collect():  # a handful of options
            try:
                call(r.value)
                errors[r.value] = "none"
            except (ValueError, TypeError, OSError) as e:
                errors[r.value] = type(e).__name__
        told = spark.createDataFrame(list(errors.items()), "value string, error string")
        rows = rows.join(told, "value").select(F.lit(guard).alias("guard"), "value", "error", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (files_roundtrip, written_order, quarantined_lines, indexed_lookup, lexical_files, cli_triangulate, corpora_scan, cli_catalog, cli_decoder_config, cli_prepare_alignment, guards)}

# ---- the same in SQL ----------------------------------------------------------------

_SIX = ", ".join(f"round(printf('%.6g', {f})::double, 9) as {f}" for f in FEATURES)
_LEX = [("e2f", "t", "s", "c_e"), ("f2e", "s", "t", "c_f")]
_LEX_ROWS = " union all ".join(
    f"select '{n}' as file, {a} as w1, {b} as w2, printf('%.7f', c / {g})::double as p, null::bigint as c, null::bigint as n from lexicon where {g} > 0 union all select 'count.{n}', {a}, {b}, null, c::bigint, {g}::bigint from lexicon where {g} > 0"
    for n, a, b, g in _LEX
)
_MERGED = _sql_features("sum").rsplit(" select src, tgt", 1)[0]


def _tree(*rows: tuple[str, str, str, str]) -> str:
    """Rows (sort key as a list of strings, level, mark, text as SQL, from clause) as one select."""
    return " union all ".join(f"select {key} as k, {level} as level, {mark} as mark, {text}" for key, level, mark, text in rows)


_PAIRS = f"select *, row_number() over (order by dir, group_id) as i from (select dir, group_id, {_FIRST.format(chr(39) + 'en' + chr(39))} as a, {_FIRST.format(chr(39) + 'fr' + chr(39))} as b from groups where len(langs) > 1) where a is not null and b is not null"
_REPORT = f"""{_sql_pivots('en', 'fr').rsplit('select pvt, side', 1)[0].rstrip()},
pivots as (select pvt, side, dir, group_id, file_pvt, file_other, row_number() over (partition by pvt, side order by dir, group_id) as i from kept where pvt in (select pvt from kept group by pvt having count(distinct side) = 2)),
mono as (select distinct kind, file from (select case when len(langs) = 1 then 'mono' else 'multi' end as kind, unnest(files) as file, group_id from groups)),
listed_mono as (select kind, file, row_number() over (order by kind, file) as i from (select case when len(langs) = 1 then 'mono' else 'multi' end as kind, unnest(files) as file from groups) where ends_with(file, '.fr')),
pairs as ({_PAIRS}),
sides as (select distinct pvt, side, case side when 'src' then 'SRC' else 'TGT' end as label, case side when 'src' then 'en' else 'fr' end as lang from pivots),
tree as ({_tree(
    ("[1, 0]", "0", "'+-'", "'Corpora for LM' as text"), ("[1, 1]", "1", "'|'", "'LANG=fr'"),
    ("[1, 2]", "1", "'+-'", "'Monolingual Corpora in monolingual sources'"), ("[1, 3]", "1", "'+-'", "'Monolingual Corpora in multilingual sources'"),
    ("[2, 0]", "0", "'+-'", "'Corpora for TM'"), ("[2, 1]", "1", "'|'", "'SRC=en'"), ("[2, 2]", "1", "'|'", "'TGT=fr'"),
    ("[2, 3]", "1", "'+-'", "'parallel corpora'"), ("[2, 4]", "1", "'+-'", "'Pivot corpora'"),
    ("[1, case kind when 'mono' then 2 else 3 end, i]", "2", "'|'", "file from listed_mono"),
    ("[2, 3, i]", "2", "'+-'", "'Pair: ' || i from pairs"), ("[2, 3, i, 1]", "3", "'|'", "'SRC=' || a from pairs"), ("[2, 3, i, 2]", "3", "'|'", "'TGT=' || b from pairs"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:])]", "2", "'+-'", "'Pivot: ' || pvt from (select distinct pvt from sides)"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:]), ascii(label), 0]", "3", "'+-'", "label || '=' || lang || '-PVT=' || pvt from sides"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:]), ascii(label), 0, 1]", "4", "'|'", "label || '=' || lang from sides"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:]), ascii(label), 0, 2]", "4", "'|'", "'PVT=' || pvt from sides"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:]), ascii(label), i]", "4", "'+-'", "'Pair: ' || i from pivots join sides using (pvt, side)"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:]), ascii(label), i, case side when 'src' then 1 else 2 end]", "5", "'|'", "label || '=' || file_other from pivots join sides using (pvt, side)"),
    ("[2, 4, ascii(pvt) * 1000 + ascii(pvt[2:]), ascii(label), i, case side when 'src' then 2 else 1 end]", "5", "'|'", "'PVT=' || file_pvt from pivots join sides using (pvt, side)"),
)})
select row_number() over (order by k) as n, case when level = 0 then '' else repeat('|  ', level) end || mark || ' ' || text as line from tree"""

_INI = """with paths as (select 0 as i, 'main/phrase-table' as path union all select row_number() over (order by r_name), r_name || '/model/phrase-table.gz' from region),
many as (select max(i) as top from paths),
ini as (select [0, 0, i] as k, '# ' || path as line from paths union all select [b, 0, 0], '' from range(1, 7) as r(b)
  union all select [b, 1, 0], '[' || x || ']' from (values (1, 'input-factors'), (2, 'mapping'), (3, 'decoding-graph-backoff'), (4, 'distortion-limit'), (5, 'feature'), (6, 'weight')) as s(b, x)
  union all select [b, 2, i], x from (values (1, 0, '0'), (1, 1, '1'), (3, 0, '0'), (3, 1, '1'), (4, 0, '6'), (5, 0, 'Distortion'), (5, 1, 'KENLM lazyken=0 name=LM0 factor=0 path=lm.gz order=4'), (6, 0, 'Distortion0= 0.3'), (6, 1, 'LM0= 0.5'), (6, 2, 'PhrasePenalty0= 0.2')) as v(b, i, x)
  union all select [2, 2, i], least(i, 1) || ' T ' || i from paths
  union all select [5, 2, 2 + i], 'PhraseDictionaryMemory name=TranslationModel' || i || ' num-features=4 path=' || path || ' input-factor=0 output-factor=0 table-limit=20' from paths
  union all select [5, 3, i], x from (values (0, 'PhrasePenalty'), (1, 'UnknownWordPenalty'), (2, 'WordPenalty')) as v(i, x)
  union all select [6, 2, 3 + i], 'TranslationModel' || i || '= 0.2 0.2 0.2 0.2' from paths
  union all select [6, 3, i], x from (values (0, 'UnknownWordPenalty0= 1'), (1, 'WordPenalty= -1')) as v(i, x))
select row_number() over (order by k) as n, line from ini"""

_ARGS = "--force-factored-filenames --first-step 4 --last-step 6 --root-dir out/model.encs.C --alignment-file=out/encs/alignment --alignment=custom --corpus=out/encs/corpus --f src --e tgt --translation-factors 0-0 --decoding-steps t0"

ORACLE_SQL: dict[str, str] = {
    "files_roundtrip": f"with {_A}, t as ({_A_ROWS}) select kind, src, tgt, {_SIX}, align, c_t, c_s, c_st from t, (values ('plain'), ('model'), ('parts')) as k(kind)",
    "written_order": f"with {_A} select row_number() over (order by encode(pvt || ' ||| ' || phrase || ' ||| ')) as n, pvt || ' ||| ' || phrase as phrases from a",
    "lexical_files": f"{_sql_bridge()},\n{_sql_lexicon()} select * from ({_LEX_ROWS})",
    "cli_triangulate": f"{_MERGED},\n{_sql_lexicon()} select src, tgt, {_SIX}, {_show('align')} as align, c_t, c_s, c_st, (select sum(c::bigint)::bigint from lexicon where c_f > 0) as words from full_table",
    "corpora_scan": f"with {_FILES} select distinct dir, dir || '/f' || lpad(n, 9, '0') || '.' || lang as file from files_0",
    "cli_catalog": _REPORT,
    "cli_decoder_config": _INI,
    "cli_prepare_alignment": f"""select 'source' as file, n_nationkey + 1 as n, n_nationkey || '-0' as line from nation union all select 'alignment.custom.gz', n_nationkey + 1, n_nationkey || '-0' from nation
union all select 'corpus.src.gz', n_nationkey + 1, lower(n_name) from nation union all select 'corpus.tgt.gz', n_nationkey + 1, n_regionkey || ' ' || n_name from nation
union all select 'train.args', i, x[i] from (select string_split('{_ARGS}', ' ') as x), range(1, 20) as r(i) where i <= len(x)""",
    "guards": """with asked as (select * from orders join customer on o_custkey = c_custkey),
said as (select 'mode' as guard, ['pspt', 'sppt', 'pstp', 'sptp', 'xxxx', ''][o_orderkey % 6 + 1] as value from asked union all select 'action', o_orderstatus || '_based' from asked
  union all select 'path', c_mktsegment from asked union all select 'name', 'c.' || o_orderpriority[1:1] || case when o_orderkey % 2 = 0 then '.ali' else '.txt' end from asked)
select guard, value, case guard when 'mode' then case when value in ('xxxx', '') then 'ValueError' else 'none' end when 'action' then case when value in ('O_based', 'F_based') then 'none' else 'ValueError' end
  when 'path' then case when value in ('AUTOMOBILE', 'BUILDING') then 'none' else 'TypeError' end else case when ends_with(value, '.ali') then 'none' else 'ValueError' end end as error, count(*) as n from said group by all""",
    "indexed_lookup": f"with {_A}, t as ({_A_ROWS}) select src, tgt, {', '.join(f'round({f}, 9) as {f}' for f in FEATURES)}, align, c_t, c_s, c_st from t where src in (select p_name from part where p_partkey % 6 = 0)",
    "quarantined_lines": f"""with {_A}, t as (select *, c % 10 as spoilt, list_transform(align, lambda p: p.s) as s from a),
said as (select pvt, case when spoilt = 1 then 'fewer than five fields' when spoilt = 2 then 'an empty phrase' when spoilt = 3 and s[1] = 0 then 'a point beyond the words' when spoilt = 4 then 'a feature is no number' when spoilt = 5 then 'a feature is no probability' when spoilt = 6 then 'fewer than two counts' end as reason from t)
select 'row' as kind, pvt as what, count(*) as n from said where reason is null group by all union all select 'quarantine', reason, count(*) from said where reason is not null group by all""",
}
