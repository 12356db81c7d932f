"""Which corpora of a directory serve a language pair: alone, in parallel, or over pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasepivot.sources.files import numbered_rows, staged, write_lines
from phrasepivot.sources.listing import files_below

_LETTER = r"^\p{L}"


def scan_corpora(spark: SparkSession, root: str) -> DataFrame:
    """dir, file of every file two levels below root."""
    base = root.rstrip("/")
    return files_below(spark, base).select("dir", F.concat(F.lit(f"{base}/"), "dir", F.lit("/"), "name").alias("file"))


def corpus_groups(files: DataFrame) -> DataFrame:
    """dir, langs, group_id, files: runs of as many sorted files as the directory's name has languages (two
    letters each), whose suffixes are these in order.

    Directories and files that don't begin with a letter, and directories of odd length, are left out."""
    named = files.where(F.col("dir").rlike(_LETTER) & (F.length("dir") % 2 == 0) & F.element_at(F.split("file", "/"), -1).rlike(_LETTER))
    langs = F.transform(F.sequence(F.lit(1), F.length("dir"), F.lit(2)), lambda i: F.substr(F.col("dir"), i, F.lit(2)))
    listed = named.groupBy("dir").agg(F.array_sort(F.collect_list("file")).alias("all")).withColumn("langs", langs)
    n = F.size("langs")
    runs = F.when(F.size("all") >= n, F.transform(F.sequence(F.lit(1), F.size("all") - n + 1), lambda i: F.struct(i.alias("group_id"), F.slice("all", i, n).alias("files"))))
    each = listed.select("dir", "langs", F.explode(runs).alias("g")).select("dir", "langs", "g.*")
    return each.where(F.forall(F.zip_with("files", "langs", lambda f, x: f.endswith(F.concat(F.lit("."), x))), lambda ok: ok))


def languages(files: DataFrame) -> DataFrame:
    """lang: the distinct languages that directory names list."""
    named = files.select("dir").distinct().where(F.col("dir").rlike(_LETTER) & (F.length("dir") % 2 == 0))
    return named.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("dir"), F.lit(2)), lambda i: F.substr(F.col("dir"), i, F.lit(2)))).alias("lang")).distinct()


def undersized(files: DataFrame) -> DataFrame:
    """dir, files, languages of directories with fewer files than languages."""
    counted = files.where(F.col("dir").rlike(_LETTER) & (F.length("dir") % 2 == 0)).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    return counted.select("dir", "files", F.floor(F.length("dir") / 2).alias("languages")).where("files < languages")


def _of_language(files: Column, lang: Column) -> Column:
    return F.get(F.filter(files, lambda f: f.endswith(F.concat(F.lit("."), lang))), F.lit(0))


def monolingual(groups: DataFrame, lang: str) -> DataFrame:
    """kind (mono: of a directory of one language, or multi), file."""
    found = groups.select(F.when(F.size("langs") == 1, "mono").otherwise("multi").alias("kind"), F.explode("files").alias("file"))
    return found.where(F.col("file").endswith(f".{lang}"))


def bilingual(groups: DataFrame, source: str, target: str) -> DataFrame:
    """dir, file_a, file_b of every group that has both languages."""
    pairs = groups.where(F.size("langs") > 1).select("dir", "group_id", _of_language(F.col("files"), F.lit(source)).alias("file_a"), _of_language(F.col("files"), F.lit(target)).alias("file_b"))
    return pairs.where("file_a is not null and file_b is not null").select("dir", "group_id", "file_a", "file_b")


def pivot_corpora(groups: DataFrame, source: str, target: str) -> DataFrame:
    """pvt, side (src or tgt), dir, group_id, file_pvt, file_other, of pivots that both sides have corpora for.

    A directory serves one stage only: the pair itself, then pivots by name, the
    source's side before the target's."""
    pivots = groups.select(F.explode("langs").alias("pvt")).distinct().where(~F.col("pvt").isin(source, target))
    wide = groups.where(F.size("langs") > 1)
    stages = F.array(F.struct(F.lit("src").alias("side"), F.lit(source).alias("other")), F.struct(F.lit("tgt").alias("side"), F.lit(target).alias("other")))
    asked = wide.select("dir", "langs", "group_id", "files", F.explode("langs").alias("pvt")).join(pivots, "pvt", "left_semi").distinct()
    found = asked.withColumn("x", F.explode(stages)).select("dir", "group_id", "pvt", "x.side", _of_language(F.col("files"), F.col("pvt")).alias("file_pvt"), _of_language(F.col("files"), F.col("x.other")).alias("file_other")).where("file_pvt is not null and file_other is not null")
    used = bilingual(groups, source, target).select("dir").distinct()
    free = found.join(used, "dir", "left_anti")
    first = free.groupBy("dir").agg(F.min(F.struct("pvt", "side")).alias("first"))
    served = free.join(first, "dir").where((F.col("pvt") == F.col("first.pvt")) & (F.col("side") == F.col("first.side"))).drop("first")
    both = served.groupBy("pvt").agg(F.count_distinct("side").alias("n")).where("n = 2").select("pvt")
    return served.join(both, "pvt", "left_semi")


def _tree_rows(rows: DataFrame, *branches: tuple[list[Column | str], int, str, Column | str]) -> DataFrame:
    """key, level, mark, text: for each row one for each branch (key, level, mark, text)."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    made = [F.struct(F.array(*map(col, key)).alias("key"), F.lit(level).alias("level"), F.lit(mark).alias("mark"), col(text).alias("text")) for key, level, mark, text in branches]
    return rows.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def report_lines(groups: DataFrame, source: str, target: str, mono_language: str | None = None) -> DataFrame:
    """Column value: the tree of what was found, in order.

    Every line has a key, its branches from the root; lines are made where their rows are, and sorted by it."""
    groups = staged(groups, "groups")
    lang, place = mono_language or target, lambda n: F.lpad(F.col(n).cast("string"), 12, "0")
    fixed = _tree_rows(
        groups.sparkSession.range(1),
        (["1"], 0, "+-", "Corpora for LM"), (["1", "1"], 1, "|", f"LANG={lang}"), (["1", "2"], 1, "+-", "Monolingual Corpora in monolingual sources"), (["1", "3"], 1, "+-", "Monolingual Corpora in multilingual sources"),
        (["2"], 0, "+-", "Corpora for TM"), (["2", "1"], 1, "|", f"SRC={source}"), (["2", "2"], 1, "|", f"TGT={target}"), (["2", "3"], 1, "+-", "parallel corpora"), (["2", "4"], 1, "+-", "Pivot corpora"),
    )
    mono = _tree_rows(monolingual(groups, lang), (["1", F.when(F.col("kind") == "mono", "2").otherwise("3"), F.col("file")], 2, "|", F.col("file")))
    said = lambda label, c: F.concat(F.lit(f"{label}="), F.col(c))
    pair = F.concat(F.lit("Pair: "), F.col("n").cast("string"))
    pairs = numbered_rows(bilingual(groups, source, target), "dir", "group_id")
    at = ["2", "3", place("n")]
    pairs = _tree_rows(pairs, (at, 2, "+-", pair), ([*at, "1"], 3, "|", said("SRC", "file_a")), ([*at, "2"], 3, "|", said("TGT", "file_b")))
    out = fixed.unionByName(mono).unionByName(pairs)
    found = staged(pivot_corpora(groups, source, target), "pivots")
    pivots = found.select("pvt").distinct()
    out = out.unionByName(_tree_rows(pivots, (["2", "4", F.col("pvt")], 2, "+-", F.concat(F.lit("Pivot: "), F.col("pvt")))))
    for place_of, side, label, own in (("1", "src", "SRC", source), ("2", "tgt", "TGT", target)):
        at = ["2", "4", F.col("pvt"), place_of]
        head = F.concat(F.lit(f"{label}={own}-PVT="), F.col("pvt"))
        out = out.unionByName(_tree_rows(pivots, (at, 3, "+-", head), ([*at, "0", "1"], 4, "|", f"{label}={own}"), ([*at, "0", "2"], 4, "|", said("PVT", "pvt"))))
        rows = found.where(F.col("side") == side).withColumn("n", F.row_number().over(Window.partitionBy("pvt").orderBy("dir", "group_id")))
        at, other, pvt = [*at, "1", place("n")], said(label, "file_other"), said("PVT", "file_pvt")
        first, second = (other, pvt) if side == "src" else (pvt, other)
        out = out.unionByName(_tree_rows(rows, (at, 4, "+-", pair), ([*at, "1"], 5, "|", first), ([*at, "2"], 5, "|", second)))
    return out.orderBy("key").select(F.concat(F.repeat(F.lit("|  "), F.col("level")), "mark", F.lit(" "), "text").alias("value"))


def write_report(spark: SparkSession, root: str, source: str, target: str, output: str, mono_language: str | None = None) -> None:
    write_lines(report_lines(corpus_groups(scan_corpora(spark, root)), source, target, mono_language), output)
