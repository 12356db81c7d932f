"""Command line: python -m phrasepivot.cli triangulate|catalog|decoder-config|prepare-alignment|train."""

from __future__ import annotations

import argparse
import contextlib
import sys
from collections.abc import Sequence

from phrasepivot.functions.columns import COUNT_FUNCTIONS
from phrasepivot.operators.bridge import MODES
from phrasepivot.operators.extraction import MAX_LENGTH
from phrasepivot.operators.quality import Progress, reported
from phrasepivot.plans.triangulate import ACTIONS, Plan, triangulate


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phrasepivot", description="Bridges phrase tables over a pivot language.")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("triangulate", help="two phrase tables to one")
    p.add_argument("action", choices=ACTIONS)
    p.add_argument("-s", dest="source", required=True, help="table of source and pivot: a file or a model directory")
    p.add_argument("-t", dest="target", required=True, help="table of pivot and target")
    p.add_argument("-m", "--mode", required=True, choices=list(MODES), help="order of the phrases in both tables")
    p.add_argument("-w", dest="weight", default="summation", choices=["summation", "maximization"], help="how features_based merges rows")
    p.add_argument("-co", dest="counts", default="min", choices=[k for k in COUNT_FUNCTIONS], help="co-occurrence count of a path")
    p.add_argument("-o", dest="output", default="-", help="output: a file, .gz, or - for stdout")
    p.add_argument("-l", dest="lexical", help="base name of lexical files beside the output")
    p.add_argument("-tmpdir", default=None, help="Spark's local folder")
    p.add_argument("--write-phrase-penalty", action="store_true", help="accepted; has no effect")
    p.add_argument("--number_of_features", type=int, default=4)
    p.add_argument("--swap-lexical", action="store_true", help="turning a table also turns its lexical weights")
    p.add_argument("--parts", action="store_true", help="write directories of part files, not single files")
    p.add_argument("--partitions", type=int, help="deal each table's lines into so many parts, for packed files without an index of members")
    p.add_argument("--writers", type=int, help="write the table by so many tasks; by default Spark chooses")
    p.add_argument("--hot-rows", type=int, help="split pivot phrases of more rows than about this on both sides")
    p.add_argument("--quarantine", help="directory for lines that are no table rows, with numbers and reasons; without it they fail the job")
    p.add_argument("--progress", action="store_true", help="tell on stderr how far jobs have come, and rows by stage")
    p = commands.add_parser("catalog", help="corpora for a language pair")
    p.add_argument("-s", dest="source", required=True)
    p.add_argument("-t", dest="target", required=True)
    p.add_argument("-c", dest="corpora", required=True, help="directory of corpus directories")
    p.add_argument("-o", dest="output", default="-")
    p.add_argument("--mono-language", help="language of the monolingual list; the target's if not given")
    p = commands.add_parser("decoder-config", help="configuration of a decoder over several tables")
    p.add_argument("-TMS", dest="tables", required=True, help="tables joined by colons, the main one first")
    p.add_argument("-o", dest="output", required=True)
    p.add_argument("--language-model", default="path=lm.gz order=4")
    p = commands.add_parser("prepare-alignment", help="a trainer's inputs from an alignment file")
    p.add_argument("alignment")
    p.add_argument("out")
    p = commands.add_parser("train", help="a phrase table and lexical files from an alignment file and its corpora")
    p.add_argument("alignment")
    p.add_argument("out")
    p.add_argument("--max-phrase-length", type=int, default=MAX_LENGTH)
    p.add_argument("--parts", action="store_true", help="write directories of part files, not single files")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("phrasepivot")
    if getattr(args, "tmpdir", None):
        builder = builder.config("spark.local.dir", args.tmpdir)
    spark = builder.getOrCreate()
    if args.command == "triangulate":
        plan = Plan(args.action, args.mode, args.weight, args.counts, args.swap_lexical, args.hot_rows)
        progress = Progress() if args.progress else None
        with reported(spark) if progress else contextlib.nullcontext():
            triangulate(spark, plan, args.source, args.target, args.output, args.lexical, args.number_of_features, not args.parts, args.partitions, progress, args.quarantine, args.writers)
        for name, n in progress.counts().items() if progress else ():
            print(f"{name}: {n} rows", file=sys.stderr)
    elif args.command == "catalog":
        from phrasepivot.plans.catalog import write_report

        write_report(spark, args.corpora, args.source, args.target, args.output, args.mono_language)
    elif args.command == "decoder-config":
        from phrasepivot.plans.decoder_config import DecoderConfig, find_tables
        from phrasepivot.sources.files import write_text

        write_text(spark, args.output, DecoderConfig(find_tables(spark, args.tables), args.language_model).text())
    elif args.command == "train":
        from phrasepivot.plans.training import train

        print(train(spark, args.alignment, args.out, args.max_phrase_length, not args.parts))
    else:
        from phrasepivot.sources.alignments import prepare_training

        prepare_training(spark, args.alignment, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
