"""Alignment files and the corpora that they align."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasepivot.sources.files import numbered_lines, write_lines, write_text


@dataclass(frozen=True)
class AlignmentName:
    """corpus.pipe[.x].ali[.gz]: the pipe's first two letters are the source language, the next four at most the target."""

    corpus: str
    pipe: str

    @property
    def source(self) -> str:
        return self.pipe[:2]

    @property
    def target(self) -> str:
        return self.pipe[2:6]

    def corpora(self, folder: str) -> tuple[str, str]:
        return tuple(f"{folder.rstrip('/')}/{self.corpus}.{lang}.tok.gz" for lang in (self.source, self.target))


def parse_alignment_name(path: str) -> AlignmentName:
    parts = path.rsplit("/", 1)[-1].split(".")
    if len(parts) < 3:
        raise ValueError(f"{path}: the name has fewer than three parts")
    if "ali" not in parts[-2:]:
        raise ValueError(f"{path}: the name doesn't end in .ali or .ali.gz")
    return AlignmentName(parts[0], parts[1])


def alignment_name_columns(path: Column) -> dict[str, Column]:
    """The same of a column: corpus, pipe, source, target; null where the name is none."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"\.")
    good = (F.size(parts) >= 3) & F.array_contains(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "ali")
    pipe = F.get(parts, F.lit(1))
    return {k: F.when(good, v) for k, v in {"corpus": parts[0], "pipe": pipe, "source": F.substring(pipe, 1, 2), "target": F.substring(pipe, 3, 4)}.items()}


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Column value, in the file's order: the part of each line before the first tab."""
    return numbered_lines(spark, path).orderBy("n").select(F.split("value", "\t")[0].alias("value"))


def training_arguments(folder: str, model: str) -> list[str]:
    """Arguments of the trainer that makes a phrase table of a prepared folder; options and values are the trainer's
    fixed values."""
    return [
        "--force-factored-filenames", "--first-step", "4", "--last-step", "6", "--root-dir", model, f"--alignment-file={folder}/alignment", "--alignment=custom",
        f"--corpus={folder}/corpus", "--f", "src", "--e", "tgt", "--translation-factors", "0-0", "--decoding-steps", "t0",
    ]


def prepare_training(spark: SparkSession, path: str, out: str, single_file: bool = True) -> AlignmentName:
    """Writes what a phrase table trainer reads: the alignments' first column and both sides' texts, packed, in their
    order, and train.args, the trainer's arguments, one in a line, for an outside trainer; plans.training has our own.

    single_file: files as it reads them; else directories of parts."""
    name = parse_alignment_name(path)
    folder, to = path.rsplit("/", 1)[0] if "/" in path else ".", f"{out.rstrip('/')}/{name.pipe}"
    write_lines(read_alignment(spark, path), f"{to}/alignment.custom.gz", single_file)
    for side, corpus in zip(("src", "tgt"), name.corpora(folder)):
        write_lines(numbered_lines(spark, corpus).orderBy("n").select("value"), f"{to}/corpus.{side}.gz", single_file)
    write_text(spark, f"{to}/train.args", "\n".join(training_arguments(to, f"{out.rstrip('/')}/model.{name.pipe}.{name.corpus}")) + "\n")
    return name
