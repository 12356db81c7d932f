"""The engine's main plan: two phrase tables to one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from phrasepivot.operators.bridge import bridge, pivot_first
from phrasepivot.operators.lexicon import build_lexicon, with_lexical_weights
from phrasepivot.operators.merge import aligned_paths, estimated_probabilities, merge, with_marginals
from phrasepivot.operators.quality import Progress
from phrasepivot.schema import COUNTS, FEATURES
from phrasepivot.sources.files import numbered_lines, staged
from phrasepivot.sources.phrase_table import read_phrase_table, resolve_model, sort_out, write_lexical, write_phrase_table

ACTIONS = ("features_based", "counts_based")


@dataclass(frozen=True)
class Plan:
    """action: features_based merges the paths' features; counts_based estimates them anew from counts.

    weight: summation or maximization, of features_based.  counts: how a path's
    co-occurrence count comes from its sides'.  mode: see MODES.  hot_rows: see bridge."""

    action: str
    mode: str
    weight: str = "summation"
    counts: str = "min"
    swap_lexical: bool = False
    hot_rows: int | None = None

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"action is {self.action!r}, none of {', '.join(ACTIONS)}")

    def bridged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return bridge(*pivot_first(a, b, self.mode, self.swap_lexical), self.counts, self.hot_rows)

    def paths(self, bridged: DataFrame) -> DataFrame:
        """What table and build_lexicon read: aligned_paths, as a table.  Merge, marginals and word counts each read it
        anew, so that the pivots are joined once."""
        return staged(aligned_paths(bridged, self.weight if self.action == "features_based" else "occ"), "paths")

    def table(self, paths: DataFrame) -> DataFrame:
        """The merged table of paths, or of unmerged rows, which are then computed for each reading."""
        if self.action == "features_based":
            out = with_marginals(merge(paths, self.weight), paths)
        else:
            out = with_lexical_weights(estimated_probabilities(with_marginals(merge(paths, "occ"), paths)), build_lexicon(paths))
        return out.select("src", "tgt", *FEATURES, "align", *COUNTS)


def triangulate(spark: SparkSession, plan: Plan, source: str, target: str, output: str, lexical: str | None = None, number_of_features: int = 4, single_file: bool = True, partitions: int | None = None, progress: Progress | None = None, quarantine: str | None = None, writers: int | None = None) -> None:
    """Reads both tables, writes the bridged one and, if lexical names them, the lexical files.

    partitions: into how many parts the lines of each table are dealt before they are parsed, for packed files of one
    member, which are one task's work to read.  single_file: one file, or a directory of parts; both are written by all
    tasks, or by as many as writers says.
    progress: counts the rows of both tables, of the bridged one and of the output while they are read and written.
    quarantine: a directory for lines that are no phrase table rows, with their table and the reason; without it they fail the job."""
    watch = progress.watch if progress else lambda name, table: table
    tables = []
    for name, path in (("source", source), ("target", target)):
        if quarantine:
            rows, bad = sort_out(numbered_lines(spark, resolve_model(spark, path)))
            bad.select("n", "reason", "value").write.mode("overwrite").option("sep", "\t").csv(f"{quarantine}/{name}")
        else:
            rows = read_phrase_table(spark, path, partitions=partitions)
        tables.append(watch(name, rows))
    paths = plan.paths(watch("bridged", plan.bridged(*tables)))
    write_phrase_table(watch("merged", plan.table(paths)), output, number_of_features, single_file, writers)
    if lexical:
        write_lexical(build_lexicon(paths), output, lexical, single_file)
