"""Checks of phrase tables, and counts of rows while jobs run."""

from __future__ import annotations

import contextlib
import sys
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phrasepivot.functions.columns import tokens


def points_out_of_range(table: DataFrame) -> DataFrame:
    """src, tgt, points: rows with alignment points beyond a phrase's words, and how many."""
    beyond = F.filter("align", lambda p: (p.s >= F.size(tokens(F.col("src")))) | (p.t >= F.size(tokens(F.col("tgt")))))
    return table.select("src", "tgt", F.size(beyond).cast("long").alias("points")).where("points > 0")


class Progress:
    """Counts the rows of tables in the job that reads or writes them, and tells how far jobs have come.

    A table's count is known when a job over it has ended; nothing is computed again for it."""

    def __init__(self):
        self._watched: dict[str, Observation] = {}

    def watch(self, name: str, table: DataFrame) -> DataFrame:
        self._watched[name] = Observation()
        return table.observe(self._watched[name], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """Rows by name; waits for the first job over each table."""
        return {name: o.get["n"] for name, o in self._watched.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, n."""
        return spark.createDataFrame(list(self.counts().items()), "stage string, n long")


@contextlib.contextmanager
def reported(spark: SparkSession, seconds: float = 10, out=None) -> Iterator[None]:
    """While it is open, writes a line for each running stage every so many seconds: tasks that are over, of how many."""
    over, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def tell() -> None:
        while not over.wait(seconds):
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    print(f"stage {stage}: {info.numCompletedTasks} of {info.numTasks} tasks", file=out or sys.stderr, flush=True)

    thread = threading.Thread(target=tell, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
