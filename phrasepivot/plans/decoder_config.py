"""The configuration of a phrase decoder that backs off from a main table to others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from phrasepivot.sources.files import is_dir, names


@dataclass(frozen=True)
class TableEntry:
    name: str
    path: str
    features: int = 4
    input_factor: int = 0
    output_factor: int = 0
    limit: int = 20

    def line(self) -> str:
        keys = {"name": self.name, "num-features": self.features, "path": self.path, "input-factor": self.input_factor, "output-factor": self.output_factor, "table-limit": self.limit}
        return " ".join(["PhraseDictionaryMemory", *(f"{k}={v}" for k, v in keys.items())])


@dataclass(frozen=True)
class DecoderConfig:
    """tables: the main one first.  language_model: what its feature line says after the factor."""

    tables: Sequence[str]
    language_model: str = "path=lm.gz order=4"
    distortion_limit: int = 6
    table_options: dict = field(default_factory=dict)

    def entries(self) -> list[TableEntry]:
        return [TableEntry(f"TranslationModel{i}", p, **self.table_options) for i, p in enumerate(self.tables)]

    def sections(self) -> dict[str, list[str]]:
        """Section names, feature names and weights are the decoder's fixed values."""
        entries = self.entries()
        return {
            "input-factors": ["0", "1"],
            "mapping": [f"{min(i, 1)} T {i}" for i in range(len(entries))],
            "decoding-graph-backoff": ["0", "1"],
            "distortion-limit": [str(self.distortion_limit)],
            "feature": ["Distortion", f"KENLM lazyken=0 name=LM0 factor=0 {self.language_model}", *(e.line() for e in entries), "PhrasePenalty", "UnknownWordPenalty", "WordPenalty"],
            "weight": ["Distortion0= 0.3", "LM0= 0.5", "PhrasePenalty0= 0.2", *(f"{e.name}= {' '.join(['0.2'] * e.features)}" for e in entries), "UnknownWordPenalty0= 1", "WordPenalty= -1"],
        }

    def text(self) -> str:
        head = [f"# {p}" for p in self.tables]
        blocks = ["\n".join([f"[{name}]", *rows]) for name, rows in self.sections().items()]
        return "\n\n".join(["\n".join(head), *blocks]) + "\n"


def find_tables(spark: SparkSession, spec: str) -> list[str]:
    """Paths joined by colons; a model directory stands for each phrase table in its model folder."""
    out = []
    for path in spec.split(":"):
        folder = f"{path.rstrip('/')}/model"
        if "phrase-table" not in path and is_dir(spark, folder):
            out += [f"{folder}/{n}" for n, _ in names(spark, folder) if "phrase-table" in n]
        else:
            out.append(path)
    return out
