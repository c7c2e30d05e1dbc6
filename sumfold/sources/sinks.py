"""What is written besides tables: join trees as Graphviz text, operator counts as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from sumfold.operators.factor import COUNTERS
from sumfold.plans.jointree import JoinForest


def write_dot(spark: SparkSession, forest: JoinForest, path: str) -> None:
    spark.createDataFrame([(line,) for line in forest.dot().split("\n")], "value string").coalesce(1).write.text(path)


def write_counts(spark: SparkSession, name: str, path: str) -> None:
    """Append a row (name, combines, projects) to the CSV files at ``path``."""
    row = [(name, COUNTERS.combines, COUNTERS.projects)]
    spark.createDataFrame(row, "name string, combines int, projects int").coalesce(1).write.mode("append").csv(path, header=True)


def text_table(headings: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A table as text; each row has as many cells as there are headings."""
    if any(len(r) != len(headings) for r in rows):
        raise ValueError("a row has not as many cells as there are headings")
    cells = [list(map(str, headings)), *[list(map(str, r)) for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(headings))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])
