"""All front ends together: the rows of every source file, by its language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import brace_front, python_front

LANGUAGES = ("python", *brace_front.LANGUAGES)


def rows_of(path: str, language: str, text: str) -> list[tuple[str, str, str, str, str]]:
    """(kind, id, other, name, props as JSON) of a file; none if it cannot be read."""
    try:
        return python_front.rows_of(path, text) if language == "python" else brace_front.rows_of(path, language, text)
    except (ValueError, LookupError, RecursionError):
        return []


def extract(files: DataFrame) -> DataFrame:
    """(kind, id, other, name, props, path, seq) of files(path, text, language); seq orders the rows of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(*r, p, n) for p, g, t in zip(df["path"], df["language"], df["text"]) for n, r in enumerate(rows_of(p, g, t or ""))]
            yield pd.DataFrame(rows, columns=["kind", "id", "other", "name", "props", "path", "seq"])

    known = files.filter(F.col("language").isin(*LANGUAGES)).select("path", "language", "text")
    return known.mapInPandas(run, "kind string, id string, other string, name string, props string, path string, seq long")
