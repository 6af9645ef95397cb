"""Compiler index files: a reader of the wire format for documents, occurrences, symbols and roles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.resolve import symbol_name


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        x = b[i]
        i += 1
        v |= (x & 0x7F) << shift
        if not x & 0x80:
            return v, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of one message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
            v, i = b[i : i + n], i + n
        else:
            raise ValueError(f"wire type {key & 7}")
        yield key >> 3, key & 7, v


def occurrences_of(data: bytes) -> Iterator[tuple[str, int, str, bool]]:
    """(file, line from 0, symbol, is_def) in the order of the index."""
    for n, _, doc in fields(data):
        if n != 2:
            continue
        path, found = "", []
        for k, _, v in fields(doc):
            if k == 1:
                path = v.decode()
            elif k == 2:
                found.append(v)
        for raw in found:
            place, symbol, roles = [], "", 0
            for k, kind, v in fields(raw):
                if k == 1 and kind == 2:
                    i = 0
                    while i < len(v):
                        x, i = _varint(v, i)
                        place.append(x)
                elif k == 1:
                    place.append(v)
                elif k == 2:
                    symbol = v.decode()
                elif k == 3:
                    roles = v
            if symbol and place:
                yield path, place[0], symbol, bool(roles & 1)


def occurrences(files: DataFrame) -> DataFrame:
    """(index, file, line, symbol, name, is_def, seq) of files(path, content) that are indexes; local symbols stay out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(p, *o, i) for p, c in zip(df["path"], df["content"]) for i, o in enumerate(occurrences_of(bytes(c)))]
            yield pd.DataFrame(rows, columns=["index", "file", "line", "symbol", "is_def", "seq"])

    o = files.select("path", "content").mapInPandas(run, "index string, file string, line int, symbol string, is_def boolean, seq long")
    return o.filter(~F.col("symbol").startswith("local ")).withColumn("name", symbol_name(F.col("symbol")))
