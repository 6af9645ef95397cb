"""Advisories in the OSV format, one JSON document a file, as the snapshot that enrich.vulnerabilities() joins."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "vuln_id string, ecosystem string, package string, versions array<string>, ranges array<struct<introduced:string,fixed:string>>, summary string, severity string, severity_label string, aliases string"


def rows_of(text: str) -> list[tuple]:
    """A row for each affected package of a document; none for one that is no advisory."""
    try:
        d = json.loads(text)
        label = (d.get("database_specific") or {}).get("severity")
        score = next((s.get("score") for s in d.get("severity") or [] if s.get("score")), None)
        out = []
        for a in d.get("affected") or []:
            p = a.get("package") or {}
            spans = []
            for r in a.get("ranges") or []:
                if r.get("type") == "GIT":
                    continue
                low = None
                for e in r.get("events") or []:
                    if "introduced" in e:
                        low = e["introduced"]
                    elif "fixed" in e and low is not None:
                        spans.append({"introduced": low, "fixed": e["fixed"]})
                        low = None
                if low is not None:
                    spans.append({"introduced": low, "fixed": None})
            out.append((d["id"], p.get("ecosystem"), p.get("name"), a.get("versions") or [], spans, d.get("summary") or d.get("details"), score, label, ",".join(d.get("aliases") or [])))
        return [r for r in out if r[1] and r[2]]
    except (ValueError, KeyError, AttributeError, TypeError):
        return []


def advisories(files: DataFrame) -> DataFrame:
    """The snapshot of files(content); what cannot be read gives nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [r for c in df["content"] for r in rows_of(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["vuln_id", "ecosystem", "package", "versions", "ranges", "summary", "severity", "severity_label", "aliases"])

    return files.select("content").filter(F.col("content").isNotNull()).mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot of all JSON files under a folder."""
    return advisories(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path))
