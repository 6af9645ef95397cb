"""What is remembered between runs: manifests of extracted trees, the registry of repositories, cached answers.

Manifests are tables beside the store; the registry and the cache are small and live on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import change_set

VERSION = 1


@dataclass(frozen=True)
class Manifest:
    """files(path, hash, size, language) of a tree as it was extracted, its HEAD and the hash of its dependency manifests."""

    files: DataFrame
    head: str
    deps_hash: str


def save_manifest(files: DataFrame, path: str, head: str = "", deps_hash: str = "") -> None:
    """Writes a manifest; the one-row part with the version comes last, so half a manifest is none."""
    files.write.mode("overwrite").parquet(f"{path}/files")
    spark = files.sparkSession
    spark.createDataFrame([(VERSION, head, deps_hash)], "version int, head string, deps_hash string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest at a path; None if there is none, it cannot be read, or it has another version."""
    try:
        about = spark.read.parquet(f"{path}/about").first()
        files = spark.read.parquet(f"{path}/files")
    except Exception as e:  # noqa: BLE001
        if any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")):
            return None
        raise
    if about is None or about["version"] != VERSION or "hash" not in files.columns:
        return None
    return Manifest(files, about["head"], about["deps_hash"])


@dataclass(frozen=True)
class Changes:
    """changes(path, change), whether dependencies changed, and the HEADs before and after."""

    files: DataFrame
    deps_changed: bool
    head_before: str
    head_now: str

    def any(self) -> bool:
        return self.deps_changed or not self.files.limit(1).isEmpty()


def changes(old: Manifest, files: DataFrame, head: str = "", deps_hash: str = "") -> Changes:
    return Changes(change_set(old.files, files), bool(deps_hash) and deps_hash != old.deps_hash, old.head, head)


@dataclass
class Entry:
    name: str
    path: str
    store: str = ""
    languages: list[str] = field(default_factory=list)
    indexed_at: str = ""
    counts: dict[str, int] = field(default_factory=dict)


class Registry:
    """The repositories that have been extracted, by the last part of their path, in one JSON file."""

    def __init__(self, path: str):
        self.path, self.repos = path, {}
        try:
            with open(path, encoding="utf-8") as f:
                self.repos = {k: Entry(**v) for k, v in json.load(f)["repos"].items()}
        except (OSError, ValueError, KeyError, TypeError, AttributeError):  # none yet, or not readable: an empty one
            self.repos = {}

    def _save(self) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path + ".next", "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "repos": {k: asdict(v) for k, v in self.repos.items()}}, f, indent=1)
        os.replace(self.path + ".next", self.path)

    def register(self, path: str, store: str = "", languages: list[str] | None = None, counts: dict[str, int] | None = None) -> Entry:
        """Adds a repository, or replaces what was known of it."""
        real = os.path.realpath(path)
        e = self.repos[os.path.basename(real)] = Entry(os.path.basename(real), real, store, languages or [], time.strftime("%Y-%m-%dT%H:%M:%S"), counts or {})
        self._save()
        return e

    def unregister(self, name: str) -> bool:
        found = self.repos.pop(name, None) is not None
        if found:
            self._save()
        return found

    def get(self, name: str) -> Entry | None:
        return self.repos.get(name)

    def all(self) -> list[Entry]:
        return list(self.repos.values())

    def find_by_path(self, path: str) -> Entry | None:
        real = os.path.realpath(path)
        return next((e for e in self.repos.values() if e.path == real), None)


class Cache:
    """Answers by question and arguments, for `seconds`; when full, the oldest goes."""

    def __init__(self, seconds: float = 60, most: int = 128, clock=time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.held: dict[str, tuple[float, object]] = {}

    @staticmethod
    def key(name: str, arguments: dict) -> str:
        return hashlib.md5(f"{name}:{json.dumps(arguments, sort_keys=True)}".encode()).hexdigest()

    def get(self, name: str, arguments: dict) -> object | None:
        k = self.key(name, arguments)
        at, value = self.held.get(k, (float("-inf"), None))
        if self.clock() - at < self.seconds:
            return value
        self.held.pop(k, None)
        return None

    def put(self, name: str, arguments: dict, value: object) -> None:
        k = self.key(name, arguments)
        if k not in self.held and len(self.held) >= self.most:
            del self.held[min(self.held, key=lambda x: self.held[x][0])]
        self.held[k] = (self.clock(), value)


def deps_hash(files: DataFrame) -> str:
    """The hash over all dependency manifests of a scan; empty without any."""
    from loomgraph.sources.manifests import content_hash

    return content_hash(files).first()["hash"]


def changed_paths(c: Changes) -> tuple[DataFrame, DataFrame]:
    """(path) of files to read again, and (path) of files whose rows must go."""
    return c.files.filter(F.col("change") != "deleted").select("path"), c.files.filter(F.col("change") != "added").select("path")
