"""Version history: a log dump, one commit header a line with its changed files after it, as rows.

The log is (repo, record, n, line): a record is a commit's header and what follows it, n the place of a line in it, and
records count from the newest. So a repository however long is as many small groups as it has commits."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import is_security_fix

FORMAT = "%H|%P|%aN|%aE|%aI|%s"


HEAD = r"^[0-9a-f]{40}\|(?:[^|]*\|){4}"


def dump(repo: str, since: str | None = None, limit: int | None = None) -> str:
    """The log of a repository on this machine, in the form that lines_of() reads; empty where git fails."""
    cut = [f"--max-count={limit}"] if limit is not None else []
    cmd = ["git", "-C", repo, "log", *cut, f"--format={FORMAT}", "--numstat", *([f"{since}..HEAD"] if since else [])]
    done = subprocess.run(cmd, capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else ""


def lines_of(spark: SparkSession, text: str, repo: str = "") -> DataFrame:
    """(repo, record, n, line) of a log text; lines before the first header belong to no commit."""
    rows, record, n = [], 0, 0
    for line in text.split("\n"):
        if re.match(HEAD, line.strip()):
            record, n = record + 1, 0
        rows.append((repo, record, n, line))
        n += 1
    return spark.createDataFrame(rows, "repo string, record long, n long, line string")


def _marked(lines: DataFrame) -> DataFrame:
    """lines with head (whether a line is a commit's header) and hash, that of its record's header."""
    l = lines.withColumn("line", F.trim("line")).withColumn("head", F.col("line").rlike(HEAD))
    heads = l.filter("head").select("repo", "record", F.substring("line", 1, 40).alias("hash"))
    return l.join(heads, ["repo", "record"], "left")


def commits(lines: DataFrame) -> DataFrame:
    """(repo, hash, parents, author_name, author_email, date, message, record) of the log; a subject may hold bars."""
    p = F.split("line", r"\|", 6)
    h = _marked(lines).filter("head")
    return h.select("repo", "hash", F.filter(F.split(F.get(p, F.lit(1)), " "), lambda x: x != "").alias("parents"), F.get(p, F.lit(2)).alias("author_name"), F.get(p, F.lit(3)).alias("author_email"), F.get(p, F.lit(4)).alias("date"), F.substring(F.get(p, F.lit(5)), 1, 500).alias("message"), "record")


def numstat(lines: DataFrame) -> DataFrame:
    """(repo, hash, path, lines_added, lines_deleted); a count that is no number, as for binary files, is 0."""
    p = F.split("line", "\t")
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("int")).otherwise(0)
    s = _marked(lines).filter("NOT head AND hash IS NOT NULL").filter(F.size(p) >= 3)
    return s.select("repo", "hash", F.get(p, F.lit(2)).alias("path"), number(F.get(p, F.lit(0))).alias("lines_added"), number(F.get(p, F.lit(1))).alias("lines_deleted"))


def commit_nodes(lines: DataFrame) -> DataFrame:
    c, s = commits(lines), numstat(lines)
    t = s.groupBy("repo", "hash").agg(F.sum("lines_added").alias("total_insertions"), F.sum("lines_deleted").alias("total_deletions"), F.count("*").alias("files_changed"))
    zero = {k: 0 for k in ("total_insertions", "total_deletions", "files_changed")}
    return c.join(t, ["repo", "hash"], "left").fillna(zero).withColumn("is_security_fix", is_security_fix(F.col("message")))


def edges(lines: DataFrame) -> DataFrame:
    """AUTHORED_BY, PARENT, MODIFIED_IN, FIXED_BY and AFFECTS rows (src, dst, type, lines_added, lines_deleted)."""
    c, s = commits(lines), numstat(lines)
    none = F.lit(None).cast("int")
    me = F.concat(F.lit("commit:"), "hash")
    fix = c.filter(is_security_fix(F.col("message"))).select("repo", "hash")
    file, sec = F.concat(F.lit("file:"), "path"), F.concat(F.lit("secfix:"), "hash")
    parts = [
        c.select(me.alias("src"), F.concat(F.lit("author:"), "author_email").alias("dst"), F.lit("AUTHORED_BY").alias("type"), none.alias("lines_added"), none.alias("lines_deleted")),
        c.select(me.alias("src"), F.explode("parents").alias("p")).select("src", F.concat(F.lit("commit:"), "p").alias("dst"), F.lit("PARENT").alias("type"), none.alias("lines_added"), none.alias("lines_deleted")),
        s.select(file.alias("src"), me.alias("dst"), F.lit("MODIFIED_IN").alias("type"), "lines_added", "lines_deleted"),
        fix.select(sec.alias("src"), me.alias("dst"), F.lit("FIXED_BY").alias("type"), none.alias("lines_added"), none.alias("lines_deleted")),
        s.join(fix, ["repo", "hash"], "left_semi").select(sec.alias("src"), file.alias("dst"), F.lit("AFFECTS").alias("type"), none.alias("lines_added"), none.alias("lines_deleted")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def churn(lines: DataFrame) -> DataFrame:
    """(path, churn_count, last_modified): one pass over the log instead of one process a file."""
    c = commits(lines).select("repo", "hash", "date", (-F.col("record")).alias("ord"))
    return numstat(lines).join(c, ["repo", "hash"]).groupBy("path").agg(F.count("*").alias("churn_count"), F.max_by("date", "ord").alias("last_modified"))


def tags(repo: str) -> list[tuple[str, str, str]]:
    """(name, commit hash, date) of the tags of a repository on this machine; an annotated tag stands for its commit."""
    form = "%(refname:short)|%(objectname)|%(*objectname)|%(creatordate:iso-strict)"
    done = subprocess.run(["git", "-C", repo, "for-each-ref", f"--format={form}", "refs/tags"], capture_output=True, text=True, errors="replace")
    rows = [x.rsplit("|", 3) for x in done.stdout.splitlines()] if done.returncode == 0 else []
    return [(name, inner or own, date) for name, own, inner, date in rows]


def tag_rows(spark: SparkSession, found: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Tag nodes (id, name, hash, date), and TAGGED_AS edges (src, dst, type) from the commit to its tag."""
    t = spark.createDataFrame(found, "name string, hash string, date string").withColumn("id", F.concat(F.lit("tag:"), "name"))
    return t.select("id", "name", "hash", "date"), t.select(F.concat(F.lit("commit:"), "hash").alias("src"), F.col("id").alias("dst"), F.lit("TAGGED_AS").alias("type"))


def head(repo: str) -> str:
    """The hash that HEAD stands for; empty where there is none."""
    done = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""


def is_ancestor(repo: str, older: str, newer: str = "HEAD") -> bool:
    return bool(older) and subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", older, newer], capture_output=True).returncode == 0


URL = re.compile(r"^(?:https?|git|ssh)://|^git@")


def is_url(target: str) -> bool:
    return bool(URL.match(target)) or target.endswith(".git")


def repo_name(target: str) -> str:
    """The last part of a URL or path, without .git."""
    last = re.split(r"[/:\\]", target.rstrip("/\\"))[-1]
    return last.removesuffix(".git") or "repo"


def clone(url: str, to: str, branch: str | None = None, depth: int | None = None, seconds: int = 120) -> None:
    """Clones a repository to a folder of this machine; an error where git gives one or takes too long."""
    cmd = ["git", "clone", *(["--depth", str(depth)] if depth else []), *(["--branch", branch] if branch else []), "--", url, to]
    subprocess.run(cmd, check=True, capture_output=True, timeout=seconds)
