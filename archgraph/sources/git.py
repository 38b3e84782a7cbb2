"""Changed files from git (A14-A16). One repository's status is small, so it is read on the driver."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions.paths import git_status
from archgraph.operators.changes import merge_changes

CHANGE = "path string, status string"
#: Of a name for a point in time: the key of the recorded commit, and what stands in where none is recorded.
POINTS = {"last-commit": (None, "HEAD~1"), "last-session": ("last_sync_commit", "HEAD~1"), "last-sync": ("last_sync_commit", "HEAD~1"), "last-phase": ("phase_sync_commit", "HEAD~5")}


def _git(root: str, *args: str) -> str | None:
    """The output of a git command, null if it fails or git is missing."""
    try:
        return subprocess.run(["git", "-c", "core.quotePath=false", *args], cwd=root, capture_output=True, text=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def head(root: str) -> str | None:
    """The commit that is checked out, null outside of a repository."""
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def resolve_ref(since: str, meta: dict[str, str] | None = None) -> str:
    """The commit that ``since`` names: a recorded one by POINTS, what stands in for it, or ``since`` itself."""
    key, instead = POINTS.get(since, (None, since))
    return (meta or {}).get(key, instead) if key else instead


def changed_files(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path, status) between a commit and the working tree, untracked files left out.

    A committed status stands, but for files deleted since. A commit that git does not know leaves
    the uncommitted changes; a folder without git has none.
    """
    known = _git(root, "rev-parse", "--verify", ref + "^{commit}")
    diff = _git(root, "diff", "--name-status", "--no-renames", ref, "HEAD") if known else None
    lines = [x.split("\t", 1) for x in (diff or "").splitlines() if "\t" in x]
    tree = [(x[:2].strip(), x[3:]) for x in (_git(root, "status", "--porcelain", "-uno") or "").splitlines() if len(x) > 3]
    frame = lambda rows: spark.createDataFrame(rows, "code string, path string").select("path", git_status(F.col("code")).alias("status"))
    committed, open_ = frame([(c, p) for c, p in lines]), frame(tree)
    # only a deletion overrides what is committed
    rest = open_.filter("status <> 'deleted'").join(committed.select("path"), "path", "left_anti")
    return merge_changes(committed, open_.filter("status = 'deleted'").unionByName(rest.select("path", "status")))


def scope_to(changes: DataFrame, prefix: str) -> DataFrame:
    """The changes under a folder, their paths relative to it; all of them for an empty one. Segment boundaries count."""
    prefix = prefix.strip("/")
    if prefix in ("", "."):
        return changes
    here = changes.filter((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))
    return here.withColumn("path", F.when(F.col("path") == prefix, F.col("path")).otherwise(F.substring("path", len(prefix) + 2, 1 << 30)))


def project_prefix(root: str) -> str:
    """The folder of a project within its repository; empty at its top and outside of one."""
    top = _git(root, "rev-parse", "--show-toplevel")
    if not top:
        return ""
    rel = os.path.relpath(os.path.realpath(root), os.path.realpath(top.strip())).replace(os.sep, "/")
    return "" if rel == "." or rel.startswith("..") else rel
