"""Which repositories run the scan in CI, and which could."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.fixed import STANDARD_WORKFLOW, WORKFLOW_DIR, WORKFLOW_MARKER
from duskwatch.functions.remotes import github_remote, remote_hosts
from duskwatch.sources.files import of_kind


def coverage_audit(
    files: DataFrame,
    repos: DataFrame,
    marker: str = WORKFLOW_MARKER,
    standard: str = STANDARD_WORKFLOW,
) -> DataFrame:
    """``(repo, outcome, host, workflow, ours)`` for every repository of ``repos``.

    ``not-git``; ``non-github`` when remotes exist and none is GitHub (first host reported);
    ``already`` when a workflow is the standard one or contains ``marker``; else ``eligible``.
    Each file is judged where it is read; one aggregation per repository moves flags only.
    """
    path, content = F.col("path"), F.col("content")
    at_git = (path == ".git") | F.startswith(path, F.lit(".git/"))
    in_workflows = F.startswith(path, F.lit(WORKFLOW_DIR + "/"))
    chosen = of_kind(files, "git", "workflow", "other").filter(at_git | in_workflows)
    hosts = F.when(path == ".git/config", remote_hosts(content))
    is_yaml = path.rlike(r"^\.github/workflows/[^/]+\.[yY][aA]?[mM][lL]\z")
    runs_scan = is_yaml & F.contains(content, F.lit(marker))
    flags = chosen.select(
        "repo",
        at_git.alias("git"),
        F.coalesce(F.get(hosts, F.lit(0))).alias("host"),
        F.coalesce(
            F.exists(hosts, lambda h: F.contains(h, F.lit("github"))), F.lit(False)
        ).alias("github"),
        (path == standard).alias("ours"),
        F.when(runs_scan, path).alias("workflow"),
        F.when(path == ".git/config", github_remote(content)).alias("remote"),
        F.lit(False).alias("listed"),
    )
    blank = repos.select("repo").withColumns({
        "git": F.lit(False), "host": F.lit(None).cast("string"), "github": F.lit(False),
        "ours": F.lit(False), "workflow": F.lit(None).cast("string"),
        "remote": F.lit(None).cast("struct<owner:string,repo:string>"), "listed": F.lit(True),
    })
    per_repo = flags.unionByName(blank).groupBy("repo").agg(
        F.bool_or("git").alias("git"), F.min("host").alias("host"),
        F.bool_or("github").alias("github"), F.bool_or("ours").alias("ours"),
        F.min("workflow").alias("workflow"), F.min("remote").alias("remote"),
        F.bool_or("listed").alias("listed"),
    ).filter("listed")
    foreign = F.col("host").isNotNull() & ~F.col("github")
    found = F.when(F.col("ours"), standard).otherwise(F.col("workflow"))
    outcome = (
        F.when(~F.col("git"), "not-git").when(foreign, "non-github")
        .when(found.isNotNull(), "already").otherwise("eligible")
    )
    return per_repo.select(
        "repo", outcome.alias("outcome"), F.when(foreign, F.col("host")).alias("host"),
        found.alias("workflow"), F.col("ours"),
        F.col("remote.owner").alias("owner"), F.col("remote.repo").alias("name"),
    )


def lacking_scan(audit: DataFrame) -> DataFrame:
    """Git repositories no workflow of which runs the scan."""
    return audit.filter("outcome <> 'not-git' and workflow is null").select("repo", "outcome")
