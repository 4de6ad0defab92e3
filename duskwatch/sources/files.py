"""The corpus ``files(repo, path, content, size)`` and the choice of files to scan."""

from __future__ import annotations

import os
import stat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.fixed import (
    DEFAULT_IGNORE_GLOBS,
    IGNORE_FILE,
    MANIFEST_ECOSYSTEMS,
    SOURCE_EXTENSIONS,
    WORKFLOW_DIR,
)
from duskwatch.functions import paths
from duskwatch.functions.globs import index_globs
from duskwatch.plans.joins import fits_broadcast, salted_join

# --- SRC-4: reading --------------------------------------------------------------------


_LISTED = "repo string, path string, size bigint"
_READ_CHUNK = 32 * 1024 * 1024
KINDS = ("manifest", "ignore", "git", "workflow", "source", "other")
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _walk(batches):
    """Regular files below each repository folder; links are not followed."""
    for batch in batches:
        for repo, top in zip(batch["repo"], batch["top"]):
            rows = []
            for folder, _, names in os.walk(top, onerror=None, followlinks=False):
                for name in names:
                    full = os.path.join(folder, name)
                    try:
                        found = os.lstat(full)
                    except OSError:
                        continue
                    if stat.S_ISREG(found.st_mode):
                        rows.append((repo, os.path.relpath(full, top), found.st_size))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["repo", "path", "size"])
                    rows = []
            yield pd.DataFrame(rows, columns=["repo", "path", "size"])


def _reader(root: str):
    def read(batches):
        for batch in batches:
            rows, held = [], 0
            for repo, path, size in zip(batch["repo"], batch["path"], batch["size"]):
                try:
                    with open(os.path.join(root, repo, path), "rb") as file:
                        text = file.read().decode("utf-8", "replace")
                except OSError:
                    continue
                rows.append((repo, path, text, size))
                held += size
                if held >= _READ_CHUNK:
                    yield pd.DataFrame(rows, columns=["repo", "path", "content", "size"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["repo", "path", "content", "size"])

    return read


def read_checkouts(
    spark: SparkSession, root: str, max_bytes: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Checkouts below ``root``, one folder per repository, on a file system all executors mount.

    Spark's own file sources skip every name that starts with a dot or an underscore, so neither
    ``__init__.py`` nor ``.git/config`` would be seen. Here folders are listed in parallel, one
    repository per row; the files found are spread evenly, then read. With ``max_bytes``, larger files
    are listed but not opened, manifests excepted; unreadable ones are left out.
    """
    if "://" in root:
        raise ValueError("store the corpus as a table (see write_corpus) to scan it from an object store")
    repos = [(e.name, e.path) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
    count = partitions or max(spark.sparkContext.defaultParallelism, len(repos) // 64)
    tops = spark.createDataFrame(repos, "repo string, top string").repartition(count, "repo")
    listed = tops.mapInPandas(_walk, _LISTED)
    manifest = paths.basename(F.col("path")).isin(*MANIFEST_ECOSYSTEMS)
    wanted = listed if max_bytes is None else listed.filter((F.col("size") <= max_bytes) | manifest)
    return wanted.repartition(count, "repo", "path").mapInPandas(_reader(root), "repo string, path string, content string, size bigint")


def balance(files: DataFrame) -> DataFrame:
    """Spread a corpus that came in fewer splits than there are cores; larger ones stay put.

    Looks at the number of splits only. Call it on a plain scan, before texts are worked on.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def file_kind(path: Column) -> Column:
    """What a path is to us: lets the side branches of a scan read their own partition only."""
    base = paths.basename(path)
    return (
        F.when(base.isin(*MANIFEST_ECOSYSTEMS), "manifest")
        .when(path == IGNORE_FILE, "ignore")
        .when(path == ".git/config", "git")
        .when(F.startswith(path, F.lit(WORKFLOW_DIR + "/")), "workflow")
        .when(paths.is_source(path), "source")
        .otherwise("other")
    )


def write_corpus(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a corpus partitioned by kind: the manifest branch then never opens source files.

    Kinds are few: their files are written side by side, so that no task sorts the texts it holds.
    """
    conf = files.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, str(len(KINDS)))
    try:
        files.withColumn("kind", file_kind(F.col("path"))).write.mode(mode).partitionBy("kind").parquet(path)
    finally:
        conf.set(_WRITERS, before)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    """Prune to some kinds where the corpus was stored by kind; otherwise leave it whole."""
    return files.filter(F.col("kind").isin(*kinds)) if "kind" in files.columns else files


# --- FLT-1..8: which files are scanned ---------------------------------------------------


def select_sources(
    files: DataFrame,
    include_deps: bool = False,
    ignore: tuple[str, ...] = (),
    registry_path: tuple[str, str] | None = None,
    extensions: tuple[str, ...] | None = SOURCE_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Source files a user can fix: path and size only, so the filters reach the scan.

    ``extensions=None`` accepts any extension; ``registry_path``, a pair (repo, path), names a custom
    registry that lies inside one repository and must not be scanned. ``max_bytes`` leaves larger files out; by default none are.
    """
    path = F.col("path")
    keep = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
    if extensions is not None:
        keep = keep & paths.is_source(path, extensions)
    if not include_deps:
        keep = keep & ~paths.in_dependency_dir(path) & ~paths.is_hidden(path)
    keep = keep & ~paths.matches_any_glob(path, (*DEFAULT_IGNORE_GLOBS, *ignore))
    if registry_path:
        keep = keep & ~((F.col("repo") == registry_path[0]) & (path == registry_path[1]))
    # The partition of sources holds the usual extensions outside hidden folders, and nothing else.
    covered = extensions is not None and set(extensions) <= set(SOURCE_EXTENSIONS) and not include_deps
    return (of_kind(files, "source") if covered else files).filter(keep)


# --- SRC-6, JOIN-6: each repository's own ignore file --------------------------------------


def indexed_globs(rows: DataFrame, key: str, globs: str, dot: bool = True) -> DataFrame:
    """``(key, keys, rest)``: the array of globs of each row as an index; a glob is compiled once per worker."""

    def run(batches):
        for batch in batches:
            found = [index_globs(g, dot) for g in batch.column(1).to_pylist()]
            rest = [[{"folder": f, "regex": r} for f, r in rest] for _, rest in found]
            kind = pa.list_(pa.struct([("folder", pa.string()), ("regex", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([keys for keys, _ in found], pa.list_(pa.string())), pa.array(rest, kind)], names=[key, "keys", "rest"]
            )

    return rows.select(key, globs).mapInArrow(run, f"{key} string, {paths.GLOB_INDEX}")


def ignore_rules(files: DataFrame) -> DataFrame:
    """``(repo, keys, rest)``: an index over the globs of each repository's ignore file, where it names any."""
    found = of_kind(files, "ignore").filter(F.col("path") == IGNORE_FILE)
    globs = found.select("repo", paths.ignore_file_globs(F.col("content")).alias("globs")).filter(F.size("globs") > 0)
    return indexed_globs(globs, "repo", "globs")


def drop_ignored(rows: DataFrame, rules: DataFrame, path: str = "path", small: bool | None = None) -> DataFrame:
    """Rows whose path no ignore rule of their repository matches. Rules are measured unless the caller did (``small``)."""
    if fits_broadcast(rules) if small is None else small:
        joined = rows.join(F.broadcast(rules), "repo", "left")
    else:
        joined = salted_join(rows, rules, ["repo"], "left", spread=[path], large=True)
    ignored = paths.in_glob_index(F.col(path), F.col("keys"), F.col("rest"))
    return joined.filter(F.col("keys").isNull() | ~ignored).drop("keys", "rest")


__all__ = [
    "drop_ignored", "file_kind", "fits_broadcast", "ignore_rules", "of_kind", "read_checkouts",
    "read_corpus", "select_sources", "write_corpus",
]
