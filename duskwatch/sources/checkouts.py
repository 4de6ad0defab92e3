"""Checkouts as a data source: folders are pruned while they are listed, files are read on any file system Arrow knows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from duskwatch.fixed import DEPENDENCY_DIRS, MANIFEST_ECOSYSTEMS, WORKFLOW_DIR

SCHEMA = "repo string, path string, content string, size bigint"
BATCH_BYTES = 32 * 1024 * 1024
#: Folders are dealt to at most so many partitions.
PARTITIONS = 2048


@dataclass(frozen=True)
class Wanted:
    """What a query asks for, as far as it decides which folders are listed and which files are opened."""

    include_deps: bool = False
    max_bytes: int | None = None
    repos: frozenset[str] | None = None
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    sizes: tuple[tuple[str, int], ...] = field(default=())

    def repo(self, name: str) -> bool:
        return self.repos is None or name in self.repos

    def folder(self, path: str) -> bool:
        """Whether a folder of a repository is listed at all; ``path`` has no slash at its end."""
        name = path.rsplit("/", 1)[-1]
        if name == ".git" or (name == "node_modules" and not self.include_deps):
            return False
        return all(p.startswith(path + "/") or (path + "/").startswith(p) for p in self.prefixes)

    def file(self, path: str, size: int) -> bool:
        base = path.rsplit("/", 1)[-1]
        manifest = base in MANIFEST_ECOSYSTEMS
        if not self.include_deps and not manifest and path != ".git/config" and not path.startswith(WORKFLOW_DIR + "/"):
            folders = path.split("/")[:-1]
            if any(f.startswith(".") or f in DEPENDENCY_DIRS for f in folders):
                return False
        if self.max_bytes is not None and size > self.max_bytes and not manifest:
            return False
        compare = {"<": size.__lt__, "<=": size.__le__, ">": size.__gt__, ">=": size.__ge__, "=": size.__eq__}
        return (
            all(path.startswith(p) for p in self.prefixes) and all(path.endswith(s) for s in self.suffixes)
            and all(compare[op](value) for op, value in self.sizes)
        )


@dataclass(frozen=True)
class Folders(InputPartition):
    """Folders of repositories, each with whether what lies below its own folders is meant as well."""

    folders: tuple[tuple[str, str, bool], ...]


def open_files(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address (``file:``, ``hdfs:``, ``s3:``, ``gs:`` ...), and the path there."""
    if "://" in root or root.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(root)
    return arrow_fs.LocalFileSystem(), os.path.abspath(root)


def list_folder(files: arrow_fs.FileSystem, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, size) of what lies in a folder; links are not followed, what vanishes is not told."""
    found = files.get_file_info(arrow_fs.FileSelector(path, recursive=False, allow_not_found=True))
    local = isinstance(files, arrow_fs.LocalFileSystem)
    return [
        (i.base_name, i.type == arrow_fs.FileType.Directory, i.size or 0) for i in found
        if i.type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory) and not (local and os.path.islink(i.path))
    ]


class CheckoutReader(DataSourceReader):
    def __init__(self, root: str, wanted: Wanted, partitions: int):
        self.root, self.wanted, self.most = root, wanted, partitions

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over conditions on the repository, the beginning and end of the path, and the size."""
        signs = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            w, name = self.wanted, f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo | In) and name == "repo":
                values = frozenset(f.value if isinstance(f, In) else [f.value])
                self.wanted = replace(w, repos=values if w.repos is None else w.repos & values)
            elif isinstance(f, StringStartsWith) and name == "path":
                self.wanted = replace(w, prefixes=(*w.prefixes, f.value))
            elif isinstance(f, StringEndsWith) and name == "path":
                self.wanted = replace(w, suffixes=(*w.suffixes, f.value))
            elif name == "size" and (type(f) in signs or isinstance(f, EqualTo)):
                self.wanted = replace(w, sizes=(*w.sizes, (signs.get(type(f), "="), f.value)))
            else:
                yield f

    def partitions(self) -> list[Folders]:
        """Folders of the repositories, dealt out: each repository's own files, and each of its folders with all below it."""
        files, base = open_files(self.root)
        repos = sorted(name for name, folder, _ in list_folder(files, base) if folder and self.wanted.repo(name))

        def split(repo: str) -> list[tuple[str, str, bool]]:
            inner = list_folder(files, f"{base}/{repo}")
            return [(repo, "", False)] + sorted((repo, name, True) for name, folder, _ in inner if folder and self.wanted.folder(name))

        with ThreadPoolExecutor(32) as pool:
            folders = [f for part in pool.map(split, repos) for f in part]
        count = max(1, min(self.most, len(folders)))
        return [Folders(tuple(folders[i::count])) for i in range(count)]

    def _walk(self, files, base: str, repo: str, top: str, deep: bool) -> Iterator[tuple[str, int]]:
        """(path, size) of the files wanted, folder by folder; nothing of a folder that is not entered is listed."""
        todo = [top]
        while todo:
            at = todo.pop()
            for name, folder, size in list_folder(files, "/".join(p for p in (base, repo, at) if p)):
                path = f"{at}/{name}" if at else name
                if not folder:
                    if self.wanted.file(path, size):
                        yield path, size
                elif deep and self.wanted.folder(path):
                    todo.append(path)
        if not top:
            config = files.get_file_info(f"{base}/{repo}/.git/config")
            if config.type == arrow_fs.FileType.File and self.wanted.file(".git/config", config.size):
                yield ".git/config", config.size

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files, base = open_files(self.root)
        rows, held = [], 0
        for repo, top, deep in partition.folders:
            for path, size in self._walk(files, base, repo, top, deep):
                try:
                    with files.open_input_stream(f"{base}/{repo}/{path}") as stream:
                        text = stream.read().decode("utf-8", "replace")
                except OSError:  # unreadable files are left out
                    continue
                rows.append((repo, path, text, size))
                held += size
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["repo", "path", "content", "size"])


class Checkouts(DataSource):
    """``spark.read.format("checkouts").load(root)``: one folder per repository below ``root``.

    ``.git`` is never listed, only its ``config`` read; ``node_modules`` never, and of other folders of dependencies and hidden ones only
    manifests and workflows are read, unless the option ``include_deps`` is true. ``max_bytes`` leaves larger files unopened, manifests excepted.
    """

    @classmethod
    def name(cls) -> str:
        return "checkouts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CheckoutReader:
        most = self.options.get("max_bytes")
        wanted = Wanted(self.options.get("include_deps", "false").lower() == "true", int(most) if most else None)
        return CheckoutReader(self.options["path"], wanted, int(self.options.get("partitions", PARTITIONS)))


def scan_checkouts(
    spark: SparkSession, root: str, include_deps: bool = False, max_bytes: int | None = None, partitions: int = PARTITIONS
) -> DataFrame:
    """The corpus ``files(repo, path, content, size)`` of checkouts below ``root``, pruned by what the query asks of it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Checkouts)
    reader = spark.read.format("checkouts").option("include_deps", str(include_deps).lower()).option("partitions", str(partitions))
    return (reader if max_bytes is None else reader.option("max_bytes", str(max_bytes))).load(root)
