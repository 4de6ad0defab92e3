"""State of streams by key: bucketed tables in which a batch reads only the buckets of its own keys.

Every batch writes a small run. Eight runs of a level are merged into one of the next, as in a log-structured
merge tree, so a bucket is a few files however many batches there were, and a key is rewritten a logarithmic
number of times. A stream merges its own runs only; streams that share a root read each other's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sinks.reports import Batch

BUCKETS = 64
#: Tasks that write a run; a number of its own keeps them from being drawn together into one that writes file after file.
WRITERS = 16
#: Runs of one level that are merged into one of the next.
FAN = 8


def first_of_key(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """For sets: any row of a key stands for all."""
    return lambda rows: rows.dropDuplicates(list(keys))


def last_of_key(keys: tuple[str, ...], order: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """For values that are replaced: of each key the row with the greatest ``order``."""

    def merge(rows: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in rows.columns if c not in keys])
        return rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)

    return merge


@dataclass(frozen=True)
class Run:
    stream: str
    level: int
    number: int  # of the last batch it holds
    path: str


@dataclass(frozen=True)
class State:
    """A keyed table under ``root/state/name``; ``merge`` brings the rows of each key down to one."""

    spark: SparkSession
    root: str
    name: str
    schema: str
    by: tuple[str, ...]  # the columns whose hash is the bucket
    merge: Callable[[DataFrame], DataFrame]

    @property
    def folder(self) -> str:
        return f"{self.root}/state/{self.name}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(BUCKETS)).cast("int")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self) -> list[Run]:
        """Runs that were completely written, covered ones too."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = self._files().globStatus(path(f"{self.folder}/stream=*/level=*/run=*/_SUCCESS"))
        runs = []
        for status in found or []:
            run = status.getPath().getParent()
            level, stream = run.getParent(), run.getParent().getParent()
            value = lambda p: p.getName().split("=", 1)[1]
            runs.append(Run(value(stream), int(value(level)), int(value(run)), str(run)))
        return runs

    @staticmethod
    def _standing(runs: list[Run]) -> list[Run]:
        """A run that holds a batch holds all that its stream wrote before on lower levels."""
        return [
            r for r in runs if not any(o.stream == r.stream and o.level > r.level and o.number >= r.number for o in runs)
        ]

    def runs(self, ahead_of: Batch | None = None) -> list[Run]:
        """The runs to read; those of a batch that is repeated, and of what its stream wrote after it, are not."""
        runs = self._runs()
        if ahead_of is not None:
            runs = [r for r in runs if r.stream != ahead_of.stream or r.number < ahead_of.number]
        return self._standing(runs)

    def _stored(self, runs: list[Run]) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.folder).parquet(*[r.path for r in runs])
        return rows.drop("stream", "level", "run")

    def pending(self, keys: DataFrame | None = None, ahead_of: Batch | None = None) -> DataFrame:
        """The rows of the buckets that hold ``keys(*by)``, or of all, as they are stored."""
        runs = self.runs(ahead_of)
        if not runs:
            # The limit tells the optimizer: joins with a state that is not there yet move nothing.
            return self.spark.createDataFrame([], self.schema).limit(0)
        if keys is None:
            return self._stored(runs).drop("bucket")
        # At most as many numbers as there are buckets.
        buckets = [r.bucket for r in keys.select(self._bucket().alias("bucket")).distinct().collect()]
        return self._stored(runs).filter(F.col("bucket").isin(buckets)).drop("bucket")

    def read(self, keys: DataFrame | None = None, ahead_of: Batch | None = None) -> DataFrame:
        """The same rows, one of each key."""
        return self.merge(self.pending(keys, ahead_of))

    def write(self, rows: DataFrame, batch: Batch) -> None:
        """Write the run of a batch, over what an earlier try of it wrote; then merge older runs if there are many."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        self._store(rows.select(*names), f"{self.folder}/stream={batch.stream}/level=0/run={batch.number}")
        self._merge_runs(batch)

    def _store(self, rows: DataFrame, path: str) -> None:
        # Files are moved into place one by one: a run counts when its _SUCCESS is there.
        bucketed = rows.withColumn("bucket", self._bucket())
        bucketed.repartition(WRITERS, "bucket").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("bucket").parquet(path)

    def _merge_runs(self, batch: Batch) -> None:
        # The run of this batch may still be repeated: it is merged by a later one.
        every = [r for r in self._runs() if r.stream == batch.stream and r.number < batch.number]
        standing = self._standing(every)
        for run in set(every) - set(standing):  # covered since the last merge at least: nobody reads them any more
            self._files().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run.path), True)
        for level in sorted({r.level for r in standing}):
            due = sorted((r for r in standing if r.level == level), key=lambda r: r.number)
            if len(due) < FAN:
                continue
            merged = self.merge(self._stored(due).drop("bucket"))
            self._store(merged, f"{self.folder}/stream={batch.stream}/level={level + 1}/run={due[-1].number}")
            return


# --- the states of monitoring -------------------------------------------------------------------

PACKAGES = "array<struct<manifest:string,name:string,version:string>>"


def known_reports(spark: SparkSession, root: str) -> State:
    return State(spark, root, "reports", "report_id string", ("report_id",), first_of_key("report_id"))


def seen_entries(spark: SparkSession, root: str) -> State:
    return State(spark, root, "seen", "id string", ("id",), first_of_key("id"))


def sent_notifications(spark: SparkSession, root: str) -> State:
    return State(spark, root, "notifications", "repo string, id string", ("repo", "id"), first_of_key("repo", "id"))


def latest_per_repo(spark: SparkSession, root: str) -> State:
    """Of every repository its newest report and the packages that declares."""
    schema = f"repo string, report_id string, reported_at timestamp, packages {PACKAGES}"
    return State(spark, root, "latest", schema, ("repo",), last_of_key(("repo",), ("reported_at", "report_id")))


def repos_per_package(spark: SparkSession, root: str) -> State:
    """By normalised package name: which repositories declared it last, and in which manifest."""
    schema = "norm string, manifest string, repo string, present boolean, reported_at timestamp, report_id string"
    return State(
        spark, root, "packages", schema, ("norm",), last_of_key(("norm", "manifest", "repo"), ("reported_at", "report_id"))
    )
