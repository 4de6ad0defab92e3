"""Work that is long per row is dealt to all cores, however few splits its rows come in."""

from pyspark.sql import functions as F

from duskwatch.operators.audit import unusable_patterns
from duskwatch.plans.joins import TASKS_PER_CORE
from duskwatch.sources.registry import entries_of_json


def test_expressions_of_one_split_are_judged_by_all_cores(spark):
    entry = F.concat(
        F.lit('{"id": "e'), "id", F.lit('", "vendor": "v", "title": "t", "severity": "low", "detect": {"patterns": ["(a", "a'), "id", F.lit('"]}}')
    )
    rows = spark.range(0, 400, 1, 1).select("id", entry.alias("text"))
    bad = unusable_patterns(entries_of_json(rows, "text", "id")).withColumn("task", F.spark_partition_id())
    found = bad.collect()
    assert sorted(r["entry_ord"] for r in found) == list(range(400)) and {r["source"] for r in found} == {"(a"}
    assert len({r["task"] for r in found}) == spark.sparkContext.defaultParallelism * TASKS_PER_CORE
