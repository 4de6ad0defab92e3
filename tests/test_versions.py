"""Version keys and the interval join against the comparison of numbers one by one."""

import itertools
import random

from pyspark.sql import functions as F

from duskwatch.functions import versions as v
from duskwatch.operators.dependencies import versions_in_ranges

VERSIONS = ["1", "1.0", "1.0.0.0", "v1.2", "^1.2.0", "1.10", "1.9", "0", "0.0", "0.1", "10", "2.0-beta3", "latest", "", None, "20240101", "4294967296.1", "99999999999999999999", "1" + "0" * 400, "007.5"]
RANGES = ["<1", "<=1.0", ">1.2", ">=1.2.0", "=1.10", "1", "== 10", ">=0", "<0", ">20240100", "<4294967297", ">=99999999999", "~1", "", None, ">v3", "> 0.0.1"]


def test_keys_sort_like_versions(spark):
    rng = random.Random(2)
    more = [".".join(str(rng.choice([0, 1, 2, 9, 10, 11, 99, 100, 2**31])) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    pairs = list(itertools.product([t for t in VERSIONS if t and any(c.isdigit() for c in t)] + more, repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string")
    key = lambda c: v.version_key(F.col(c))
    sign = F.when(key("a") < key("b"), -1).when(key("a") > key("b"), 1).otherwise(0)
    want = v.compare_versions(v.version_numbers(F.col("a")), v.version_numbers(F.col("b")))
    assert df.filter(sign != want).collect() == []
    assert [r.k for r in spark.createDataFrame([("none",), (None,)], "a string").select(key("a").alias("k")).collect()] == [None, None]


def test_intervals_equal_ranges(spark):
    df = spark.createDataFrame(list(itertools.product(VERSIONS, RANGES)), "d string, r string")
    holds = v.in_interval(v.version_key(F.col("d")), v.version_interval(F.col("r")))
    assert df.filter(~holds.eqNullSafe(F.coalesce(v.version_in_range(F.col("d"), F.col("r")), F.lit(False)))).collect() == []


def test_interval_join(spark):
    have = spark.createDataFrame([(n, t) for n in ("hot", "cold") for t in VERSIONS + [f"{i}.{i % 3}" for i in range(300)] * 2] , "norm string, version string")
    want = spark.createDataFrame([("hot", r) for r in RANGES] + [("cold", ">5.1"), ("none", "<3")], "norm string, range string")
    got = [tuple(r) for r in versions_in_ranges(have, want).collect()]
    plain = have.distinct().join(want, "norm").filter(v.version_in_range(F.col("version"), F.col("range")))
    order = lambda rows: sorted(rows, key=str)
    assert len(got) == len(set(got)) and order(got) == order(tuple(r) for r in plain.select("norm", "version", "range").collect())


def test_cells_of_a_range_are_disjoint_and_few(spark):
    ranges = spark.createDataFrame([(r,) for r in RANGES], "r string").select("r", v.interval_cells(F.col("r")).alias("c")).collect()
    for r in ranges:
        assert 1 <= len(r.c) <= 121 and len(set(r.c)) == len(r.c)
        assert not any(a != b and b.startswith(a) for a in r.c for b in r.c)
