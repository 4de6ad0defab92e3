"""Compiled globs, and the index over many of them, on random globs and paths."""

import random

from pyspark.sql import functions as F

from conftest import plan_of

from duskwatch.functions import paths
from duskwatch.functions.globs import any_glob_regex, compile_glob, index_globs
from duskwatch.sources.files import select_sources

LINES = ["a/", "/a", "/a/b", "b.js", "*.js", "*.d.ts", "/a/*.js", "a/b", "**/a/**", "/a/**/b", "a*", "/b/?.js", "[ab].js", "{a,b}/c", "c/**", "/c/", ".a", "a.", "x/*/y/"]


def random_paths(n, seed=3):
    rng = random.Random(seed)
    names = ["a", "b", "c", "x", "y", ".a", "a.", "a.js", "b.js", "a.d.ts", ".js", "b.d.ts", "ab", "js"]
    return sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(n)})


def test_index_equals_regex(spark):
    texts = random_paths(400)
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    globs = spark.createDataFrame([(line,) for line in LINES], "line string").select("line", paths.ignore_line_globs(F.col("line")).alias("globs")).collect()
    rng = random.Random(1)
    for some in [globs[i : i + 1] for i in range(len(globs))] + [rng.sample(globs, 6) for _ in range(4)]:
        chosen = [g for r in some for g in r.globs]
        keys, rest = index_globs(chosen)
        key_list = F.array(*map(F.lit, keys)).cast("array<string>")
        rest_list = F.array(*[F.struct(F.lit(f).alias("folder"), F.lit(r).alias("regex")) for f, r in rest]).cast("array<struct<folder:string,regex:string>>")
        got = df.select("p", paths.in_glob_index(F.col("p"), key_list, rest_list).alias("i"), F.rlike("p", F.lit(any_glob_regex(chosen))).alias("r"))
        assert [r.p for r in got.filter("i <> r").collect()] == []


def test_most_lines_need_no_regex():
    keys, rest = index_globs(["**/gen/**", "build", "build/**", "**/*.js", "**/*.js/**", "**/x.ts", "lib/a*.js", "lib/b*.js"])
    assert rest == [("lib/", compile_glob("lib/a*.js") + "|" + compile_glob("lib/b*.js"))]
    assert keys == ["n:gen", "=:build", "d:build", "e:.js", "x:.js", "b:x.ts"]


def test_long_number_ranges(spark):
    rng = random.Random(5)
    ends = [(1, 25_000), (-1500, 1500), (99_999, 1_000_001), (7, 123_456_789_012), (20_000, 3)]
    for a, b in ends:
        low, high = min(a, b), max(a, b)
        numbers = {low, low - 1, high, high + 1, 0, 1, -1, 9, 10, 99, 100, 1000, *(rng.randint(low - 50, high + 50) for _ in range(300))}
        regex = compile_glob(f"v{{{a}..{b}}}.js")
        assert len(regex) < 1000
        df = spark.createDataFrame([(n, f"v{n}.js") for n in numbers], "n long, p string")
        assert {r.n for r in df.filter(F.rlike("p", F.lit(regex))).collect()} == {n for n in numbers if low <= n <= high}


def test_globs_of_a_caller_are_one_constant(spark, tree):
    plan = plan_of(select_sources(tree({"a.js": "x"}), ignore=("gen/**", "{a,b}/*.js")))
    assert "aggregate" not in plan and "Python" not in plan and "RLIKE" in plan
