from pyspark.sql import functions as F

from duskwatch.fixed import DEPENDENCY_DIRS
from duskwatch.functions import paths
from duskwatch.sources.files import drop_ignored, ignore_rules, read_checkouts, select_sources


def values(spark, texts, expr):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    return [r.v for r in df.select("n", expr(F.col("t")).alias("v")).orderBy("n").collect()]


def test_test_files(spark):
    yes = ["tests/a.ts", "src/test/a.ts", "src/__tests__/a.tsx", "spec/a.js", "pkg/test_foo.py",
           "pkg/foo_test.py", "conftest.py", "a.test.ts", "a.test.tsx", "b.spec.js", "c.spec.mts", "spec\\a.js"]
    no = ["src/app.ts", "src/latest.ts", "lib/contest.py", "src/attestation.ts", "components/Tester.tsx",
          "src/testing/util.ts", "tests"]
    assert values(spark, yes + no, paths.is_test_file) == [True] * len(yes) + [False] * len(no)


def test_extension(spark):
    names = ["a/b.TS", "a.b/c", ".js", "x/.eslintrc.js", "a.", "d/e.test.py"]
    assert values(spark, names, paths.extension) == ["ts", "", "", "js", "", "py"]


def test_globs(spark):
    cases = [
        ("**/x.js", "x.js", True), ("**/x.js", "a/b/x.js", True), ("**/x.js", "a/yx.js", False),
        ("src/**", "src/a/b.js", True), ("src/**", "srcs/a.js", False), ("*.ts", "a/b.ts", False),
        ("a/**/b.js", "a/b.js", True), ("a/**/b.js", "a/x/y/b.js", True), ("?.js", "ab.js", False),
        ("{a,b}.js", "b.js", True), ("{a,b}.js", "a,b.js", False), ("[ab].js", "b.js", True),
        ("[!ab].js", "b.js", False), ("a+b(c).js", "a+b(c).js", True), ("**/a*", "x/.ab", False),
        ("**/*.md", "docs/.x.md", True), ("a,b", "a,b", True), ("x[.js", "x[.js", True),
    ]
    df = spark.createDataFrame([(n, g, p) for n, (g, p, _) in enumerate(cases)], "n int, g string, p string")
    got = df.select("n", F.rlike("p", paths.glob_regex(F.col("g"))).alias("m")).collect()
    assert {r.n: cases[r.n] for r in got if r.m != cases[r.n][2]} == {}


def test_odd_globs_compile_and_mean_what_they_say(spark):
    many = "{" + ",".join(f"n{i}" for i in range(200)) + "}"
    cases = [
        ("{src,{cfg,x}}/*.js", "cfg/a.js", True), ("{src,{cfg,x}}/*.js", "y/a.js", False), ("v{1..3}/a", "v2/a", True),
        ("v{1..3}/a", "v4/a", False), ("@(a|b).js", "a.js", True), ("!(a).js", "a.js", False), ("!(a).js", "b.js", True),
        ("+(ab).js", "abab.js", True), ("?(a)b", "b", True), ("*(a|b)c", "abac", True), ("lib/[z-a].js", "lib/[z-a].js", True),
        ("lib/[z-a].js", "lib/b.js", False), ("a[b", "a[b", True), ("a{b,c", "a{b,c", True), (f"{many}/x", "n150/x", True),
        ("@(a|b", "@(a|b", True), ("a)|b", "a)|b", True), ("x\\*y", "x*y", True), ("x\\*y", "xzy", False), ("[!]", "[!]", True),
        ("a\\", "a\\", True), ("{a}", "{a}", True), ("{a,b}{c,d}", "bd", True), ("{src/**,x}", "src/a/b", True),
    ]
    df = spark.createDataFrame([(n, g, p) for n, (g, p, _) in enumerate(cases)], "n int, g string, p string")
    got = df.select("n", F.rlike("p", paths.glob_regex(F.col("g"))).alias("m")).collect()
    assert {r.n: cases[r.n] for r in got if r.m != cases[r.n][2]} == {}


def test_any_line_of_an_ignore_file_compiles(spark, tree):
    import random

    rng = random.Random(7)
    lines = ["".join(rng.choice("ab/*?[]{}()!@+|,.-^\\$~&1") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    files = tree({f"r{n}": {".duskignore": line, "src/a.js": "x"} for n, line in enumerate(lines)})
    assert drop_ignored(files, ignore_rules(files), small=True).count() > 0


def test_ignore_lines(spark):
    cases = {
        "": [], "  # note": [], "!keep": [], "/": [], "build/": ["**/build/**"], "/build//": ["build/**"],
        " src/a.ts ": ["**/src/a.ts", "**/src/a.ts/**"], "/top": ["top", "top/**"],
    }
    assert values(spark, list(cases), paths.ignore_line_globs) == list(cases.values())


def test_excluded_directories(spark, tree):
    files = {f"{d}/a.js": "" for d in DEPENDENCY_DIRS} | {f"p/{d}/a.js": "" for d in DEPENDENCY_DIRS}
    files |= {"src/a.js": "", "distx/a.js": "", "src/.hidden/b.js": "", "README.md": "", "a.JS": "", "b.txt": ""}
    got = {r.path for r in select_sources(tree(files)).collect()}
    assert got == {"src/a.js", "distx/a.js"}
    every = {r.path for r in select_sources(tree(files), include_deps=True).collect()}
    assert {"node_modules/a.js", ".venv/a.js", "src/.hidden/b.js"} <= every
    few = select_sources(tree(files), ignore=("src/**",), registry_path=("r", "distx/a.js"))
    assert few.count() == 0


def test_size_cap_is_strictly_greater(spark, tree):
    df = tree({"a.js": "", "b.js": ""}).withColumn(
        "size", F.when(F.col("path") == "a.js", 2097152).otherwise(2097153).cast("long")
    )
    assert [r.path for r in select_sources(df, max_bytes=2097152).collect()] == ["a.js"]
    assert select_sources(df).count() == 2


def test_ignore_files_are_per_repository(spark, tree):
    files = tree({
        "one": {".duskignore": "gen/\r\n*.py", "gen/a.js": "", "x/gen/b.js": "", "c.py": "", "d.js": ""},
        "two": {"gen/a.js": "", "c.py": ""}, "three": {"sub/.duskignore": "a.js", "a.js": "", ".duskignore": "#"},
    })
    chosen = select_sources(files)
    for small in (True, False):
        left = drop_ignored(chosen, ignore_rules(files), small=small)
        assert {(r.repo, r.path) for r in left.collect()} == {
            ("one", "d.js"), ("two", "gen/a.js"), ("two", "c.py"), ("three", "a.js")
        }


def test_checkouts_on_disk(spark, tmp_path):
    texts = {"r1/src/a.js": b"x\xff", "r1/big.js": b"y" * 50, "r2/.git/config": b"[core]", "r1/__init__.py": b"",
             "r1/go.mod": b"z" * 50}
    for name, text in texts.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text)
    (tmp_path / "r1" / "link.js").symlink_to(tmp_path / "r1" / "big.js")
    files = read_checkouts(spark, str(tmp_path), max_bytes=40)
    got = {(r.repo, r.path): r.content for r in files.collect()}
    assert got == {
        ("r1", "src/a.js"): "x�", ("r2", ".git/config"): "[core]", ("r1", "__init__.py"): "", ("r1", "go.mod"): "z" * 50,
    }


def test_ignore_rules_too_many_to_broadcast_are_not(spark, tmp_path, monkeypatch):
    """Their estimated size knows nothing of the copies that salts make of them."""
    from conftest import plan_of

    from duskwatch.sources import files as sources

    rules = sources.ignore_rules(spark.createDataFrame([(f"r{n}", ".duskignore", "gen/") for n in range(9)], "repo string, path string, content string"))
    rules.write.parquet(f"{tmp_path}/rules")
    rows = spark.range(30).selectExpr("concat('r', id % 10) as repo", "if(id % 3 = 0, 'gen/a.js', 'src/a.js') as path")
    wanted = sorted(("r%d" % (n % 10), "gen/a.js" if n % 3 == 0 else "src/a.js") for n in range(30) if n % 3 or n % 10 == 9)
    for fits in (True, False):
        monkeypatch.setattr(sources, "fits_broadcast", lambda df: fits)
        kept = sources.drop_ignored(rows, spark.read.parquet(f"{tmp_path}/rules"))
        assert ("BroadcastHashJoin" in plan_of(kept)) == fits
        assert sorted(map(tuple, kept.collect())) == wanted


def test_a_corpus_is_written_without_a_sort_of_its_texts(spark, tree, tmp_path, monkeypatch):
    """The sort held all rows of a task in memory."""
    from pyspark.sql import DataFrameWriter

    from duskwatch.sources import files as sources

    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    write, before = DataFrameWriter.parquet, spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(int(spark.conf.get(name))), write(self, path))[1])
    paths = ["package.json", ".duskignore", ".git/config", ".github/workflows/a.yml", "a.js", "README.md"]
    sources.write_corpus(tree({p: p for p in paths}), f"{tmp_path}/corpus")
    kept = sources.read_corpus(spark, f"{tmp_path}/corpus").select("path", "kind").collect()
    assert sorted(r.path for r in kept) == sorted(paths) and {r.kind for r in kept} == set(sources.KINDS)
    assert seen == [len(sources.KINDS)] and spark.conf.get(name) == before
