import datetime as dt
import json

from pyspark.sql import functions as F

from duskwatch import registry_from_rows
from duskwatch.operators.coverage import coverage_audit, lacking_scan
from duskwatch.operators.inventory import affected_repos, latest_inventory
from duskwatch.plans.joins import fits_broadcast, salted_join
from duskwatch.sinks.reports import REPORT_SCHEMA, Batch, append_reports, read_table
from duskwatch.streaming.monitor import drop_repeats, ingest_reports, notify_batch


def upload(repo, at, *packages):
    deps = [{"name": n, "version": None, "manifest": m} for n, m in packages]
    return {"repo": repo, "cliVersion": "1", "reportedAt": at, "inventory": {"dependencies": deps}}


def uploads(spark, *rows):
    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "t string")
    return texts.select(F.from_json("t", REPORT_SCHEMA).alias("u")).select("u.*")


def entry(id_, *sdk, exts=("*",), **more):
    return {"id": id_, "vendor": "v", "title": "t", "severity": "low", "applies_to": list(exts),
            "detect": {"sdk": list(sdk), "patterns": ["x"]}, **more}


def test_notifications(spark, tmp_path):
    root = str(tmp_path / "m")
    append_reports(uploads(
        spark, upload("a", "2026-06-01T00:00:00Z", ("Left_Pad", "package.json"), ("old", "package.json")),
        upload("b", "2026-06-01T00:00:00Z", ("left-pad", "requirements.txt")), upload("c", "2026-06-01T00:00:00Z"),
    ), root, Batch("s", 0))
    again = upload("a", "2026-06-02T00:00:00Z", ("left-pad", "package.json"))
    append_reports(uploads(spark, again, again), root, Batch("s", 1))
    append_reports(uploads(spark, again), root, Batch("s", 2))
    assert read_table(spark, root, "reports").count() == 4
    newest = latest_inventory(read_table(spark, root, "inventory"), read_table(spark, root, "reports"))
    assert sorted((r.repo, r.name) for r in newest.collect()) == [("a", "left-pad"), ("b", "left-pad")]

    first = [entry("e1", "left-pad")]
    notify_batch(spark, registry_from_rows(spark, first), root, Batch("s", 0))
    assert read_table(spark, root, "notifications").count() == 0  # the first run seeds silently
    more = first + [entry("e2", "left.pad", exts=["js"]), entry("e3", "old"), entry("e4")]
    for _ in range(2):  # a retry repeats the same result
        notify_batch(spark, registry_from_rows(spark, more), root, Batch("s", 1))
        sent = {(r.repo, r.id) for r in read_table(spark, root, "notifications").collect()}
        assert sent == {("a", "e2")}
    edited = first + [entry("e2", "left-pad"), entry("e3", "left-pad"), entry("e5", "left-pad")]
    notify_batch(spark, registry_from_rows(spark, edited), root, Batch("s", 2))
    sent = sorted((r.repo, r.id) for r in read_table(spark, root, "notifications").collect())
    assert sent == [("a", "e2"), ("a", "e5"), ("b", "e5")]


def test_ingestion_resumes(spark, tmp_path):
    root, inbox = str(tmp_path / "m"), str(tmp_path / "in")
    for day in ("01", "02"):
        uploads(spark, upload("a", f"2026-06-{day}T00:00:00Z", ("p" + day, "go.mod"))).write.mode("append").json(inbox)
        stream = spark.readStream.schema(REPORT_SCHEMA).json(inbox)
        ingest_reports(stream, root, str(tmp_path / "cp")).awaitTermination()
    reports = read_table(spark, root, "reports")
    assert reports.count() == 2
    newest = latest_inventory(read_table(spark, root, "inventory"), reports)
    assert [r.name for r in newest.collect()] == ["p02"]


def test_repeats_in_a_stream(spark, tmp_path):
    rows = [("a", "e", dt.datetime(2026, 6, 1, h)) for h in range(5)] + [("b", "e", dt.datetime(2026, 6, 1))]
    spark.createDataFrame(rows, "repo string, id string, reported_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, id string, reported_at timestamp").parquet(str(tmp_path / "in"))
    out = drop_repeats(stream, ["repo", "id"]).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def config(*urls):
    return "[core]\n" + "".join(f'[remote "r"]\n\turl = {u}\n' for u in urls)


def test_coverage(spark, tree):
    flow = ".github/workflows/"
    repos = {
        "bare": {"a.js": ""}, "pointer": {".git": "gitdir: x"}, "fresh": {".git/config": config()},
        "https": {".git/config": config("https://github.com/o/n.git")}, "lab": {".git/config": config("git@gitlab.com:o/n.git", "x")},
        "mixed": {".git/config": config("https://gitlab.com/o/n", "ssh://git@github.com/own/name/")},
        "ours": {".git/config": "", flow + "duskwatch.yml": "", flow + "a.yml": "duskwatch"},
        "hand": {".git/config": "", flow + "z.YAML": "run duskwatch", flow + "a.txt": "duskwatch", flow + "sub/a.yml": "duskwatch"},
    }
    files = tree(repos)
    audit = coverage_audit(files, files.select("repo").distinct())
    got = {r.repo: (r.outcome, r.host, r.workflow, r.owner, r.name) for r in audit.collect()}
    assert got == {
        "bare": ("not-git", None, None, None, None), "pointer": ("eligible", None, None, None, None),
        "fresh": ("eligible", None, None, None, None), "https": ("eligible", None, None, "o", "n"),
        "lab": ("non-github", "gitlab.com", None, None, None), "mixed": ("eligible", None, None, "own", "name"),
        "ours": ("already", None, flow + "duskwatch.yml", None, None), "hand": ("already", None, flow + "z.YAML", None, None),
    }
    assert {r.repo for r in lacking_scan(audit).collect()} == {"pointer", "fresh", "https", "lab", "mixed"}


def test_hot_key_is_spread(spark):
    left = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(left, right, ["k"], "inner", spread=["id"])
        assert joined.count() == 2001
        assert salted_join(left, right, ["k"], "left_semi", spread=["id"]).count() == 2001
        assert salted_join(left, right, ["k"], "left", spread=["id"]).count() == 6000
        salts = left.filter("k = 'hot'").selectExpr("pmod(xxhash64(id), 16) as s").groupBy("s").count()
        assert salts.count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_check(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) as t")
    assert fits_broadcast(df) and not fits_broadcast(df, max_rows=99) and not fits_broadcast(df, max_bytes=5000)


def test_pattern_entries_with_packages_count(spark):
    registry = registry_from_rows(spark, [entry("e", "Pkg"), entry("none")])
    inventory = spark.createDataFrame([("a", "x/go.mod", "pkg", None)], "repo string, manifest string, name string, version string")
    assert [tuple(r) for r in affected_repos(registry, inventory).collect()] == [("a", "e")]


def test_no_large_side_is_broadcast_for_notifications(spark, tmp_path, monkeypatch):
    """Read from small files, sides measured as large were broadcast by estimate, one of them with a copy per salt."""
    from conftest import plan_of

    from duskwatch.operators import inventory as inventories
    from duskwatch.operators.inventory import notifications
    from duskwatch.plans import joins

    spark.range(40).selectExpr(
        "concat('e', id) as id", "'pattern' as match", "cast(null as string) as version_range", "array('*') as applies_to",
        "named_struct('sdk', array(concat('p', id))) as detect",
    ).write.parquet(f"{tmp_path}/registry")
    spark.range(60).selectExpr("concat('r', id % 7) as repo", "'go.mod' as manifest", "concat('p', id) as name").write.parquet(f"{tmp_path}/inventory")
    registry, inventory = spark.read.parquet(f"{tmp_path}/registry"), spark.read.parquet(f"{tmp_path}/inventory")
    sent = spark.createDataFrame([("r6", "e20")], "repo string, id string")
    for module in (joins, inventories):
        monkeypatch.setattr(module, "fits_broadcast", lambda df: False)
    due = notifications(registry, registry.filter("substr(id, 2) < '2'"), inventory, sent)
    assert "BroadcastHashJoin [id" not in plan_of(due) and "BroadcastHashJoin [norm" not in plan_of(due)
    new = [n for n in range(40) if str(n) >= "2"]
    assert sorted(map(tuple, due.collect())) == sorted((f"r{n % 7}", f"e{n}") for n in new if n != 20)
