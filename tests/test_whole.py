"""Files made of the test tables are dealt to all cores, however few splits the tables have."""

from datetime import datetime

from pyspark.sql import functions as F

from catalogue.whole import _files, scan_totals


def _tables(spark, folder):
    customers = [(n, n % 25, float(1 - 2 * (n % 2)), "BUILDING") for n in range(400)] + [(None, 3, 1.0, "BUILDING")]
    orders = [(n, n % 400, "FOP"[n % 3], 10.0, datetime(1996, 1, 1), "1-URGENT") for n in range(800)] + [(None, None, "F", 1.0, None, None)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(
        f"{folder}/customer.parquet"
    )
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    ).coalesce(1).write.parquet(f"{folder}/orders.parquet")


def test_files_of_one_split_are_made_by_many_tasks(spark, tmp_path):
    _tables(spark, str(tmp_path))
    files = _files(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    tasks = {r.path: r.n for r in files.groupBy("path").agg(F.count_distinct("task").alias("n")).collect()}
    assert min(tasks[path] for path in ("package.json", "requirements.txt", "go.mod", "src/app.js", ".duskignore")) > 4
    rows = files.agg(F.count("*"), F.count("repo"), F.count("path")).first()
    # 9 files of each of 401 customers, 200 go.mod, 801 members; one customer and one order without a key.
    assert tuple(rows) == (9 * 401 + 200 + 801, 9 * 400 + 200 + 800, 9 * 401 + 200 + 800)


def test_totals_of_dealt_files(spark, tmp_path):
    _tables(spark, str(tmp_path))
    totals = {r.repo: r for r in scan_totals(spark, str(tmp_path)).collect()}
    assert totals["c0"].scanned_files == 1 and totals["c13"].scanned_files == 2
    assert sum(r.manifests_scanned for r in totals.values() if r.repo) == 2 * 400 + 200 + sum(
        1 for n in range(800) if (n % 400 % 25 < 8 and n % 3 == 0) or (8 <= n % 400 % 25 <= 15 and n % 3 == 1)
    )
