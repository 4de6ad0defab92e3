"""Uploads that no other repeats do not move, nor does anything meet a state that is not there yet."""

import json

import pytest

from duskwatch.sinks import reports
from duskwatch.sinks.reports import REPORT_SCHEMA, Batch, append_reports, read_table
from duskwatch.streaming.state import known_reports
from tests.conftest import plan_of

KEYS = [("a", "2026-01-01T00:00:00Z"), ("a", "2026-01-02T00:00:00Z"), ("b", "2026-01-01T00:00:00Z"), ("b", None), (None, None)]


def _uploads(spark):
    rows = [
        json.dumps({"repo": repo, "reportedAt": at, "cliVersion": f"{9 - n}", "inventory": {"dependencies": [{"name": f"d{n}"}]}, "findings": []})
        for n, (repo, at) in enumerate(KEYS + KEYS[1:2] + KEYS[3:])
    ]
    return spark.createDataFrame([(r,) for r in rows], "j string").selectExpr(f"from_json(j, '{REPORT_SCHEMA}') as u").select("u.*")


def test_only_repeated_uploads_move(spark):
    plan = plan_of(reports._one_of_each(_uploads(spark)))
    alone, several = plan.index("LeftAnti"), plan.index("LeftSemi")
    # The one exchange by key is that of the repeated ones, below which they were picked out.
    assert plan.count("Exchange hashpartitioning") == 1 and alone < plan.index("Exchange hashpartitioning") < several


@pytest.mark.parametrize("small", [True, False])
def test_the_first_of_repeated_uploads_is_taken(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(reports, "fits_broadcast", lambda rows: small)
    append_reports(_uploads(spark), str(tmp_path), Batch("s", 0))
    found = {(r.repo, str(r.reported_at)): r.version for r in read_table(spark, str(tmp_path), "reports").collect()}
    assert found == {
        ("a", "2026-01-01 00:00:00"): "9", ("a", "2026-01-02 00:00:00"): "4", ("b", "2026-01-01 00:00:00"): "7", ("b", "None"): "3", (None, "None"): "2"
    }
    names = sorted(r.name for r in read_table(spark, str(tmp_path), "inventory").collect())
    assert names == ["d0", "d2", "d5", "d6", "d7"]


def test_a_state_not_there_yet_joins_nothing(spark, tmp_path):
    ids = spark.range(5).selectExpr("cast(id as string) as report_id")
    left = ids.join(known_reports(spark, str(tmp_path)).read(ids), "report_id", "left_anti")
    assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString() and left.count() == 5
