import datetime as dt
import json

import pytest

from duskwatch import load_registry, read_registry, registry_from_rows
from duskwatch.operators.audit import registry_audit
from duskwatch.operators.rules import compile_rules
from duskwatch.sinks.snapshots import newest_snapshot, refresh, write_snapshot
from duskwatch.sources.registry import BUNDLED, RegistryError, provenance, read_entries

GOOD = {"id": "a", "vendor": "v", "title": "t", "severity": "high", "detect": {"patterns": ["x"]}}


def stored(tmp_path, value, name="r.json"):
    file = tmp_path / name
    file.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(file)


def test_both_shapes_and_broken_texts(spark, tmp_path):
    assert read_registry(spark, stored(tmp_path, [GOOD])).count() == 1
    assert read_registry(spark, stored(tmp_path, {"deprecations": [GOOD, 5, None, []]}, "o.json")).count() == 1
    for n, bad in enumerate(["{", '{"x": 1}', '"text"', '{"deprecations": {}}', "null"]):
        with pytest.raises(RegistryError):
            read_registry(spark, stored(tmp_path, bad, f"bad{n}.json"))
    with pytest.raises(RegistryError):
        read_registry(spark, str(tmp_path / "missing.json"))


def test_coercion(spark):
    def one(**change):
        rows = registry_from_rows(spark, [{**GOOD, **change}]).collect()
        return rows[0] if rows else None

    assert one().match == "pattern" and one(match=None).match == "pattern"
    assert one().applies_to == ["*"] and one(applies_to=[]).applies_to == ["*"]
    assert one(applies_to=[".JS", "Py"]).applies_to == ["js", "py"] and one(applies_to=["a", 1]).applies_to == ["*"]
    assert one(sunset_date="").sunset_date is None and one(confidence="maybe").confidence is None
    assert one(status="gone").status is None and one(status="retired").status == "retired"
    assert one(source=3).source == "" and one(version_range="").version_range is None
    assert one(detect={"patterns": ["x"], "models": ["m", None], "sdk": "no"}).detect.models == []
    dropped = [
        {"id": ""}, {"id": 7}, {"vendor": None}, {"title": ""}, {"severity": "urgent"}, {"match": "endpoint"},
        {"match": ""}, {"match": 3}, {"detect": {}}, {"detect": None}, {"match": "sdk"},
        {"match": "version", "detect": {"patterns": ["x"]}}, {"detect": {"patterns": ["x", 1]}},
    ]
    kept = registry_from_rows(spark, [{**GOOD, **change} for change in dropped] + [{**GOOD, "id": "sibling"}])
    assert [r.id for r in kept.collect()] == ["sibling"]


def test_resolution_order(spark, tmp_path):
    custom = stored(tmp_path, [{**GOOD, "id": "mine"}])
    root = str(tmp_path / "snaps")
    assert load_registry(spark).origin == "bundled"
    assert load_registry(spark, snapshots=root).origin == "bundled"
    write_snapshot(spark, root, read_entries(spark, custom), "here", dt.datetime(2026, 6, 1))
    cached = load_registry(spark, snapshots=root)
    assert cached.origin == "cache" and cached.fetched_at == dt.datetime(2026, 6, 1)
    assert [r.id for r in cached.entries.collect()] == ["mine"]
    assert provenance(spark, cached).first().origin == "cache"
    assert load_registry(spark, custom=custom, snapshots=root).origin == "custom"
    with pytest.raises(RegistryError):
        load_registry(spark, custom=stored(tmp_path, "{", "broken.json"), snapshots=root)
    meta = spark.createDataFrame(
        [(9, "gone", "u", 1, dt.datetime(2026, 6, 2))],
        "version int, path string, url string, entries long, fetched_at timestamp",
    )
    meta.write.mode("append").parquet(f"{root}/meta")
    fallen = load_registry(spark, snapshots=root)
    assert fallen.origin == "bundled" and "invalid" in fallen.warning


def test_refresh_validates_first(spark, tmp_path):
    root, now = str(tmp_path / "s"), dt.datetime(2026, 6, 1, 12)
    good = stored(tmp_path, [GOOD])
    assert refresh(spark, root, good, now)["reason"] == "refreshed"
    assert refresh(spark, root, good, now + dt.timedelta(hours=23))["reason"] == "fresh"
    later = now + dt.timedelta(hours=24)
    for n, bad in enumerate(["{", "[]", '[{"id": "x"}]']):
        outcome = refresh(spark, root, stored(tmp_path, bad, f"b{n}.json"), later)
        assert outcome["reason"] == "error" and newest_snapshot(spark, root)["version"] == 1
    assert refresh(spark, root, good, now - dt.timedelta(hours=1))["reason"] == "refreshed"
    assert newest_snapshot(spark, root)["version"] == 2


def test_bundled_registry_is_healthy(spark):
    audit = registry_audit(read_entries(spark, BUNDLED), now="2026-06-06").first().asDict()
    assert audit.pop("entries") >= 13
    assert set(audit.values()) == {0}
    assert compile_rules(load_registry(spark).entries).rejected.count() == 0


def test_audit_counts(spark):
    from duskwatch.sources.registry import entries_of_json

    rows = [
        {**GOOD, "id": "d"}, {**GOOD, "id": "d", "sunset_date": "soon", "source": "s"},
        {**GOOD, "id": "e", "applies_to": ["t s"], "confidence": "inferred", "migration_url": "m"}, {"id": "f"},
        {**GOOD, "id": "g", "status": "deprecated", "sunset_date": "2026-02-30"},
    ]
    df = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(rows)], "n int, t string")
    got = registry_audit(entries_of_json(df, "t", "n"), now="2026-06-06").first().asDict()
    assert got == {
        "entries": 5, "duplicate_ids": 1, "dropped": 1, "bad_dates": 1, "bad_scopes": 1, "no_confidence": 3,
        "no_source": 3, "no_migration_url": 3, "status_date_mismatch": 2,
    }


def test_bad_regexes_are_set_aside(spark):
    registry = registry_from_rows(spark, [
        {**GOOD, "detect": {"patterns": ["ok", "(", "a**", "(?<=a+)b", "fine\\d"], "models": ["m(1)"]}}
    ])
    rules = compile_rules(registry)
    assert {r.source for r in rules.rejected.collect()} >= {"(", "a**"}
    kept = [r.regex_ord for r in rules.packs[0].orderBy("regex_ord").collect()]
    assert kept[0] == 0 and 1 in kept and 5 in kept
