import json

import pytest
from pyspark.sql import functions as F

from duskwatch.sources import registry
from duskwatch.sources.documents import elements_of
from duskwatch.sources.registry import RegistryError, read_entries, validate_entries

ENTRIES = [
    {"id": f"e{n}", "t": ['}, {"', "[{]", 'a\\"}', "\\", "é}"][n % 5] * (n % 7), "in": {"a": [{"b": n}, {}, [{}]], "deprecations": [{"x": 1}]}} for n in range(120)
]
MIXED = [1, None, "}{", *ENTRIES[:9], [], {}, [{"a": {}}], *ENTRIES[9:30], True, 2.5]
OTHER = {"version": 1, "more": [{"a": {}}, {"deprecations": [{}]}], "keys": {"k": {"a": 1}, "l": {}}, "s": 'a "deprecations": [{}'}
SHAPES = {
    "bare": ENTRIES, "mixed": MIXED, "object": {"deprecations": ENTRIES}, "between": {**OTHER, "deprecations": MIXED, "later": [{}, {"z": {}}], "end": {"k": {}}},
    "empty": {**OTHER, "deprecations": []}, "plain": [1, 2, 3],
}


@pytest.mark.parametrize("shape,indent", [("bare", None), ("mixed", 2), ("object", 2), ("between", None), ("empty", None), ("plain", None)])
def test_entries_of_a_document_read_in_splits(spark, tmp_path, monkeypatch, shape, indent):
    """With one value for all, a document of more than 16 MB was refused as broken."""
    document = SHAPES[shape]
    (tmp_path / "r.json").write_text(json.dumps(document, indent=indent) + "\n" * (indent or 0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4999")
    try:
        monkeypatch.setattr(registry, "WHOLE_DOCUMENT_BYTES", 0)
        rows = read_entries(spark, str(tmp_path / "r.json")).select("entry_ord", F.to_json("entry").alias("e")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = document if isinstance(document, list) else document["deprecations"]
    found = {r.entry_ord: json.loads(r.e) for r in rows}
    assert len(rows) == len(wanted) and [found[n] for n in range(len(wanted))] == wanted


@pytest.mark.parametrize("text", [
    "{", '"text"', '{"deprecations": {}}', '[{"a": 1} {"b": 2}]', '[{"a": 1}, {"b": }, {}]', '{"deprecations": [{}, {}]', '[{}, {}], {}', '[{"a": "x}, {}]',
])
def test_broken_documents_read_in_splits(spark, tmp_path, monkeypatch, text):
    (tmp_path / "r.json").write_text(text)
    monkeypatch.setattr(registry, "WHOLE_DOCUMENT_BYTES", 0)
    with pytest.raises(RegistryError):
        read_entries(spark, str(tmp_path / "r.json")).count()


def test_a_registry_larger_than_one_value(spark, tmp_path):
    entry = {"vendor": "v", "title": "t" * 2000, "severity": "high", "detect": {"patterns": ["x"]}}
    with open(tmp_path / "r.json", "w") as out:
        json.dump({"deprecations": [{**entry, "id": f"e{n}"} for n in range(70_000)]}, out)
    found = validate_entries(read_entries(spark, str(tmp_path / "r.json"))).filter("id = concat('e', entry_ord)")
    assert found.count() == 70_000
    assert elements_of(spark, str(tmp_path / "r.json"), "deprecations").agg(F.max("entry_ord")).first()[0] == 69_999
