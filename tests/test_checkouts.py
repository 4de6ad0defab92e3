"""The data source of checkouts: what it lists, what it opens, what it takes over from a query."""

import pytest

import duskwatch.sources.checkouts as module
from conftest import plan_of
from duskwatch.sources.checkouts import CheckoutReader, Wanted, open_files, scan_checkouts
from duskwatch.sources.files import read_checkouts, select_sources

FILES = {
    "r1/src/a.js": b"x\xff", "r1/src/deep/b.py": b"", "r1/.git/config": b"[core]", "r1/.git/objects/ab/cd.js": b"o", "r1/node_modules/m/i.js": b"n",
    "r1/node_modules/m/package.json": b"{}", "r1/vendor/v.go": b"v", "r1/vendor/x/package.json": b"{}", "r1/.github/workflows/w.yml": b"w", "r1/.hid/z.js": b"z",
    "r2/.git": b"gitdir: x", "r2/__init__.py": b"", "r2/big.js": b"y" * 50, "r2/go.mod": b"z" * 50, "top.js": b"",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text)
    (tmp_path / "r2" / "link.js").symlink_to(tmp_path / "r2" / "big.js")
    (tmp_path / "r2" / "linked").symlink_to(tmp_path / "r1")
    return str(tmp_path)


USUAL = {"r1/src/a.js", "r1/src/deep/b.py", "r1/.git/config", "r1/vendor/x/package.json", "r1/.github/workflows/w.yml", "r2/.git", "r2/__init__.py", "r2/big.js", "r2/go.mod"}
DEPS = USUAL | {"r1/node_modules/m/i.js", "r1/node_modules/m/package.json", "r1/vendor/v.go", "r1/.hid/z.js"}


def names(df):
    return {f"{r.repo}/{r.path}" for r in df.collect()}


@pytest.mark.parametrize("address", ["{}", "file://{}"])
def test_files_and_texts(spark, root, address):
    rows = scan_checkouts(spark, address.format(root)).collect()
    assert {f"{r.repo}/{r.path}": r.content for r in rows} == {n: FILES[n].decode("utf-8", "replace") for n in USUAL}
    assert all(r.size == len(FILES[f"{r.repo}/{r.path}"]) for r in rows)
    assert names(scan_checkouts(spark, address.format(root), include_deps=True, partitions=2)) == DEPS
    assert names(scan_checkouts(spark, address.format(root), max_bytes=40)) == USUAL - {"r2/big.js"}


def test_equals_the_other_reader(spark, root):
    for deps in (False, True):
        want = select_sources(read_checkouts(spark, root), include_deps=deps).filter("path not like '.git/%'")
        assert names(select_sources(scan_checkouts(spark, root, include_deps=deps), include_deps=deps)) == names(want)


def test_nothing_of_pruned_folders_is_listed(root, monkeypatch):
    listed = []
    original = module.list_folder
    monkeypatch.setattr(module, "list_folder", lambda files, path: (listed.append(path), original(files, path))[1])

    def run(wanted):
        listed.clear()
        reader = CheckoutReader(root, wanted, 100)
        rows = [b for p in reader.partitions() for b in reader.read(p)]
        return {f"{r['repo']}/{r['path']}" for b in rows for r in b.to_pylist()}, {p.removeprefix(root).strip("/") for p in listed}

    found, folders = run(Wanted())
    assert found == USUAL and not any(".git/" in f + "/" or "node_modules" in f for f in folders)
    found, folders = run(Wanted(prefixes=("src/deep/",)))
    assert found == {"r1/src/deep/b.py"} and folders == {"", "r1", "r2", "r1/src", "r1/src/deep"}
    found, folders = run(Wanted(repos=frozenset({"r2"})))
    assert found == {n for n in USUAL if n.startswith("r2/")} and folders == {"", "r2"}
    assert run(Wanted(repos=frozenset()))[0] == set()


def test_conditions_are_taken_over(spark, root):
    df = scan_checkouts(spark, root).filter("repo = 'r1' and path like 'src/%' and size < 5")
    assert names(df) == {"r1/src/a.js", "r1/src/deep/b.py"}
    assert "Filter" not in plan_of(df.filter("path like '%.js'")).replace("PushedFilters", "") or names(df.filter("path like '%.js'")) == {"r1/src/a.js"}
    assert names(scan_checkouts(spark, root).filter("size >= 50 and size <= 50 and repo in ('r2', 'r9')")) == {"r2/big.js", "r2/go.mod"}
    assert names(scan_checkouts(spark, root).filter("path rlike 'deep' or repo is null")) == {"r1/src/deep/b.py"}


def test_addresses():
    files, path = open_files("file:///tmp")
    assert path == "/tmp" and files.type_name == "local"
