"""Source divergence against a plain count over every term and pair."""

import collections
import re

import numpy as np
import pytest

from duskwatch.llm.divergence import TermTree, audit_sources

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=3, best=200):
    """The contract word for word, on Python's whole numbers."""
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [(s, words) for at, s, words in docs if at == lang]
        held = collections.Counter(w for _, words in own for w in set(words))
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = {s: collections.Counter() for s, _ in own}
        for s, words in own:
            counts[s].update(w for w in words if held[w] >= least)
        total = sum(counts.values(), collections.Counter())

        def share(c):
            size = sum(c.values()) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // size for w in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, upto in (("pair", pairs, None), ("term", terms, best)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:upto], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def got(df, **options):
    rows = [tuple(r) for r in audit_sources(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(small):
    rows = [(r.lang, r.source, r.text) for r in small.collect()]
    assert got(small) == plain(rows)


def test_edge_cases(edge):
    rows = [(r.lang, r.source, r.text) for r in edge.collect()]
    found = got(edge)
    assert found == plain(rows) and any(r[0] == "" for r in found)
    assert got(edge, least_docs=1, best_terms=3) == plain(rows, 1, 3)
    assert got(edge, least_docs=1000) == plain(rows, 1000)
    assert got(edge.limit(0)) == set()


def test_ties_and_letters(spark):
    rows = [
        ("x", "a", "Été été ÉTÉ one ONE two"), ("x", "b", "one two één"), ("x", "c", None), ("x", "é", "one\x00two one-two_one"),
        ("x", "b", "one two one"), (None, "a", "one"), ("x", None, "two two Two 12 été"), ("y", "a", "1 2 3"), ("y", "b", ""),
    ]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for least in (1, 2, 3):
        assert got(df, least_docs=least) == plain(rows, least)


def test_shared_paths_are_worked_out_once():
    rows = [(0, 5, 3), (1, 7, 3)], [(0, 5, 2), (1, 7, 2), (2, 9, 2)], [(0, 5, 1), (2, 4, 1)], [(1, 7, 1), (2, 4, 1)]
    flat = lambda i: np.array([e[i] for r in rows for e in r])
    tree = TermTree(np.array([len(r) for r in rows]), flat(0), flat(1), np.array([r[0][2] for r in rows]), np.array([1, 2, 1]))
    assert tree.parent.tolist() == [-1, 0, 1, 2, 1, 0, 5] and tree.many.tolist() == [0, 6, 5, 2, 1, 1, 1]
    f = lambda p, q: (p - q) ** 2 // q
    g = lambda p, q, p0, q0: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    want = {
        0 * 3 + 1: 5 * g(5, 7, 1, 2), 1 * 3 + 0: 5 * g(7, 5, 2, 1), 0 * 3 + 2: 2 * g(5, 9, 1, 1) + g(5, 4, 1, 1), 2 * 3 + 0: 2 * g(9, 5, 1, 1) + g(4, 5, 1, 1),
        1 * 3 + 2: 2 * g(7, 9, 2, 1) + g(7, 4, 2, 1), 2 * 3 + 1: 2 * g(9, 7, 1, 2) + g(4, 7, 1, 2),
    }
    pairs, sums = tree.corrections()
    assert dict(zip(pairs.tolist(), sums.tolist(), strict=True)) == want


@pytest.mark.parametrize("nodes", [1, 4])
def test_cut_trees_add_up(small, monkeypatch, nodes):
    import duskwatch.llm.divergence as module

    monkeypatch.setattr(module, "TREE_NODES", nodes)
    rows = [(r.lang, r.source, r.text) for r in small.limit(40).collect()]
    assert got(small.limit(40)) == plain(rows)
