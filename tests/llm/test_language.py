"""Cross-parsing against a search for every substring, and accuracy on texts never learned from."""

import random

import numpy as np
import pytest

from __spark_entry__ import queries
from duskwatch.llm.language import RUN, Automaton, Model, cut, has_letter, identify, identify_language, learn, normalised

MIDDLE = "/root/testdata/sf0.01"


def plain_phrases(text: bytes, sample: bytes) -> int:
    count = 0
    for start in range(0, len(text), RUN):
        rest = text[start : start + RUN]
        while rest:
            n = 1
            while n < len(rest) and rest[: n + 1] in sample:
                n += 1
            count, rest = count + 1, rest[n:]
    return count


@pytest.mark.parametrize("seed", range(4))
def test_phrases(seed):
    rng = random.Random(seed)
    letters = "abcdé "[: 3 + seed]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
    sample = make(600) or b"a"
    automaton = Automaton(sample)
    texts = [b"", make(5), make(RUN), make(RUN + 1), make(3 * RUN + 7), b"zz" + make(40) + b"\x00q", sample, make(1)]
    counts = np.zeros(len(texts), dtype=int)
    for runs, lengths, owner in cut(texts):
        np.add.at(counts, owner, automaton.phrases(runs, lengths))
    assert counts.tolist() == [plain_phrases(t, sample) for t in texts]


def test_more_runs_than_lanes(monkeypatch):
    import duskwatch.llm.language as module

    monkeypatch.setattr(module, "LANES", 3)
    model = Model((("a", b" the cat and the dog "), ("b", b" le chat et le chien ")))
    texts = ["the dog " * 200, "le chien " * 300, None, "the", "1 2", ""]
    assert [r[0] for r in identify(texts, model)] == ["a", "b", "und", "a", "und", "und"]


def test_ties_and_nothing_learned():
    both = Model((("a", b" same "), ("b", b" same ")))
    assert identify(["same"], both)[0][:2] == ("a", 0.0)
    assert identify(["same", None], Model(()))[0][:2] == ("und", 0.0)
    assert identify(["same"], Model((("a", b" x "),)))[0][:2] == ("a", 1.0)
    assert normalised("  \n ") == b"" and normalised("Été, 12 x") == " été x ".encode() and not has_letter("12 «»") and has_letter("é")


def test_held_out_accuracy(spark):
    want = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = queries()["op13_language_id"](spark, MIDDLE).collect()
    assert len(rows) == len(want)
    told = [r for r in rows if r.held_out and want[r.doc_id].lang is not None and len(want[r.doc_id].text or "") >= 100]
    right = sum(r.lang_pred == want[r.doc_id].lang for r in told)
    assert len(told) > 250 and right >= 0.98 * len(told)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(edge):
    model = learn(edge)
    assert [name for name, _ in model.samples] == ["en"] and all(len(s) <= 1 << 15 for _, s in model.samples)
    rows = identify_language(edge, model, keep=("lang", "kept")).collect()
    assert len(rows) == edge.count() and {r.kept for r in rows} == {"kept"}
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4) or r.symbols == 0) for r in rows)
    assert identify_language(edge.limit(0), model).collect() == [] and learn(edge.limit(0)).samples == ()


def test_samples_are_bounded(spark):
    rows = [(i, f"l{i % 3}", f"word{i} " * 400) for i in range(900)] + [(i, "l0", "copy of it " * 10) for i in range(900, 1200)]
    model = learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert [name for name, _ in model.samples] == ["l0", "l1", "l2"] and {len(s) for _, s in model.samples[1:]} == {1 << 15}
