"""Every stage of the pipeline against a plain version, each on the rows its predecessor kept."""

import math
import re

import duckdb
import pytest

import corpus_pipeline
from duskwatch.llm import sql
from duskwatch.llm.common import settled

SMALL = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, SMALL), f"test-{name}")
        out.append(docs.collect())
    return out


def frame(rows):
    import pandas as pd

    return pd.DataFrame([r.asDict() for r in rows], columns=COLUMNS)


def plain(text):
    return text.encode().translate(LOWER).split()


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "best_fit_packing"
    ]


def test_columns_and_counts(kept):
    for rows in kept[1:5]:
        assert rows and list(rows[0].asDict()) == COLUMNS and all(r.n_chars == len(r.text) and WORD.search(r.text) for r in rows)
        assert len({r.doc_id for r in rows}) == len(rows)


def test_quality(kept):
    documents = frame(kept[0])  # noqa: F841  read by name
    judged = {r[0]: r[7] for r in duckdb.sql(sql.QUALITY).fetchall()}
    assert {r.doc_id for r in kept[1]} == {d for d, keep in judged.items() if keep}
    before = {r.doc_id: r.text for r in kept[0]}
    assert all(set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) for r in kept[1])


def test_lines(kept):
    documents = frame(kept[1])  # noqa: F841
    gone = {r[0]: {int(n) for n in r[3].split(",") if n} for r in duckdb.sql(sql.LINES).fetchall()}
    want = {}
    for r in kept[1]:
        text = "\n".join(line for n, line in enumerate(r.text.split("\n")) if n not in gone[r.doc_id])
        if WORD.search(text):
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in kept[2]} == want


def test_one_of_each(kept):
    documents = frame(kept[2])  # noqa: F841
    assert {r.doc_id for r in kept[3]} == {r[0] for r in duckdb.sql(sql.COMPONENTS).fetchall() if r[0] == r[2]}


def similarity(item, text):
    table = [0] * (len(text) + 1)
    best = 0
    for a in item:
        last, diagonal = table[:], 0
        for j, b in enumerate(text, 1):
            table[j] = max(0, diagonal + (2 if a == b else -1), last[j] - 1, table[j - 1] - 1)
            diagonal = last[j]
        best = max(best, *table)
    return best / (2 * len(item))


def test_decontamination(spark, kept):
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stays = {r.doc_id for r in kept[4]}
    for r in kept[3]:
        words = plain(r.text)
        there = set(words)
        # Half the score needs half of the item's words somewhere in the text.
        close = [i for i in items if sum(w in there for w in i) >= 0.5 * len(i)]
        held = any(similarity(i, words) >= 0.5 for i in close)
        assert (r.doc_id in stays) == (not held), r.doc_id


def test_packing(kept):
    bins, words = {}, {}
    for r in kept[5]:
        bins.setdefault(r.bin, []).append(r)
        words[r.doc_id] = words.get(r.doc_id, 0) + r.piece_words
    assert words == {r.doc_id: len(WORD.findall(r.text)) for r in kept[4]}
    for rows in bins.values():
        assert len({r.source for r in rows}) == len({r.cluster for r in rows}) == len(rows) and sum(r.piece_words for r in rows) <= 1024
    assert len(bins) >= math.ceil(sum(words.values()) / 1024)
