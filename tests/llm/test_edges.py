"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import prose
from duskwatch.llm.decontamination import contaminated, decontaminate
from duskwatch.llm.jaccard import near_duplicates, one_of_each
from duskwatch.llm.lines import count_later_lines, dedup_lines
from duskwatch.llm.packing import pack_documents
from duskwatch.llm.pages import extract_main_text
from duskwatch.llm.passages import can_hold, repeated_passages
from duskwatch.llm.personal import find_personal_data
from duskwatch.llm.quality import judge_quality, keep_quality
from duskwatch.llm.secrets import scan_secrets
from duskwatch.llm.sharding import grow, hash_tree_shards, layout


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(20)), (2, None), (3, ""), (4, prose(20))], "item_id long, text string")


OPERATORS = {
    "secrets": lambda d, i: scan_secrets(d, F.col("lang"), F.col("source")),
    "quality": lambda d, i: judge_quality(d),
    "shards": lambda d, i: hash_tree_shards(d, layout(4), grow(layout(4))),
    "lines": lambda d, i: count_later_lines(d),
    "near": lambda d, i: near_duplicates(d),
    "personal": lambda d, i: find_personal_data(d),
}
KEEPERS = {
    "quality": lambda d, i: keep_quality(d), "lines": lambda d, i: dedup_lines(d), "near": lambda d, i: one_of_each(d),
    "leaks": lambda d, i: decontaminate(d, i),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(name, edge, items):
    assert len(OPERATORS[name](edge, items).collect()) == edge.count()
    assert OPERATORS[name](edge.limit(0), items).collect() == []


@pytest.mark.parametrize("name", KEEPERS)
def test_columns_stay(name, edge, items):
    got = KEEPERS[name](edge, items)
    assert got.columns == edge.columns
    got.collect()
    assert KEEPERS[name](edge.limit(0), items).collect() == []


def test_near_duplicates(edge):
    rows = near_duplicates(edge).collect()
    of = {r.doc_id: r for r in rows}
    assert of[6].component_id == 1 and of[8].component_id == 7 and of[5].component_id == 5
    assert (of[2].n_shingles, of[2].component_id, of[3].component_id, of[4].component_id) == (0, 2, 3, 4)
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]


def test_leaks(edge, items):
    got = {(r.doc_id, r.item_id) for r in contaminated(edge, items).collect()}
    assert got == {(d, i) for d in (1, 6) for i in (1, 4)}
    assert contaminated(edge, items.limit(0)).collect() == []
    assert {r.doc_id for r in decontaminate(edge, items).collect()} == {None, 2, 3, 4, 5, 7, 8, 9}


def test_edited_copies_are_found(spark):
    item = prose(40).split()
    edited = item[:7] + ["other"] + item[8:20] + ["words", "here"] + item[20:31] + item[33:]
    docs = spark.createDataFrame([(1, prose(200, 3) + " " + " ".join(edited) + " " + prose(100, 4)), (2, prose(300, 5))], "doc_id long, text string")
    rows = contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word) for r in rows] == [(1, 7, 200)] and 0.7 < rows[0].similarity < 1


def test_packing(edge):
    rows = pack_documents(edge, capacity=1000).collect()
    assert sum(r.piece_words for r in rows) == 60 * 4 + 30_000 + 3 and sum(r.piece == 0 for r in rows) == edge.count()
    assert pack_documents(edge.limit(0)).collect() == []


def test_passages(edge, spark):
    assert {(r.doc_id, r.first_doc_id) for r in repeated_passages(edge).collect()} == {(6, 1)}
    assert repeated_passages(edge.limit(0)).collect() == []
    passage = prose(80).split()
    edited = passage[:30] + ["new"] + passage[31:60] + passage[61:]
    docs = spark.createDataFrame([
        (1, prose(90, 8) + " " + " ".join(passage) + " " + prose(90, 9)), (2, prose(50, 11) + " " + " ".join(edited) + " " + prose(70, 12)),
    ], "doc_id long, text string")
    (r,) = repeated_passages(docs).collect()
    assert (r.doc_id, r.first_doc_id, r.start_word, r.end_word, r.first_start, r.first_end) == (2, 1, 50, 129, 90, 170)


@pytest.mark.parametrize("length, every, share", [(50, None, 0.1), (50, None, 0.15), (50, None, 0.2), (80, None, 0.15), (120, None, 0.2), (50, 10, 0), (50, 5, 0)])
def test_edited_passages_are_found_like_brute_force(spark, length, every, share):
    """Pairs of documents that share one passage, edited in places chosen by chance or evenly; alike by a full comparison."""
    rng, rows, n = random.Random(length + int(100 * share)), [], 40
    fresh = lambda: f"w{rng.randrange(10**9)}"
    for pair in range(n):
        passage = [fresh() for _ in range(length)]
        at = range(every - 1, length - 1, every) if every else rng.sample(range(1, length - 1), round(share * length))
        edited = [fresh() if i in at else w for i, w in enumerate(passage)]
        assert sum(a == b for a, b in zip(passage, edited, strict=True)) >= 0.8 * length
        for key, middle in ((pair, passage), (n + pair, edited)):
            rows.append((key, " ".join([*(fresh() for _ in range(60)), *middle, *(fresh() for _ in range(60))])))
    got = {(r.doc_id, r.first_doc_id) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(n + p, p) for p in range(n)} and len(got) >= 0.95 * n


def test_passages_over_parts_of_two_documents(spark):
    one, two = prose(30, 21), prose(30, 22)
    rows = [
        (1, prose(90, 31) + " " + one + " " + prose(90, 32)), (2, prose(90, 33) + " " + two + " " + prose(90, 34)),
        (3, prose(40, 35) + f" {one} {two} " + prose(70, 36)), (4, prose(80, 37) + f" {one} {two} " + prose(50, 38)),
    ]
    (r,) = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (r.doc_id, r.first_doc_id, r.start_word, r.end_word, r.first_start, r.first_end, r.matched) == (4, 3, 80, 140, 40, 100, 60)


def test_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in extract_main_text(pages).collect()) == [("", 0)] * 3 + [("a", 1)]
    assert extract_main_text(pages.limit(0)).collect() == []


def test_template_lines_go_and_copies_do_not(spark):
    rows = [(i, "Menu of the site home about\n" + prose(60, i), "h") for i in range(60)]
    rows += [(100 + i, prose(70, 77) + "\nlast line of a copied text", "h") for i in range(40)]
    rows.append((200, "Menu of the site home about\n" * 12 + "and little else", "h"))
    judged = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert judged[0].gone == [] and all(judged[i].gone == [0] and judged[i].kept for i in range(1, 60))
    assert all(judged[100 + i].gone == [] and judged[100 + i].kept for i in range(40))
    assert not judged[200].kept


@pytest.mark.parametrize("size", [250, 500])
def test_license_lines_of_a_large_host_go(spark, size):
    licensed = "Licensed to all under the terms below\n"
    rows = [(i, (licensed if i % 10 == 0 else "") + prose(60, i), "h") for i in range(size)]
    rows += [(1000 + i, (licensed if i < 20 else "") + prose(60, i), "few") for i in range(25)]
    judged = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, r in judged.items() if r.gone} == set(range(10, size, 10))  # the first document keeps it, 20 are too few
    assert all(r.kept and r.n_template_words == 7 for r in judged.values() if r.gone)


def test_written_out_addresses_need_no_digit(spark):
    rows = [(i, f"please write to {n}.{n}@mail.org for more of it") for i, n in enumerate(("jane", "peter", "alice", "robert", "maria") * 12)]
    rows += [(100, "please write to susan.baker(at)mail.org for more of it"), (101, "a line\nplease write to susan.baker(at)mail.org for more of it\n1 more")]
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[100], got[101]) == ("crf_email:16:39", "crf_email:23:46")


def test_copied_secrets_and_own_ones(spark):
    key = "A9f3Kq81Zx7Lm2Pw5Rt6Yb4Nc0"
    rows = [(i, f"token = {key}a", f"o{i}", "r") for i in range(5)] + [(9, f"token = {key}b see {key}Own1", "o9", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in scan_secrets(docs, F.concat("owner", "repo"), F.col("owner")).collect()}
    assert all((got[i].n_live, got[i].n_copied, got[i].most_owners) == (0, 1, 5) for i in range(5))
    assert got[9].n_live == 2 and got[9].spans.endswith(f"owned:40:{40 + len(key) + 4}")


def test_no_edited_passage_is_lost_for_want_of_seeds(spark):
    """Ten of 50 words replaced leave runs of four and three words: seven 4-mers, of which a share by chance holds fewer than two now and then."""
    runs, rows, wanted = [4, 3, 4, 4, 3, 4, 3, 4, 4, 3, 4], [], []
    for n in range(120):
        words, at = [f"w{n}x{i}" for i in range(50)], -1
        edited = list(words)
        for run in runs[:-1]:
            at += run + 1
            edited[at] = f"other{n}x{at}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(edited))]
        wanted.append((2 * n + 1, 2 * n, 40))
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "first_doc_id", "matched")
    assert sorted(map(tuple, found.collect())) == wanted


@pytest.mark.parametrize("edits", [[], [7], [4, 9, 14, 19, 24, 29, 34, 39, 44, 48]])
def test_passages_whose_seeds_lead_to_other_documents(spark, edits):
    """A passage made of two parts that earlier documents hold each, copied with the words changed where the parts meet."""
    rows, wanted = [], []
    for n in range(20):
        passage = [f"p{n}x{i}" for i in range(60)]
        edited = [f"new{n}x{i}" if i in (27, 31, *edits[:8]) else word for i, word in enumerate(passage)]
        around = lambda key, words, n=n: " ".join([*(f"a{n}x{key}x{i}" for i in range(70)), *words, *(f"z{n}x{key}x{i}" for i in range(70))])
        for key, words in enumerate((passage[:30], passage[30:], passage, edited)):
            rows.append((10 * n + key, around(key, words)))
        wanted.append((10 * n + 3, 10 * n + 2))
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_doc_id) for r in found) == wanted
    assert all(70 <= r.start_word and r.end_word <= 130 and r.end_word - r.start_word >= 50 for r in found)


def test_frequent_lines_and_runs_of_one_word_are_no_passages(spark):
    line = "Licensed to all under the terms that are given below"
    rows = [(i, prose(70, 100 + i) + f" {line} " + prose(40, 300 + i) + " the" * 30 + " " + prose(70, 500 + i)) for i in range(40)]
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_runs_that_edits_can_explain():
    """By hand: ten edits break forty of 47 k-mers in fours, not forty of which one group has five."""
    broken = np.zeros(47, dtype=bool)
    broken[:40] = True
    assert can_hold(broken, 4, 47, 10).tolist() == [True]
    broken[43] = True
    assert can_hold(broken, 4, 47, 10).tolist() == [False]
    assert can_hold(broken[:46], 4, 47, 10).tolist() == []
