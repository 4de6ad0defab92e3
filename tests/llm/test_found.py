"""Edited test items, labels held out, main texts under odd names, secrets that are written nowhere."""

import pathlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from duskwatch.llm import personal
from duskwatch.llm.common import delete_folder, scratch, settled
from duskwatch.llm.decontamination import MATCH, align, contaminated
from duskwatch.llm.pages import Page
from duskwatch.llm.quality import judge_quality
from duskwatch.llm.secrets import secret_candidates
from duskwatch.session import shared_folder


@pytest.mark.parametrize("size", [15, 20, 40, 80])
def test_edited_items_are_found_like_without_seeds(spark, size):
    """Copies edited at random, of similarity 0.5 and more by an alignment without seeds."""
    rng, rows, items, want = random.Random(size), [], [], set()
    common = [f"c{i}" for i in range(60)]
    fresh = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(10**9)}"
    codes = {}
    number = lambda words: __import__("numpy").array([codes.setdefault(w, len(codes)) for w in words])
    for n in range(150):
        item = [fresh() for _ in range(size)]
        items.append((n, " ".join(item)))
        copy = list(item)
        for _ in range(rng.randrange(0, size // 3 + 1)):
            at, what = rng.randrange(len(copy)), rng.random()
            if what < 0.7:
                copy[at] = fresh()
            elif what < 0.85:
                copy.insert(at, fresh())
            elif len(copy) > 5:
                del copy[at]
        if n % 5 == 0:
            copy = copy[: -(-len(copy) * 3 // 5)]
        text = [*(fresh() for _ in range(80)), *copy, *(fresh() for _ in range(80))]
        rows.append((n, " ".join(text)))
        if align(number(item), number(text))[0] >= 0.5 * MATCH * size:
            want.add((n, n))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, tests).collect()}
    assert len(want) > 75 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 2
    strict = {(r.doc_id, r.item_id) for r in contaminated(docs, tests, least=0.8).collect()}
    sure = {(r.doc_id, r.item_id) for r in contaminated(docs, tests).filter("similarity >= 0.8").collect()}
    assert strict == sure


def test_template_lines_of_small_hosts(spark):
    rows = [(i, ("a line of the house\n" if i < 7 else "") + " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = lambda n: {r.doc_id for r in judge_quality(docs, min_docs=n).collect() if r.gone}
    assert (gone(6), gone(7), gone(20)) == ({1, 2, 3, 4, 5, 6}, set(), set())


# --- personal data -------------------------------------------------------------------------------


def test_held_out_lines_like_those_of_the_table():
    """Lines with other numbers and names than those it learned from, and some with other words around."""
    lines = personal.TABLE.strip().split("\n")
    field = personal.train_on(*personal.labelled_table())
    test = [personal._varied(line, n) for line in lines for n in range(100, 103)]
    test += [re.sub(r"^\w+", "hence", line) for line in test]
    words, tags = (x[:: personal.VARIANTS + 1] for x in personal.labelled_table(test))
    assert len(words) == len(test)
    right = found = told = 0
    for got, want in zip(field.decode(words, {}), tags, strict=True):
        right += sum(g == w and w > 0 for g, w in zip(got, want, strict=True))
        found += sum(g > 0 for g in got)
        told += sum(w > 0 for w in want)
    assert right >= 0.9 * told and right >= 0.9 * found


def test_forms_that_no_fixed_rule_covers(spark):
    rows = [
        (1, "please call 030 7654321 after lunch"), (2, "mail to susan.baker [at] mail.org at once"), (3, "serial 4785380592391141 is not known"),
        (4, "the order 2023-0099345 was sent on 2024-06-17"), (5, "or to peter.miller(at)post.net, please"), (6, "nothing at all dot"),
        (7, "write a@b.org or call +1 (743) 555-3824 now"), (8, ""), (9, None),
    ]
    got = {r.doc_id: r for r in personal.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "crf_phone:12:23" and got[2].spans == "crf_email:8:33"
    assert got[5].spans == "crf_email:6:30"
    assert [got[i].n_added for i in (3, 4, 6, 7, 8, 9)] == [0] * 6 and (got[7].n_email, got[7].n_phone) == (1, 1)


def test_clean_documents_are_left_alone(spark, small):
    rows = personal.find_personal_data(small).collect()
    assert sum(r.n_added for r in rows) <= 0.01 * len(rows)


# --- pages ---------------------------------------------------------------------------------------

STORY = "".join(f"<p>Sentence {i} of the story, with some words that are all its own and go on for a while.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "layout-with-sidebar", "entry share-count", "main-content", "related"])
def test_names_do_not_take_whole_articles(name):
    page = f"<body><div class='site-nav'><a href=/a>a</a></div><div class='{name}'><h1>Title</h1>{STORY}</div><div class=site-footer>About us, all rights</div>"
    assert Page(page).text().startswith("Title\n\nSentence 0") and Page(page).text().endswith("for a while.") and "rights" not in Page(page).text()


def test_comments_and_links_to_other_stories_inside_an_article():
    links = "".join(f"<li><a href=/{i}>Another story number {i}</a></li>" for i in range(5))
    page = f"<body><article><h1>Title</h1>{STORY}<ul>{links}</ul><section id=comments><p>I do not think so.</p></section><p>Last words, with <a href=/x>a link</a>.</p></article>"
    text = Page(page).text()
    assert text.startswith("Title") and text.endswith("Last words, with a link.") and "Another story" not in text and "I do not think" not in text


def test_unclosed_tags_take_linear_time():
    times = []
    for n in (20_000, 200_000):
        begin = time.perf_counter()
        assert Page("<p>text " + "<a " * n).text().startswith("text")
        Page("<p>text " + "<a href='x " * n + ">")
        times.append(time.perf_counter() - begin)
    assert times[1] < 10


# --- scratch and secrets --------------------------------------------------------------------------


def test_scratch_ends_with_its_block(spark):
    folder = pathlib.Path(shared_folder(spark)) / "llm"
    before = set(folder.glob("*")) if folder.exists() else set()
    with scratch(spark) as keep:
        inner = settled(spark.range(5), "inner")
        with scratch(spark) as closer:
            result = closer(settled(inner.filter("id > 2"), "inmost"), "middle")
        kept = keep(result, "kept")
    assert [r.id for r in kept.orderBy("id").collect()] == [3, 4]
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["kept"]
    with pytest.raises(ValueError), scratch(spark):
        settled(spark.range(1), "lost")
        raise ValueError
    assert len(set(folder.glob("*")) - before) == 1
    delete_folder(spark, str(folder / "not-there"))


def test_values_of_secrets_are_written_nowhere(spark):
    value = "A9f3Kq81Zx7Lm2Pw5Rt6Yb4Nc0"
    docs = spark.createDataFrame([(1, f"token = {value}", "o", "r")], "doc_id long, text string, owner string, repo string")
    folder = pathlib.Path(shared_folder(spark)) / "llm"
    with scratch(spark):
        rows, spans = secret_candidates(docs, "doc_id", "text", F.col("repo"), F.col("owner"))
        assert spans.count() == 2 and "value" not in spans.columns
        stored = b"".join(p.read_bytes() for p in folder.rglob("*.parquet"))
        assert value.encode() not in stored and not re.search(rb"A9f3Kq81", stored)
