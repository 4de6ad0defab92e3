"""The parts that run inside tasks, against plain versions of themselves."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from duskwatch.llm import common
from duskwatch.llm.common import LOWER
from duskwatch.llm.decontamination import GAP, MATCH, MISMATCH, _best, align
from duskwatch.llm.lines import LineSets
from duskwatch.llm.packing import best_fit
from duskwatch.llm.pages import Page
from duskwatch.llm.passages import COST, GAIN, chains
from duskwatch.llm.personal import TAGS, Field, base_spans, shape, train
from duskwatch.llm.sharding import Shard, grow, layout


def test_local_alignment_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = max(
                0, table[i][j] + (MATCH if a[i] == b[j] else MISMATCH), table[i][j + 1] + GAP, table[i + 1][j] + GAP
            )
        assert _best(np.array(a), np.array(b))[0] == max(map(max, table))


def test_alignment_finds_place():
    assert align(np.array([1, 2, 3, 4]), np.array([9, 9, 1, 2, 8, 3, 4, 9])) == (7, 2, 7)


def test_chains_equal_the_quadratic_recurrence():
    rng = random.Random(2)
    for _ in range(100):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
        score = {}
        for x, y in anchors:
            score[x, y] = GAIN + max([0.0, *(s - COST * (x - u + y - v) for (u, v), s in score.items() if u < x and v < y)])
        best = chains(anchors)[0]
        value = GAIN * len(best) - COST * sum(c[0] - p[0] + c[1] - p[1] for p, c in itertools.pairwise(best))
        assert value == pytest.approx(max(score.values()))
        assert sorted(a for c in chains(anchors) for a in c) == anchors


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    items = [(rng.randrange(0, 60), rng.randrange(4), rng.randrange(30)) for _ in range(300)]
    placed = best_fit(items, 100)
    bins = []
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[i]
        fit = [(left, n) for n, (left, s, c) in enumerate(bins) if left >= size and source not in s and cluster not in c]
        if fit:
            n = min(fit)[1]
        else:
            bins.append((100, set(), set()))
            n = len(bins) - 1
        left, s, c = bins[n]
        assert placed[i] == (n, 100 - left)
        bins[n] = (left - size, s | {source}, c | {cluster})


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    field = Field({"x": 2, "d": 3})
    field.weights[:], field.moves[:] = rng.normal(size=field.weights.shape), rng.normal(size=field.moves.shape)
    lines = [["a"], ["a", "1"], ["1", "1", "a", "+"]]
    for words, path in zip(lines, field.decode(lines, {}), strict=True):
        emit = field.scores(field.ids([words], {}))[0]
        def score(tags):
            return sum(emit[t, k] for t, k in enumerate(tags)) + sum(field.moves[a, b] for a, b in itertools.pairwise(tags))
        assert tuple(path) == max(itertools.product(range(len(TAGS)), repeat=len(words)), key=score)


def test_field_learns_from_few_and_holds_on_others():
    rng = random.Random(5)
    def line():
        words = [rng.choice("the a of and is in that was".split()) for _ in range(8)]
        kind = rng.choice(["phone", "mail", "none"])
        if kind == "phone":
            words[3:3] = [f"+{rng.randrange(1, 99)}", f"({rng.randrange(100, 999)})", f"{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"]
        if kind == "mail":
            words[5] = f"{rng.choice('abc')}.{rng.randrange(99)}@mail.example.com"
        return " ".join(words), kind
    field = train([line()[0] for _ in range(300)])
    right = 0
    for text, kind in (line() for _ in range(200)):
        words = text.split()
        tags = field.decode([words], {})[0]
        want = [4 if kind == "phone" and i in (3, 4, 5) else 1 if kind == "mail" and i == 5 else 0 for i in range(len(words))]
        right += tags == want
    assert right >= 190


def test_shape_and_long_runs():
    assert (shape("+1"), shape("555-5433"), shape("Ééa"), shape("xxxxxx")) == ("+d", "ddd-D", "Xxx", "x+")
    assert base_spans("1" * 300_000 + "a" * 300_000 + "@b") == []
    assert base_spans("a@b@c.de f@g.h.i") == [(0, 2, 8), (0, 9, 16)]


def test_shape_is_of_the_whole_word():
    assert shape("a/" * 40 + "+1") == "x/" * 40 + "+d"


def _drawn(key: int, tree: tuple[Shard, ...]) -> int:
    def draw(level, ids):
        def u(i):
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(level.encode(), h)
            h = xxhash.xxh64_intdigest(i.to_bytes(4, "little", signed=True), h)
            return ((h >> 11) + 0.5) / (1 << 53)
        return max(ids, key=lambda i: (math.log(u(i)) / ids[i], i))
    total = lambda of, inside: {k: sum(s.weight for s in tree if of(s) == k) for k in sorted({of(s) for s in tree if inside(s)})}
    region = draw("region", total(lambda s: s.region, lambda s: True))
    rack = draw("rack", total(lambda s: s.rack, lambda s: s.region == region))
    return draw("shard", total(lambda s: s.shard, lambda s: s.rack == rack))


def test_draws_equal_plain_ones_and_moves_stay_in_the_changed_subtree(spark):
    from pyspark.sql import functions as F
    from duskwatch.llm.sharding import shard_of

    tree = layout(40)
    heavy = tuple(Shard(s.shard, s.region, s.rack, 2.0 if s.shard == 9 else 1.0) for s in tree)
    rows = spark.range(3000).select(
        "id", *[shard_of(F.col("id"), t).alias(n) for n, t in (("old", tree), ("grown", grow(tree)), ("heavy", heavy))]
    ).collect()
    of = {s.shard: s for s in tree}
    assert all(r.old == _drawn(r.id, tree) for r in rows[:300])
    assert {r.grown for r in rows if r.grown != r.old} == {40}
    for r in rows:
        a, b = of[r.old], of[r.heavy]
        if a.region != b.region:
            assert b.region == of[9].region  # the region that gained weight only takes
        elif a.rack != b.rack:
            assert b.rack == of[9].rack
        elif a.shard != b.shard:
            assert b.shard == 9


@pytest.mark.parametrize("html, text", [
    ("", ""), ("<p", "<p"), ("plain &lt;x&gt; &amp", "plain <x> &"), ("<div>" * 50_000 + "deep", "deep"),
    ("<body><article><p class=ad>Buy<p>Real\n  text<br>here<p>More<aside>left open</article><footer>f</footer>", "Real text here\n\nMore"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<body><div class=sidebar><div>a</div><p>b</div><article>x<p>Real</article>", "x\n\nReal"),
])
def test_pages(html, text):
    assert Page(html).text() == text


def test_densest_subtree_without_an_article_element():
    links = "".join(f"<li><a href=/{i}>Entry {i} of the list</a>" for i in range(20))
    body = "".join(f"<p>{'some words of the story ' * 12}{i}</p>" for i in range(5))
    page = f"<body><div class=q1><ul>{links}</ul></div><div class=q2><h1>Title</h1><div>{body}</div></div><div class=q3>{links}</div>"
    got = Page(page).text().split("\n\n")
    assert got[0] == "Title" and len(got) == 6 and got[5].endswith("4")


def _plain_words(texts):
    lower = [(row, number, line) for row, text in enumerate(texts) for number, line in enumerate((text or "").encode().translate(LOWER).split(b"\n"))]
    return [(word, row, number) for row, number, line in lower for word in line.split()]


@pytest.mark.parametrize("run", [7, 1 << 18])
def test_words_of_a_column_equal_split(monkeypatch, run):
    monkeypatch.setattr(common, "HASHED", run)
    texts = [None, "", "\n\n", "a", "B a\n\x0bb\tb é É", "x" * 3000, " y" * 999, None, "a b", "ab", "ba\n", "\na", "a\x85b c", " \r\n d"]
    for column, plain in ((pa.array(texts), texts), (pa.array(texts).slice(3, 8), texts[3:11]), (pa.array([], pa.string()), [])):
        words, rows, lines = common.column_words(column)
        expected = _plain_words(plain)
        assert list(zip(rows.tolist(), lines.tolist(), strict=True)) == [e[1:] for e in expected]
        named = dict(zip(words.tolist(), (e[0] for e in expected), strict=True))
        assert [named[w] for w in words.tolist()] == [e[0] for e in expected] and len(named) == len({e[0] for e in expected})


def test_line_sets_stand_by_rarity():
    rank = np.arange(1 << 20, dtype=np.int64).astype(np.uint8)
    texts = ["a b a c\n\nc b a a", None, "A b c"]
    sets = LineSets(pa.array(texts), rank)
    assert sets.rows.tolist() == [0, 0, 2] and sets.numbers.tolist() == [0, 2, 0] and sets.n.tolist() == [3, 3, 3]
    assert len(set(sets.ids().tolist())) == 1 and len(set(sets.bitmaps().tolist())) == 1
    assert [(rank[w & np.uint64((1 << 20) - 1)], w) for w in sets.items[:3]] == sorted((rank[w & np.uint64((1 << 20) - 1)], w) for w in sets.items[:3])


def test_bitmaps_of_lines_differ_in_no_more_bits_than_words():
    random.seed(5)
    lines = [" ".join(str(random.randrange(60 * 2 ** (i % 5))) for _ in range(random.randrange(1, 700))) for i in range(60)]
    sets = LineSets(pa.array(["\n".join(lines)]))
    plain = [set(line.split()) for line in lines]
    narrow, wide = sets.bitmaps().reshape(-1, 1), sets.wide().reshape(len(lines), -1)
    for a, b in itertools.combinations(range(len(lines)), 2):
        for maps in (narrow, wide):
            assert sum(int(x).bit_count() for x in (maps[a] ^ maps[b]).view(np.uint64)) <= len(plain[a] ^ plain[b])
