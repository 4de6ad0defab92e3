"""Text expressions against plain Python re-statements on random texts."""

import random
import re
import time

from pyspark.sql import functions as F

from duskwatch.functions.text import (
    C_FAMILY, MARKUP, PYTHON, blank_comments, cite, line_hits, safe_text, suppressed_lines,
)


def blank_by_hand(src, syntax):
    """A character-by-character machine, independent of the token expression."""
    out, i, n = list(src), 0, len(src)

    def blank(a, b):
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        for t in syntax.triple:
            if src.startswith(t, i):
                end = src.find(t, i + 3)
                i = n if end < 0 else end + 3
                break
        else:
            if src[i] in syntax.strings:
                q, i = src[i], i + 1
                while i < n and src[i] != q:
                    i += 2 if src[i] == "\\" else 1
                i += 1
                continue
            for a, b in syntax.block:
                if src.startswith(a, i):
                    end = src.find(b, i + len(a))
                    stop = n if end < 0 else end + len(b)
                    blank(i, stop)
                    i = stop
                    break
            else:
                for mark in syntax.line:
                    if src.startswith(mark, i):
                        end = src.find("\n", i)
                        stop = n if end < 0 else end
                        blank(i, stop)
                        i = stop
                        break
                else:
                    i += 1
    return "".join(out)


def random_texts(alphabet, count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_comment_blanking_equals_state_machine(spark):
    cases = [
        (C_FAMILY, ["/", "*", "//", "/*", "*/", "'", '"', "`", "\\", "\n", "a", " ", "é"]),
        (PYTHON, ["#", "'", '"', "'''", '"""', "\\", "\n", "a", " "]),
        (MARKUP, ["<!--", "-->", "<", "-", ">", "!", "\n", "a"]),
    ]
    for syntax, alphabet in cases:
        texts = random_texts(alphabet, 4000, 7)
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = df.select("t", blank_comments(F.col("t"), syntax).alias("b")).collect()
        assert all(row.b == blank_by_hand(row.t, syntax) for row in got)


def test_large_text_keeps_length_and_lines(spark):
    big = ("x = 'a' // note\n/* many\nlines */ \"str\\\"ing\"\n" * 40000)
    df = spark.createDataFrame([(big,)], "t string")
    row = df.select(F.length(blank_comments(F.col("t"), C_FAMILY)).alias("n")).first()
    assert len(big) > 1_500_000 and row.n == len(big)


def hits_by_hand(text, regex, ignored, cap):
    found, seen = [], set()
    for m in re.finditer(regex, text):
        line = text.count("\n", 0, m.start()) + 1
        if line in seen:
            continue
        seen.add(line)
        if line in ignored:
            continue
        found.append((line, re.sub(r"\s+", " ", m.group()).strip()))
        if len(found) >= cap:
            break
    return found


def test_line_hits_equal_python_offsets(spark):
    regexes = [r"ab", r"a", r"b\na", r"[ab]+", r"a\s+b", r"(?=b)", r"b*", r"\n", r"x$|^a", r"(a)\1"]
    texts = random_texts(["a", "b", "\n", " ", "c"], 1200, 11)
    rows = [(t, r) for t in texts for r in regexes]
    df = spark.createDataFrame(rows, "t string, r string")
    ignored = F.array(F.lit(2), F.lit(5)).cast("array<int>")
    got = df.select("t", "r", line_hits(F.col("t"), F.col("r"), ignored, 3).alias("h")).collect()
    for row in got:
        # `$` is never used against a trailing newline: the registry's `$` becomes \z.
        if "$" in row.r:
            continue
        assert [tuple(h) for h in row.h] == hits_by_hand(row.t, row.r, {2, 5}, 3), (row.t, row.r)


def test_cap_counts_recorded_lines_only(spark):
    text = "\n".join(["a a"] * 80)
    df = spark.createDataFrame([(text,)], "t string")
    ignored = F.sequence(F.lit(1), F.lit(10))
    hits = df.select(line_hits(F.col("t"), "a", ignored, cap=50).alias("h")).first().h
    assert [h.line for h in hits] == list(range(11, 61))
    every = df.select(line_hits(F.col("t"), "a").alias("h")).first().h
    assert len(every) == 80


def test_very_many_matches_take_linear_time(spark):
    times = []
    for n in (20_000, 200_000):
        df = spark.createDataFrame([("a b a\n" * n,)], "t string")
        start = time.perf_counter()
        found = df.select(line_hits(F.col("t"), "a").alias("h")).select(F.size("h").alias("n"), F.element_at("h", -1).alias("last"))
        row = found.first()
        times.append(time.perf_counter() - start)
        assert (row["n"], row["last"].line) == (n, n)
    assert times[1] < 60


def test_marks_in_a_text_do_no_harm(spark):
    df = spark.createDataFrame([("a﷐b﷑\nab",)], "t string")
    row = df.select(line_hits(safe_text(F.col("t")), "b").alias("h")).first()
    assert [(h.line, h.text) for h in row.h] == [(1, "b"), (2, "b")]


def test_suppression_directives(spark):
    text = "a // dusk-ignore\nb\n// dusk-ignore-next-line\nc\nd # dusk-ignore\nxdusk-ignore\ndusk-ignored"
    df = spark.createDataFrame([(text,), ("nothing",)], "t string")
    rows = df.select(suppressed_lines(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [[1, 4, 5], []]


def test_citation_is_one_whole_line(spark):
    df = spark.createDataFrame([("  a\n\t b c  ",), ("x" * 300,)], "t string")
    got = [r.c for r in df.select(cite(F.col("t")).alias("c")).collect()]
    assert got == ["a b c", "x" * 300]


def test_line_hits_over_several_lines_and_on_one(spark):
    text = "a1 a2\nb\na3 (x\n y) a4 (z)\n(\n\n) a5\n\na6"
    rows = spark.createDataFrame([(text, [9])], "text string, ignored array<int>")

    def hits(regex, ignored=None, cap=None):
        return [tuple(h) for h in rows.select(line_hits(F.col("text"), regex, ignored, cap)).first()[0]]

    assert hits(r"a\d") == [(1, "a1"), (3, "a3"), (4, "a4"), (7, "a5"), (9, "a6")]
    assert hits(r"a\d", F.col("ignored"), 3) == [(1, "a1"), (3, "a3"), (4, "a4")]
    assert hits(r"a\d", F.col("ignored")) == [(1, "a1"), (3, "a3"), (4, "a4"), (7, "a5")]
    assert hits(r"\([^)]*\)|a[36]") == [(3, "a3"), (4, "(z)"), (5, "( )"), (9, "a6")]
    assert hits(r"(?=a5)|b\na") == [(2, "b a"), (7, "")]
