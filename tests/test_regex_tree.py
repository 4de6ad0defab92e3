"""Repeated groups are rewritten so that they match the same, or refused; then no text is too long for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from duskwatch import registry_from_rows
from duskwatch.functions.regexes import UnsupportedRegex, pieces_regex, rarest_piece, required_literal, to_java
from duskwatch.functions.text import line_hits
from duskwatch.operators.rules import compile_rules
from duskwatch.operators.usage import match_usage

REWRITTEN = [
    r"(?:a|b|\s)+x", r"(?:.|\n)*?z", r"(a|b)+\1", r"(?:ab|cd)+e", r"(?:[^()]|\([^()]*\))*\)", r"(?:a+)+b", r"(?:a*)+b", r"(?:\.\w+)+\(", r"(?:,\s*\w+)*\)",
    r"(?:foo|bar)+\b", r"(?:foo|bar)+$", r"(?:a|-|b)+c", r"(?:[a-c]|x|\-)+z", r"(?:[ab-]|c)+d", r"(?:[^a]|b)*c", r"x(?:ab|cd?e)*", r"(?:ab){2,}c", r"(?:(?:a|b)c)+d",
    r"(?:a|b){3,}c", r"(?:ab|ac){1,3}d", r"(?:ab|c)+?d",
]
REFUSED = [r"(?:ab|ac)+e", r"(?:\w+\s*)+x", r"(?:\w+,)*\w+", r"(?:a|ab)+c", r"(?:ab?)+b", r"(?:ab|c)+(?=d)", r"(?:ab|c)+?", r"(?:(?:ab|c)?)+", r"(?:(a)b|cd)+\1"]


@pytest.mark.parametrize("source", REWRITTEN)
def test_rewritten_expressions_match_the_same(spark, source):
    rng = random.Random(source)
    letters = sorted(set(re.findall(r"[a-fxz(),.\- ]", source)) | {"a", "b", "c", "\n"})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["foobar", "foobar x", "foobarx", "abcd", "aab"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = df.select("n", F.regexp_extract_all("t", F.lit(to_java(source)), F.lit(0)).alias("m")).collect()
    for r in got:
        assert r.m == [m[0] for m in re.finditer(source.replace("$", r"\Z"), texts[r.n])], texts[r.n]


@pytest.mark.parametrize("source", REFUSED)
def test_other_repeated_groups_are_refused(source):
    with pytest.raises(UnsupportedRegex, match="recursion"):
        to_java(source)


@pytest.mark.parametrize("source", ["(a", "a)", "[z-a]", "a{2,1}", "(?<=a)+"])
def test_what_does_not_parse_is_refused(source):
    with pytest.raises(UnsupportedRegex):
        to_java(source)


@pytest.mark.parametrize("size", [180_000, 10_000_000])
def test_long_texts_do_not_exhaust_the_stack(spark, size):
    sources = [r"(?:a|b|\s)+x", r"(?:ab |b)+x", r"(?:ab )+x", r"(?:.|\n)*x", r"(?:[^()]|\(b\))*\)"]
    df = spark.range(1).select(F.concat(F.repeat(F.lit("ab "), size // 3), F.lit("x)")).alias("t"))
    for source in sources:
        assert df.select(F.size(line_hits(F.col("t"), to_java(source))).alias("n")).first().n == 1


def test_reasons_are_told(spark):
    patterns = ["fine", "(", r"(?:a|ab)+c", r"(?<a>x)(?<a>y)", r"(?:a|b)+c"]
    rules = compile_rules(registry_from_rows(spark, [
        {"id": "e", "vendor": "v", "title": "t", "severity": "low", "detect": {"patterns": patterns}}
    ]))
    told = {r.source: r.reason for r in rules.rejected.collect()}
    assert set(told) == {"(", r"(?:a|ab)+c", r"(?<a>x)(?<a>y)"} and all(told.values())


# --- the index of literals --------------------------------------------------------------------------


def test_pieces_are_found_everywhere(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc.é\n") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    pieces = tuple(sorted({"abc", "abb", "aab", ".é\n", "b.c", "ccc", "cé."}))
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    for r in df.select("n", F.regexp_extract_all("t", F.lit(pieces_regex(pieces)), F.lit(1)).alias("m")).collect():
        assert r.m == [texts[r.n][i : i + 3] for i in range(len(texts[r.n])) if texts[r.n][i : i + 3] in pieces]


def test_rarest_piece():
    assert rarest_piece("client.legacyO(") in "client.legacyO(" and rarest_piece("ab") is None and rarest_piece(None) is None
    assert rarest_piece("the_Xq") == "_Xq" and required_literal(r"\bthe_Xq\b") == "the_Xq"


def _rules(spark, count):
    rng = random.Random(count)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    entries = [{"id": f"r{i}", "vendor": "v", "title": "t", "severity": "low", "detect": {"patterns": [rf"\b{name()}\.{name()}\("]}} for i in range(count)]
    entries.append({"id": "hit", "vendor": "v", "title": "t", "severity": "low", "detect": {"patterns": [r"\bneedle\.call\(", "[0-9]{7}"]}})
    return compile_rules(registry_from_rows(spark, entries))


def test_many_rules_cost_little_more_than_few(spark, tmp_path):
    import time

    body = " ".join(f"word{i % 97}.run({i});" for i in range(400))
    spark.range(600).selectExpr("'r' as repo", "concat('f', id, '.rb') as path", f"concat('{body}', if(id % 10 = 0, ' needle.call(1)', '')) as content").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    times = {}
    for count in (200, 20_000):
        hits = match_usage(files, _rules(spark, count))
        assert hits.count() == 60
        times[count] = min(_timed(hits, time) for _ in range(3))
    assert times[20_000] < 2 * times[200] + 1.0


def _timed(hits, time):
    begin = time.perf_counter()
    hits.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin
