"""Column expressions over source text: comments, suppression directives, matches."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.fixed import (
    CLOSE_MARK,
    JS_BOUNDARY,
    JS_EXTENSIONS,
    JS_SPACE,
    OPEN_MARK,
    SUPPRESS_TOKEN,
)
from duskwatch.functions.binding import let


def _as_column(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


# --- TXT-1: comment blanking ------------------------------------------------------


@dataclass(frozen=True)
class CommentSyntax:
    """How one language family writes comments and strings."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    strings: tuple[str, ...] = ()
    triple: tuple[str, ...] = ()

    @property
    def openers(self) -> tuple[str, ...]:
        return tuple(open_ for open_, _ in self.block) + self.line

    def token_regex(self) -> str:
        """One alternation that cuts a text into strings, comments and everything else."""
        quoted = [rf"{t}.*?(?:{t}|\z)" for t in self.triple]
        quoted += [rf"{q}(?:[^{q}\\]++|\\.)*+(?:{q}|\\?\z)" for q in self.strings]
        comments = [rf"{re.escape(a)}.*?(?:{re.escape(b)}|\z)" for a, b in self.block]
        comments += [rf"{re.escape(mark)}[^\n]*+" for mark in self.line]
        starts = {t[0] for t in (*self.openers, *self.strings, *self.triple)}
        special = "".join(re.escape(c) for c in sorted(starts))
        return "(?s)" + "|".join([*quoted, *comments, f"[^{special}]++", "."])


C_FAMILY = CommentSyntax(line=("//",), block=(("/*", "*/"),), strings=("'", '"', "`"))
PYTHON = CommentSyntax(line=("#",), strings=("'", '"'), triple=('"""', "'''"))
MARKUP = CommentSyntax(block=(("<!--", "-->"),))
SYNTAX_BY_EXTENSION = {**{e: C_FAMILY for e in (*JS_EXTENSIONS, "go")}, "py": PYTHON}


def any_true(*tests: Column) -> Column:
    return reduce(operator.or_, tests)


def blank_comments(text: Column, syntax: CommentSyntax) -> Column:
    """Comments become spaces, newlines stay: every line and offset keeps its place."""

    def blank(token: Column) -> Column:
        is_comment = any_true(*[F.startswith(token, F.lit(o)) for o in syntax.openers])
        return F.when(is_comment, F.regexp_replace(token, r"[^\n]", " ")).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(syntax.token_regex()), F.lit(0))
    has_opener = any_true(*[F.contains(text, F.lit(o)) for o in syntax.openers])
    return F.when(has_opener, F.array_join(F.transform(tokens, blank), "")).otherwise(text)


def blank_comments_by_extension(
    text: Column, ext: Column, syntaxes: dict[str, CommentSyntax] | None = None
) -> Column:
    """Pick the comment syntax by extension; languages without one keep their text."""
    families: dict[CommentSyntax, list[str]] = {}
    for name, syntax in (SYNTAX_BY_EXTENSION if syntaxes is None else syntaxes).items():
        families.setdefault(syntax, []).append(name)
    result = None
    for syntax, names in families.items():
        branch = blank_comments(text, syntax)
        test = ext.isin(*names)
        result = F.when(test, branch) if result is None else result.when(test, branch)
    return text if result is None else result.otherwise(text)


# --- TXT-6: suppression directives ------------------------------------------------


def suppressed_lines(raw: Column, token: str = SUPPRESS_TOKEN) -> Column:
    """Line numbers (from 1) that a directive in the raw text silences."""
    same = f"{JS_BOUNDARY}{re.escape(token)}{JS_BOUNDARY}"
    following = f"{JS_BOUNDARY}{re.escape(token)}-next-line{JS_BOUNDARY}"

    def target(line: Column, index: Column) -> Column:
        named = F.when(line.rlike(following), index + 2).when(line.rlike(same), index + 1)
        return F.when(F.contains(line, F.lit(token)), named)

    lines = F.transform(F.split(raw, "\n"), target)
    none = F.array().cast("array<int>")
    return F.when(
        F.contains(raw, F.lit(token)), F.filter(lines, lambda n: n.isNotNull())
    ).otherwise(none)


# --- TXT-5, TXT-8, TXT-9, WIN-1, WIN-2: matches with their lines --------------------


def safe_text(text: Column) -> Column:
    """Free a text of the two marks that :func:`line_hits` puts around matches."""
    marked = F.contains(text, F.lit(OPEN_MARK)) | F.contains(text, F.lit(CLOSE_MARK))
    return F.when(
        marked, F.translate(text, OPEN_MARK + CLOSE_MARK, "\ufffd\ufffd")
    ).otherwise(text)


def cite(match: Column) -> Column:
    """The matched text as evidence keeps it: one line, no outer blanks, whole."""
    return F.trim(F.regexp_replace(match, f"[{JS_SPACE}]+", " "))


def _spans_lines(line: Column) -> Column:
    """Whether the last match that begins on a line of a fenced text ends on a later one."""
    tail = F.substring_index(line, OPEN_MARK, -1)
    return F.contains(line, F.lit(OPEN_MARK)) & ~F.contains(tail, F.lit(CLOSE_MARK))


def _on_one_line(fenced: Column) -> Column:
    """Every match drawn onto the line it begins on; its newlines follow it, so later lines keep their numbers."""

    def drawn(part: Column) -> Column:
        match = F.substring_index(part, OPEN_MARK, -1)
        newlines = F.octet_length(match) - F.octet_length(F.replace(match, F.lit("\n"), F.lit("")))
        moved = F.concat(
            F.substring_index(part, OPEN_MARK, 1), F.lit(OPEN_MARK), F.translate(match, "\n", " "), F.lit(CLOSE_MARK),
            F.repeat(F.lit("\n"), newlines),
        )
        return F.when(F.contains(part, F.lit(OPEN_MARK)), moved).otherwise(part)

    return F.array_join(F.transform(F.split(fenced, CLOSE_MARK, -1), drawn), "")


HIT = "array<struct<line:int,text:string>>"


def line_hits(text: Column, regex, ignored: Column | None = None, cap: int | None = None) -> Column:
    """``array<struct<line, text>>``: the first match of ``regex`` on each line of ``text``.

    One pass of the regex fences every match with marks; the lines of the fenced text tell where matches
    begin, and the first one is cut out of each line that has one. Matches may span lines and may be empty.
    Lines in ``ignored`` record nothing; ``cap``, if given, is how many lines are recorded. The cost grows
    with the text and its matches, never with their square.
    """
    fenced = F.regexp_replace(text, _as_column(regex), F.lit(f"{OPEN_MARK}$0{CLOSE_MARK}"))

    def first_on_line(line: Column, index: Column) -> Column:
        wanted = F.contains(line, F.lit(OPEN_MARK))
        if ignored is not None:
            wanted = wanted & ~F.array_contains(ignored, index + 1)
        match = F.substring_index(F.substring_index(F.substring_index(line, OPEN_MARK, 2), OPEN_MARK, -1), CLOSE_MARK, 1)
        return F.when(wanted, F.struct((index + 1).alias("line"), cite(match).alias("text")))

    def collect(lines: Column) -> Column:
        kept = F.filter(F.transform(lines, first_on_line), lambda hit: hit.isNotNull())
        return kept if cap is None else F.slice(kept, 1, cap)

    def walk(whole: Column) -> Column:
        found = let(
            F.split(whole, "\n", -1),
            lambda lines: F.when(F.exists(lines, _spans_lines), collect(F.split(_on_one_line(whole), "\n", -1))).otherwise(collect(lines)),
        )
        return F.when(F.contains(whole, F.lit(OPEN_MARK)), found).otherwise(F.array().cast(HIT))

    return let(fenced, walk)
