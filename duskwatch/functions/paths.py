"""Column expressions over repo-relative paths and ignore globs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.fixed import DEPENDENCY_DIRS, SOURCE_EXTENSIONS, TEST_BASENAME, TEST_DIRS
from duskwatch.functions.binding import let
from duskwatch.functions.globs import any_glob_regex, compile_glob
from duskwatch.functions.text import js_trim


def raw_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_source(path: Column, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> Column:
    return raw_extension(path).isin(*extensions)


def in_dependency_dir(path: Column, dirs: tuple[str, ...] = DEPENDENCY_DIRS) -> Column:
    return path.rlike(rf"(?:^|/)(?:{'|'.join(re.escape(d) for d in dirs)})/")


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.")


def is_test_file(path: Column) -> Column:
    dirs = "|".join(TEST_DIRS)
    base = F.regexp_extract(path, r"[^/\\]*\z", 0)
    return path.rlike(rf"(?:^|[/\\])(?:{dirs})[/\\]") | base.rlike(TEST_BASENAME)


# --- globs -----------------------------------------------------------------------

GLOB_INDEX = "keys array<string>, rest array<struct<folder:string,regex:string>>"


def glob_regex(glob: Column, dot: bool = True) -> Column:
    """The regex of a column of globs, see :func:`duskwatch.functions.globs.compile_glob`."""

    @F.pandas_udf("string")
    def compiled(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: None if g is None else compile_glob(g, dot))

    return compiled(glob)


def path_keys(path: Column) -> Column:
    """What an index of globs is asked for a path: itself, the folders above it, its names and how they end."""
    named = lambda kind: lambda text: F.concat(F.lit(f"{kind}:"), text)

    def ends(name: Column) -> Column:
        parts = F.split(name, r"\.", -1)
        count = F.size(parts) - 1
        end = lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i + 1, count), "."))
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), end)).otherwise(F.array().cast("array<string>"))

    def keys(names: Column) -> Column:
        depth = F.size(names) - 1
        folders = F.transform(
            F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(names, 1, i), "/"))
        )
        last = F.element_at(names, -1)
        return F.concat(
            F.array(named("=")(path), named("b")(last)), F.when(depth > 0, folders).otherwise(F.array().cast("array<string>")),
            F.transform(names, named("n")), F.transform(ends(last), named("e")),
            F.transform(F.flatten(F.transform(names, ends)), named("x")),
        )

    return let(F.split(path, "/", -1), keys)


def in_glob_index(path: Column, keys: Column, rest: Column) -> Column:
    """Whether a path matches one of the globs of an index: by equality of keys; else by a regex, where the folders before it agree."""
    return F.arrays_overlap(path_keys(path), keys) | F.exists(
        rest, lambda r: F.startswith(path, r["folder"]) & F.rlike(path, r["regex"])
    )


def ignore_line_globs(line: Column) -> Column:
    """One line of an ignore file as ``array<string>`` of globs; comments give none."""
    trimmed = js_trim(line)
    bare = F.regexp_replace(trimmed, r"^/", "")
    body = F.regexp_replace(bare, r"/+\z", "")
    anchored = F.startswith(trimmed, F.lit("/"))
    base = F.when(anchored, body).otherwise(F.concat(F.lit("**/"), body))
    below = F.concat(base, F.lit("/**"))
    skipped = trimmed.rlike(r"^[#!]") | (body == "")
    return (
        F.when(skipped, F.array().cast("array<string>"))
        .when(F.endswith(bare, F.lit("/")), F.array(below))
        .otherwise(F.array(base, below))
    )


def ignore_file_globs(content: Column) -> Column:
    """The globs of a whole ignore file."""
    return F.flatten(F.transform(F.split(content, r"\r?\n"), ignore_line_globs))


def matches_any_glob(path: Column, globs) -> Column:
    """True where ``path`` matches one of the caller's globs, compiled here and now to one constant."""
    return F.rlike(path, F.lit(any_glob_regex(globs))) if globs else F.lit(False)
