"""Where the rules of a registry are met in source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.fixed import SUPPRESS_TOKEN
from duskwatch.functions.imports import gate_open, import_prefixes, imports_of, is_gateable
from duskwatch.functions.paths import extension
from duskwatch.functions.text import (
    blank_comments_by_extension,
    line_hits,
    safe_text,
    suppressed_lines,
)
from duskwatch.operators.rules import RuleSet


def prepare_sources(
    sources: DataFrame,
    rules: RuleSet,
    ext: Column | None = None,
    syntaxes=None,
    token: str | None = SUPPRESS_TOKEN,
    imports: Column | None = None,
    gateable: Column | None = None,
) -> DataFrame:
    """Per file, once: comment-free text, imports and suppressed lines, beside its rule scope.

    ``imports`` and ``gateable`` replace the built-in import parsing for other kinds of text; they
    may refer to the column ``text``.
    """
    ext = extension(F.col("path")) if ext is None else ext
    ignored = F.array().cast("array<int>") if token is None else suppressed_lines(F.col("content"), token)
    plain = sources.select(
        "repo", "path", ext.alias("ext"), rules.scope_of(ext).alias("scope"),
        safe_text(F.col("content")).alias("content"), ignored.alias("ignored"),
    )
    text = plain.select(
        "repo", "path", "ext", "scope", "ignored",
        blank_comments_by_extension(F.col("content"), F.col("ext"), syntaxes).alias("text"),
    )
    none = F.array().cast("array<string>")
    if not rules.gated:
        imports, gateable = none, F.lit(False)
    if imports is None:
        imports = imports_of(F.col("text"), F.col("ext"))
    if gateable is None:
        gateable = is_gateable(F.col("ext"))
    return text.withColumns({"imports": import_prefixes(imports) if rules.gated else imports, "gateable": gateable})


def match_prepared(prepared: DataFrame, rules: RuleSet, cap: int | None = None) -> DataFrame:
    """``hits(repo, id, file, kind, regex_ord, line, text, mention)``.

    A broadcast hash join meets files with rules: by the language scope and by three characters of a literal that the
    rule needs, which every text is searched for once, however many rules there are. Pairs that
    meet must hold the whole literal before any regex runs. Texts are never shuffled. A
    closed import gate stops an entry's patterns and turns its model ids into mentions. Every line
    counts; ``cap`` limits the lines recorded per regex and file for those who want that.
    """
    keyed = prepared.withColumn("piece", F.explode(rules.pieces_of(F.col("text"))))

    def run(pack: DataFrame) -> DataFrame:
        possible = F.col("required").isNull() | F.contains(F.col("text"), F.col("required"))
        pairs = keyed.join(F.broadcast(pack), ["scope", "piece"]).filter(possible)
        opened = pairs.withColumn(
            "opened", gate_open(F.col("imports"), F.col("sdk_gate"), F.col("gateable"))
        ).filter("opened or kind = 'model'")
        found = line_hits(F.col("text"), F.col("regex"), F.col("ignored"), cap)
        return opened.select(
            "repo", "id", F.col("path").alias("file"), "kind", "regex_ord",
            (~F.col("opened")).alias("mention"), F.explode(found).alias("hit"),
        ).select("repo", "id", "file", "kind", "regex_ord", "hit.line", "hit.text", "mention")

    return reduce(DataFrame.unionByName, [run(pack) for pack in rules.packs])


def match_usage(sources: DataFrame, rules: RuleSet, **options) -> DataFrame:
    """Hits of ``rules`` in ``sources(repo, path, content)``."""
    cap = options.pop("cap", None)
    return match_prepared(prepare_sources(sources, rules, **options), rules, cap)
