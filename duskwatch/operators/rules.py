"""Rules: one row per regex of a pattern entry, ready to meet files."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.regexes import (
    UnsupportedRegex,
    model_regex,
    pieces_regex,
    rarest_piece,
    required_literal,
    to_java,
)

ANY_SCOPE = "*"
# A pack is what one broadcast carries. Larger registries run as several packs.
PACK_ROWS = 20_000
PACK_BYTES = 4 * 1024 * 1024

_PACK = pa.schema([
    ("scope", pa.string()), ("piece", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("regex", pa.string()),
    ("required", pa.string()), ("regex_ord", pa.int32()), ("sdk_gate", pa.list_(pa.string())),
])
_REJECTED = pa.schema([("id", pa.string()), ("kind", pa.string()), ("source", pa.string()), ("reason", pa.string())])
#: Up to so many pieces a text is searched for just these; beyond, every three characters of it are looked up.
TRIE_PIECES = 400


@dataclass(frozen=True)
class RuleSet:
    """Compiled rules in packs of bounded size, keyed by language scope and a piece of a literal that the rule needs."""

    packs: list[DataFrame]
    scopes: tuple[str, ...]
    gated: bool
    rejected: DataFrame
    pieces: tuple[str, ...] = ()
    loose: bool = True  # some rule needs no literal: every text meets it under the empty piece

    def scope_of(self, ext: Column) -> Column:
        """The join key of a file: its extension where some entry names it, else any."""
        if not self.scopes:
            return F.lit(ANY_SCOPE)
        return F.when(ext.isin(*self.scopes), ext).otherwise(F.lit(ANY_SCOPE))

    def pieces_of(self, text: Column) -> Column:
        """The pieces of literals that a text holds, each once: the keys under which it meets rules."""
        always = F.array(F.lit("")) if self.loose else F.array().cast("array<string>")
        if not self.pieces:
            return always
        regex = pieces_regex(self.pieces) if len(self.pieces) <= TRIE_PIECES else r"(?s)(?=(...))"
        return F.array_distinct(F.concat(always, F.regexp_extract_all(text, F.lit(regex), F.lit(1))))


def _refused(spark: SparkSession, regexes: list[str]) -> dict[str, str]:
    """The expressions that Java does not compile, and why."""
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    refused = {}
    for regex in regexes:
        try:
            pattern.compile(regex)
        except (Py4JJavaError, PySparkException) as error:
            refused[regex] = str(error).splitlines()[0]
    return refused


def _packs(rows: list[dict]) -> list[list[dict]]:
    packs, size = [[]], 0
    for row in rows:
        width = sum(len(str(value)) for value in row.values())
        if packs[-1] and (len(packs[-1]) >= PACK_ROWS or size + width > PACK_BYTES):
            packs.append([])
            size = 0
        packs[-1].append(row)
        size += width
    return packs


def compile_rules(registry: DataFrame) -> RuleSet:
    """Regexes of the pattern entries, models first, each entry under every scope it names.

    The registry is configuration: only its regexes pass through the driver, where each is
    translated and compiled once. One that does not compile, or that a long text could make
    exhaust the stack, is set aside with the reason; the others run.
    """
    spark = registry.sparkSession
    wanted = registry.filter("match = 'pattern'").select(
        "id", "applies_to", "detect.sdk", "detect.models", "detect.patterns"
    )
    entries = wanted.collect()
    scopes = sorted({s.lower() for e in entries for s in e.applies_to} - {ANY_SCOPE})
    compiled, rejected = [], []
    for entry in entries:
        sources = [("model", m, model_regex(m), m or None) for m in entry.models]
        for pattern in entry.patterns:
            sources.append(("pattern", pattern, pattern, None))
        for order, (kind, shown, source, required) in enumerate(sources):
            try:
                required = required or required_literal(source)
                compiled.append((entry, kind, shown, to_java(source), required, order))
            except UnsupportedRegex as error:
                rejected.append({"id": entry.id, "kind": kind, "source": shown, "reason": str(error)})
    refused = _refused(spark, sorted({c[3] for c in compiled}))
    rows = []
    for entry, kind, shown, regex, required, order in compiled:
        if regex in refused:
            rejected.append({"id": entry.id, "kind": kind, "source": shown, "reason": refused[regex]})
            continue
        names = {s.lower() for s in entry.applies_to}
        under = [*scopes, ANY_SCOPE] if ANY_SCOPE in names else sorted(names)
        for scope in under:
            rows.append(dict(
                scope=scope, piece=rarest_piece(required) or "", id=entry.id, kind=kind, regex=regex, required=required,
                regex_ord=order, sdk_gate=list(entry.sdk),
            ))
    packs = [
        spark.createDataFrame(pa.Table.from_pylist(pack, schema=_PACK)) for pack in _packs(rows)
    ]
    return RuleSet(
        packs=packs,
        scopes=tuple(scopes),
        gated=any(len(e.sdk) > 0 for e in entries),
        rejected=spark.createDataFrame(pa.Table.from_pylist(rejected, schema=_REJECTED)),
        pieces=tuple(sorted({row["piece"] for row in rows} - {""})),
        loose=any(not row["piece"] for row in rows),
    )
