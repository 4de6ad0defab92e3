"""Elements of a JSON document too large for one value: cut where objects end, parsed piece by piece."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskwatch.session import shared_folder

#: What a document may hold beside the objects of its arrays: keys, scalars and the edges of arrays.
FRAME_PIECES, FRAME_CHARS = 10_000, 64 * 1024 * 1024
#: Pieces whose elements are counted together.
CELL = 4_096
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]', re.DOTALL)


class BrokenDocument(ValueError):
    """The text is not valid JSON."""


class MissingArray(ValueError):
    """The document is neither an array nor an object with the array asked for."""


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]++", ""))


def _segments(spark: SparkSession, path: str, store: str) -> DataFrame:
    """A document's text between its closing braces, by file, split and place, with what it does to the nesting if it begins
    outside a string and if inside one."""
    read = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value"
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    shape = lambda text: F.regexp_replace(F.regexp_replace(text, r'"[^"]*+(?:"|\z)', ""), r"[^{\[\]]++", "")
    read.withColumns({"quotes": _count(bare, '"') % 2, "outside": shape(bare), "inside": shape(F.concat(F.lit('"'), bare))}).write.parquet(store)
    return spark.read.parquet(store).withColumn("turned", F.coalesce(F.sum("quotes").over(_earlier("f", "b")), F.lit(0)) % 2)


def _earlier(*key: str, order: str = "i"):
    return W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _delta(shape: Column, ends_inside: Column) -> Column:
    return _count(shape, r"{\[") - _count(shape, r"\]") - F.when(ends_inside, 0).otherwise(1)


def _starts(segments: DataFrame, sizes: dict[str, int]) -> tuple[list[tuple], set[str]]:
    """Per split: is its beginning inside a string, how deep is it, how deep do elements lie; and files that end with a brace."""
    after = (F.col("turned") + F.col("quotes")) % 2
    plain, other = F.when(F.col("turned") == 0, F.col("outside")).otherwise(F.col("inside")), F.when(F.col("turned") == 0, F.col("inside")).otherwise(F.col("outside"))
    found = segments.groupBy("f", "b").agg(
        F.sum("quotes").alias("quotes"), F.sum(_delta(plain, after == 1)).alias("plain"), F.sum(_delta(other, after == 0)).alias("other"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.min_by(F.substring(F.ltrim(F.regexp_replace(F.substring("value", 1, 4096), r"\s+", " ")), 1, 1), "i").alias("first"),
    )
    rows, state, closed = [], {}, set()
    for row in sorted(found.collect(), key=lambda r: (r.f, r.b)):
        inside, depth, base, length = state.get(row.f, (0, 0, {"[": 1, "{": 2}.get(row.first, 0), 0))
        rows.append((row.f, row.b, inside, depth, base))
        state[row.f] = ((inside + row.quotes) % 2, depth + (row.other if inside else row.plain), base, length + row.bytes)
    for f, (inside, depth, base, length) in state.items():
        if length == sizes[f]:
            closed.add(f)
        if inside or depth + (f not in closed) or not base:
            raise BrokenDocument
    return rows, closed


def _cut(segments: DataFrame, starts: DataFrame) -> DataFrame:
    """Segments with the least depth they reach, and whether one ends where an element may end."""
    met = segments.join(F.broadcast(starts), ["f", "b"])
    inside = (F.col("starts_inside") + F.col("turned")) % 2 == 1
    ends_inside = (F.col("starts_inside") + F.col("turned") + F.col("quotes")) % 2 == 1
    met = met.withColumn("shape", F.when(inside, F.col("inside")).otherwise(F.col("outside"))).withColumn("delta", _delta(F.col("shape"), ends_inside))
    met = met.withColumn("depth", F.col("starts_at") + F.coalesce(F.sum("delta").over(_earlier("f", "b")), F.lit(0)))
    at = F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark == "]", -1).otherwise(1)
        return F.struct(now.alias("now"), F.least(state["least"], now).alias("least"))

    within = F.aggregate(F.filter(F.split("shape", ""), lambda c: c != ""), at, step)["least"]
    after = F.col("depth") + F.col("delta")
    return met.select(
        "f", "b", "i", "value", "base", F.least(F.col("depth") + within, after).alias("low"), (~ends_inside & (after == F.col("base"))).cast("int").alias("cut")
    )


def _wanted(frame: list[tuple[int, str]], base: int, name: str) -> tuple[dict[int, str], int, int]:
    """Of the pieces in which a document is not just elements: their text within the array, and its first and last piece."""
    try:
        json.loads("".join(text for _, text in frame))
    except ValueError as error:
        raise BrokenDocument from error
    depth, key, held, found, first, last = 0, None, False, {}, None, None
    for number, text in frame:
        begin = 0
        for mark in _TOKEN.finditer(text):
            token = mark[0]
            if token in "{[":
                if token == "[" and depth == base - 1 and (base == 1 or key == name):
                    held, begin, found, first = True, mark.end(), {}, number
                elif token == "{" and depth == 1 and base == 2 and key == name:
                    first = None  # the same key again, with no array
                depth += 1
            elif token in "}]":
                depth -= 1
                if held and depth == base - 1:
                    held, last, found[number] = False, number, text[begin : mark.start()]
            elif token == ",":
                key = None if depth == 1 else key
            elif depth == 1:
                key = json.loads(token)
        if held:
            found[number] = text[begin:]
    if first is None:
        raise MissingArray
    return found, first, last


def elements_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(entry_ord, entry)``: elements of the array that each document is, or holds as ``name``, with their places.

    A document is read in splits. Running sums tell which braces end an element; only the sums of whole splits and what is
    neither in an element nor between two (keys, edges of arrays) pass through the driver.
    """
    root = f"{shared_folder(spark)}/elements-{uuid.uuid4().hex}"
    sizes = {r.path: r.length for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()}
    segments = _segments(spark, path, f"{root}/shaped")
    plain = {re.sub(r"^file:/+", "/", f): n for f, n in sizes.items()}
    names = {r.f: plain[re.sub(r"^file:/+", "/", r.f)] for r in segments.select("f").distinct().collect()}
    rows, closed = _starts(segments, names)
    starts = spark.createDataFrame(rows, "f string, b bigint, starts_inside int, starts_at bigint, base int")
    marked = _cut(segments, starts)
    marked.withColumn("before", F.coalesce(F.sum("cut").over(_earlier("f", "b")), F.lit(0))).drop("base").write.parquet(f"{root}/segments")
    marked = spark.read.parquet(f"{root}/segments")
    offsets, total = [], {}
    for row in sorted(marked.groupBy("f", "b").agg(F.sum("cut").alias("n")).collect(), key=lambda r: (r.f, r.b)):
        offsets.append((row.f, row.b, total.get(row.f, 0)))
        total[row.f] = total.get(row.f, 0) + row.n
    base = {f: n for f, _, _, _, n in rows}
    ends = [(f, total[f], base[f]) for f in total]
    numbered = marked.join(F.broadcast(spark.createDataFrame(offsets, "f string, b bigint, offset bigint")), ["f", "b"])
    pieces = numbered.groupBy("f", (F.col("offset") + F.col("before")).alias("g")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "i", "value"))), lambda s: s["value"]), "}").alias("text"), F.min("low").alias("low")
    ).join(F.broadcast(spark.createDataFrame(ends, "f string, last bigint, base int")), "f")
    braced = (F.col("g") < F.col("last")) | F.col("f").isin(*closed)
    pieces = pieces.withColumn("text", F.concat("text", F.when(braced, "}").otherwise("")))
    edge = (F.col("g") == 0) | (F.col("g") == F.col("last")) | (F.col("low") < F.col("base"))
    framing = pieces.filter(edge).select("f", "g", "text")
    held, chars = framing.select(F.length("text").alias("n")).limit(FRAME_PIECES + 1).agg(F.count(F.lit(1)), F.sum("n")).first()
    if held > FRAME_PIECES or chars > FRAME_CHARS:
        raise MissingArray
    frames: dict[str, list] = {}
    for row in sorted(framing.collect(), key=lambda r: (r.f, r.g)):
        frames.setdefault(row.f, []).append((row.g, row.text))
    edges, spans = [], []
    for f, frame in frames.items():
        found, first, last = _wanted(frame, base[f], name)
        edges += [(f, g, text, first) for g, text in found.items()]
        spans.append((f, first, last))
    inner = pieces.filter(~edge).join(F.broadcast(spark.createDataFrame(spans, "f string, first bigint, until bigint")), "f").filter("g > first and g < until")
    every = inner.select("f", "g", "text", "first").unionByName(spark.createDataFrame(edges, "f string, g bigint, text string, first bigint"))
    later, blank = F.col("g") > F.col("first"), F.col("text").rlike(r"\A\s*\z")
    parsed = F.try_parse_json(F.concat(F.lit("["), F.when(later, F.regexp_replace("text", r"\A\s*,", "")).otherwise(F.col("text")), F.lit("]")))
    parsed = F.when(~later | blank | F.col("text").rlike(r"\A\s*,"), F.try_variant_get(parsed, "$", "array<variant>"))
    every.select("f", "g", parsed.alias("entries")).write.parquet(f"{root}/elements")
    read = spark.read.parquet(f"{root}/elements").withColumn("cell", F.floor(F.col("g") / CELL))
    before, sums = [], {}
    for row in sorted(read.groupBy("f", "cell").agg(F.sum(F.size("entries")).alias("n"), F.count_if(F.col("entries").isNull()).alias("broken")).collect(), key=lambda r: (r.f, r.cell)):
        if row.broken:
            raise BrokenDocument
        before.append((row.f, row.cell, sums.get(row.f, 0)))
        sums[row.f] = sums.get(row.f, 0) + row.n
    placed = read.join(F.broadcast(spark.createDataFrame(before, "f string, cell bigint, at bigint")), ["f", "cell"])
    own = F.coalesce(F.sum(F.size("entries")).over(_earlier("f", "cell", order="g")), F.lit(0))
    placed = placed.select((F.col("at") + own).alias("at"), "entries")
    return placed.select("at", F.posexplode("entries").alias("pos", "entry")).select("entry", (F.col("at") + F.col("pos")).alias("entry_ord"))
