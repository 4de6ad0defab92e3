"""Near-duplicate lines across documents: an exact set-similarity join on words."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column_words, mixed, pieces, scratch, settled
from duskwatch.llm.jaccard import small_side
from duskwatch.llm.rarity import CELLS, cell_counts, ranks

#: Pairs of least hashes that variants of a line are first brought together by.
GLANCES = 3
#: Numbers of 64 bits in the wide bitmap of a line.
WIDE = 8


def _by_line(line, rare, words):
    """The order by line, rarity and hash."""
    import numpy as np

    if len(line) and line[-1] < 1 << 24:
        # One number holds it all but the lower half of the hash, which hardly ever decides.
        short = line.astype(np.uint64) << np.uint64(40) | rare.astype(np.uint64) << np.uint64(32) | words >> np.uint64(32)
        order = np.argsort(short)
        short, sorted_words = short[order], words[order]
        if not ((short[1:] == short[:-1]) & (sorted_words[1:] != sorted_words[:-1])).any():
            return order
    return np.lexsort((words, rare, line))


class LineSets:
    """The word sets of all lines of a column of texts, as flat arrays: words of one line stand together, the rarest first."""

    def __init__(self, texts, rank=None):
        import numpy as np

        words, rows, lines = column_words(texts)
        begins = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1])]) if len(words) else np.zeros(0, dtype=np.int64)
        self.rows, self.numbers = rows[begins], lines[begins].astype(np.int32)  # of the column; of the line in its text
        line = np.repeat(np.arange(len(begins), dtype=np.int64), np.diff(np.r_[begins, len(words)]))
        rare = np.zeros(len(words), dtype=np.uint8) if rank is None else rank[(words & np.uint64(CELLS - 1)).astype(np.int64)]
        order = _by_line(line, rare, words)
        words, line = words[order], line[order]
        first = np.r_[True, (words[1:] != words[:-1]) | (line[1:] != line[:-1])] if len(words) else np.zeros(0, dtype=bool)
        self.items, self.line = words[first], line[first]
        self.n = np.bincount(self.line, minlength=len(begins)).astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n

    def each(self, ufunc, values):
        """One number a line from the values of its words."""
        return ufunc.reduceat(values, self.starts) if len(self.starts) else values

    def ids(self):
        import numpy as np

        return mixed(self.each(np.add, mixed(self.items)) + self.n.astype(np.uint64)).view(np.int64)

    def bitmaps(self):
        """64 bits a line, turned over by its words: two lines differ in no more bits than in words."""
        import numpy as np

        return self.each(np.bitwise_xor, np.uint64(1) << (self.items >> np.uint64(58))).view(np.int64)

    def wide(self):
        """Eight numbers a line, like ``bitmaps`` with 512 bits: still telling where a line has hundreds of words."""
        import numpy as np

        cell = (self.items >> np.uint64(49)).astype(np.int64) & 511
        out = np.zeros(len(self.n) * WIDE, dtype=np.uint64)
        np.bitwise_xor.at(out, self.line * WIDE + (cell >> 6), np.uint64(1) << (cell & 63).astype(np.uint64))
        return out.view(np.int64)

    def glances(self):
        import numpy as np

        least = [self.each(np.minimum, mixed(self.items ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for i in range(1, 2 * GLANCES + 1)]
        pairs = [mixed(least[2 * i] + mixed(least[2 * i + 1] + np.uint64(i))).view(np.int64) for i in range(GLANCES)]
        return np.stack(pairs, axis=1) if pairs else None

    def prefixes(self, percent: int):
        """(words, offsets) of each line's rarest words, as many as one of two like lines must share one of."""
        import numpy as np

        keep = self.n + (-percent * self.n // 100) + 1
        first = np.arange(len(self.items)) - self.starts[self.line] < keep[self.line]
        # Shorter hashes only bring a few more candidates.
        words = (self.items[first] >> np.uint64(33)).astype(np.int32)
        return words, np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)


def _seen(rank_of, percent: int):
    import numpy as np

    def run(batches):
        import pyarrow as pa

        rank = rank_of.value
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            sets = LineSets(batch.column(1), rank)
            words, offsets = sets.prefixes(percent)
            glances = sets.glances().reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(sets.rows)), pa.array(sets.numbers), pa.array(sets.ids()),
                    pa.array(sets.n.astype(np.int32)), pa.array(sets.bitmaps()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words)),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(sets.n) + 1) * GLANCES).astype(np.int32)), pa.array(glances)),
                ],
                names=["doc_id", "line", "set", "n", "bits", "prefix", "glances"],
            )

    return run


def _whole(batches):
    import numpy as np
    import pyarrow as pa

    for batch in (piece for whole in batches for piece in pieces(whole, 0)):
        sets = LineSets(batch.column(0))
        offsets = np.concatenate([[0], np.cumsum(sets.n)]).astype(np.int32)
        eights = np.arange(len(sets.n) + 1, dtype=np.int32) * WIDE
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(sets.ids()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.items.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(eights), pa.array(sets.wide())),
            ],
            names=["set", "items", "wide"],
        )


def _fetch(pairs: DataFrame, classes: DataFrame, texts: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """The word sets of the classes in ``pairs``, read again from the documents that hold them first."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    if have is not None:
        wanted = wanted.join(have.select("id"), "id", "left_anti")
    wanted = settled(wanted.join(classes.select("id", "set", "doc_id"), "id"), "wanted-lines")
    holders = settled(wanted.select("doc_id").distinct(), "wanted-docs")
    lines = texts.join(small_side(holders), "doc_id").select("text").mapInArrow(_whole, "set bigint, items array<bigint>, wide array<bigint>")
    found = lines.join(small_side(wanted.select("set", "id")), "set")
    return settled(found.groupBy("id").agg(F.first("items").alias("items"), F.first("wide").alias("wide")), "line-sets")


def _need(percent: int) -> Column:
    """The least overlap that two sets of n_a and n_b words need."""
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of line sets with Jaccard >= percent / 100.

    Wide bitmaps, a tenth of the sets, drop most of the others; only what is left moves whole sets.
    """
    maps = sets.select("id", F.size("items").alias("n"), "wide")
    left, right = (maps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    differ = reduce(add, [F.bit_count(F.col("wide_a")[i].bitwiseXOR(F.col("wide_b")[i])) for i in range(WIDE)])
    close = settled(
        pairs.join(left, "a").join(right, "b").filter(differ <= F.col("n_a") + F.col("n_b") - 2 * _need(percent)).select("a", "b"), "lines-close"
    )
    wanted = settled(close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct(), "close-lines")
    whole = settled(sets.select("id", "items").join(small_side(wanted), "id"), "close-sets")
    left, right = (whole.select(F.col("id").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    overlap = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - overlap
    return close.join(left, "a").join(right, "b").filter(100 * overlap >= percent * union).select("a", "b")


def later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, line) of every line that is like an earlier one, lines in order of document key and place.

    Two lines are alike if their sets of words, in small ASCII letters, have Jaccard >= ``percent`` / 100. A line
    goes if any earlier line is like it, whether that one stays or not.

    Lines of one set are one class with one first place. Words of a set are ordered by rarity in the corpus; the
    rarest ones, as many as a set and a shorter or longer like one must share one of, are joined. Pairs pass a length filter,
    a positional filter and a 64-bit bitmap that differs in no more bits than the sets do in words;
    then 512-bit ones are compared, and Jaccard is verified on the whole sets. Before that, classes that a pair of
    least hashes brings together are compared with the first of their group: what is like it is
    settled and searches no more, so a large group of variants is not paired out.

    Null and empty texts have no lines; empty lines stay; rows with a null key take no part; repeated
    rows are one document, and its lines go or stay in all of them.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_later(docs, key, text, percent), "later-lines")


def _later(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    rank = docs.sparkSession.sparkContext.broadcast(ranks(cell_counts(narrow, "text", of_column=lambda texts: column_words(texts)[0])))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    seen = settled(
        narrow.mapInArrow(
            _seen(rank, percent),
            f"doc_id {kind}, line int, set bigint, n int, bits bigint, prefix array<int>, glances array<bigint>",
        ),
        "lines-seen",
    )
    firsts = seen.groupBy("set").agg(
        F.min(F.struct("doc_id", "line")).alias("at"), *[F.first(c).alias(c) for c in ("n", "bits", "prefix", "glances")]
    )
    # Sorted by their first places, the classes' numbers are in that order.
    classes = settled(
        firsts.select("set", "at.*", "n", "bits", "prefix", "glances").orderBy("doc_id", "line").withColumn("id", F.monotonically_increasing_id()),
        "line-classes",
    )
    need = _need(percent)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near_enough = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= F.col("n_a") + F.col("n_b") - 2 * need
    side = lambda df, s, *more: df.select(*more, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "bits")])
    # First glance: each class against the earliest of its group.
    glances = classes.select("id", "n", "bits", F.explode("glances").alias("g"))
    leaders = glances.groupBy("g").agg(F.count("*").alias("many"), F.min(F.struct("id", "n", "bits")).alias("f")).filter("many > 1")
    leaders = settled(leaders.select("g", "f.*"), "line-leaders")
    near = settled(
        side(glances, "a", "g").join(side(leaders, "b", "g"), "g")
        .filter((F.col("id_a") != F.col("id_b")) & fits & near_enough).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(),
        "lines-glanced",
    )
    sets = _fetch(near, classes, narrow)
    resolved = settled(_alike(near, sets, percent).select(F.col("a").alias("id")).distinct(), "lines-resolved")
    # The join, by length: of two like sets the longer shares a word of its prefix, the shorter one of a prefix as long
    # as equal lengths would allow. A pair whose later class is settled need not be found.
    marked = classes.select("id", "n", "bits", "prefix").join(small_side(resolved.withColumn("known", F.lit(True))), "id", "left")
    long = marked.select("id", "n", "bits", "known", F.posexplode("prefix").alias("pos", "word"))
    fewest = F.ceil(2 * percent * F.col("n") / F.lit(100 + percent)).cast("int")
    short = marked.select("id", "n", "bits", "known", F.posexplode(F.slice("prefix", 1, F.col("n") - fewest + 1)).alias("pos", "word"))
    packed = lambda df, s: df.select(
        "word", F.col("id").alias(f"id_{s}"), F.col("bits").alias(f"bits_{s}"),
        # Length, place and whether the class is settled as one number.
        (F.shiftleft(F.col("n").cast("long"), 32) + 2 * F.col("pos") + F.coalesce(F.col("known").cast("int"), F.lit(0))).alias(f"at_{s}"),
    )
    met = packed(long, "a").join(packed(short, "b"), "word").filter("id_a != id_b").withColumns(
        {f"n_{s}": F.shiftright(f"at_{s}", 32) for s in "ab"}
        | {f"pos_{s}": F.shiftright(F.col(f"at_{s}").bitwiseAND(0xFFFFFFFF), 1) for s in "ab"}
    )
    later = F.when(F.col("id_a") > F.col("id_b"), F.col("at_a")).otherwise(F.col("at_b"))
    pairs = settled(
        met.filter((F.col("n_a") > F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("id_a") > F.col("id_b")))
        .filter(later.bitwiseAND(1) == 0).filter(fits & near_enough)
        # The first common word of two sets this large stands before these places.
        .filter((F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need))
        .select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct(),
        "line-pairs",
    )
    more = _fetch(pairs, classes, narrow, have=sets)
    joined = _alike(pairs, sets.unionByName(more), percent).select(F.col("a").alias("id"))
    gone = settled(resolved.union(joined).distinct(), "lines-gone").withColumn("gone", F.lit(True))
    judged = classes.select("id", "set", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line")).join(gone, "id", "left")
    return (
        seen.select("doc_id", "line", "set").join(judged, "set")
        .filter(F.col("gone").isNotNull() | (F.col("doc_id") != F.col("first_doc")) | (F.col("line") != F.col("first_line")))
        .select("doc_id", "line").distinct()
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` without later like lines, with all columns; a document may be left with an empty text."""
    gone = settled(later_lines(docs, key, text, percent).groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "later-lines")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("lines", i)), "\n")
    return (
        docs.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text")).join(gone, "doc_id", "left")
        .select(F.col("row").withField(text, F.when(F.col("lines").isNull(), F.col("text")).otherwise(rest)).alias("row"))
        .select("row.*")
    )


def count_later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per row: its lines, how many of them go, and which (from 0)."""
    gone = later_lines(docs, key, text, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    lines = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    return (
        docs.select(F.col(key).alias("doc_id"), F.when(F.col(text).isNull(), 0).otherwise(lines).cast("long").alias("n_lines"))
        .join(gone, "doc_id", "left")
        .select(
            "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"),
        )
    )
