"""Documents with like sets of word n-grams: a sparse matrix product, column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import LOWER, WordHashes, arrow_map, scratch, settled, windows
from duskwatch.llm.links import components
from duskwatch.llm.rarity import CELLS, by_rarity, cell_counts, ranks

#: Tables of up to so many rows of a few numbers each are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Pairs of least hashes that near copies are first brought together by.
GLANCES = 4


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a stored table of narrow rows, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingle_maker(width: int):
    """Of a text: its words in small letters, and the distinct hashes of its word n-grams."""
    hashes = WordHashes()

    def make(text: str):
        import numpy as np

        words = text.encode().translate(LOWER).split()
        if not words:
            return words, np.zeros(0, dtype=np.uint64)
        return words, np.unique(windows(hashes.of(words), width))

    return make


def _least_pairs(items) -> list[int]:
    """Hashes of two least members under two mixings each: equal for most sets that share four fifths."""
    import numpy as np

    from duskwatch.llm.common import mixed

    least = [int(mixed(items ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min()) for i in range(1, 2 * GLANCES + 1)]
    return [hash((i, least[2 * i], least[2 * i + 1])) for i in range(GLANCES)]


def commonness(items, rank) -> int:
    """How frequent a set's members are on the whole: among edited copies, the original has the highest."""
    import numpy as np

    return int(1000 * rank[(items & np.uint64(CELLS - 1)).astype(np.int64)].mean())


def _rows(width: int, rank_of, percent: int):
    import numpy as np

    def run(texts: list[str | None]) -> list:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        rank, make = rank_of.value, shingle_maker(width)
        keys, sizes, prefixes, glances, common = [], [], [], [], []
        for text in texts:
            words, items = make(text or "")
            n = len(items)
            sizes.append(n)
            if not n:
                keys.append(None)
                prefixes.append(None)
                glances.append(None)
                common.append(None)
                continue
            keys.append(xxh64_intdigest(b" ".join(words)) - (1 << 63))
            prefix = by_rarity(items, rank)[: n - -(-percent * n // 100) + 1]
            prefixes.append(prefix.view(np.int64))
            glances.append(_least_pairs(items))
            common.append(commonness(items, rank))
        return [
            pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
            pa.array(glances, pa.list_(pa.int64())), pa.array(common, pa.int32()),
        ]

    return run


def _full(width: int):
    import numpy as np

    def run(texts: list[str | None]) -> list:
        import pyarrow as pa

        make = shingle_maker(width)
        return [pa.array([make(t or "")[1].view(np.int64) for t in texts], pa.list_(pa.int64()))]

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 x overlap >= percent x union, counted over the whole sets."""
    left, right = (sets.select(F.col("key").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    overlap = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - overlap
    return pairs.join(left, "a").join(right, "b").filter(100 * overlap >= percent * union).select("a", "b")


def _fetch(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, have: DataFrame | None = None) -> DataFrame:
    """The whole sets of the documents in ``pairs``, read again from their texts."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    if have is not None:
        wanted = wanted.join(have.select("key"), "key", "left_anti")
    wanted = settled(wanted.join(reps.select("key", "doc_id"), "key"), "wanted")
    texts = docs.join(small_side(wanted), "doc_id").select("key", "text")
    kinds = "key bigint, items array<bigint>"
    return settled(arrow_map(texts, "text", ["key"], kinds, _full(width)).dropDuplicates(["key"]), "sets")


def _bounded(n_a: Column, n_b: Column, percent: int) -> Column:
    """The least overlap that two sets of these sizes need."""
    return F.ceil(percent * (n_a + n_b) / F.lit(100 + percent))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: the size of its n-gram set and its component under Jaccard >= ``percent`` / 100.

    The documents by n-grams matrix is multiplied with its transpose over a part of its columns: each
    document keeps its rarest n-grams, as many as one of two like sets must share one of. Overlap counts are
    added up per pair, and pairs are dropped where the count and what the rest of both sets could still
    add stay below the bound that the sizes give. Pairs left are counted over the whole sets.

    Nothing is multiplied that is known to be one: equal word sequences are one row of the matrix
    (hot groups of copies are one row too), near copies that a pair of least hashes brings together
    are compared with the most typical of their group, and what that links is one component; columns held by one
    component are dropped, in the others only rows of different components meet. So a group of
    copies costs its size, not the square of it, and no link between components is lost.

    Null texts and texts without words have size 0 and stay by themselves; repeated rows are copies; rows
    with a null key get component null and link nobody. Hashes have 64 bits.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_components_of(docs, key, text, width, percent), "near-duplicates")


def _components_of(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    make = shingle_maker(width)
    rank = spark.sparkContext.broadcast(ranks(cell_counts(narrow, "text", lambda t: make(t)[1])))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key bigint, n bigint, prefix array<bigint>, glances array<bigint>, common int"
    rows = settled(arrow_map(narrow, "text", ["doc_id"], schema, _rows(width, rank, percent)), "sequences")
    reps = settled(
        rows.filter("key is not null and doc_id is not null").groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("glances").alias("glances"),
            F.first("common").alias("common"),
        ),
        "representatives",
    )
    texts = narrow.filter("doc_id is not null")
    # First glance: each row against the one of its group whose n-grams are the most common.
    glances = reps.select("key", "n", "common", F.explode("glances").alias("g"))
    firsts = glances.groupBy("g").agg(F.count("*").alias("many"), F.max(F.struct("common", "key", "n")).alias("f")).filter("many > 1")
    firsts = settled(firsts.select("g", F.col("f.key").alias("b"), F.col("f.n").alias("n_b")), "leaders")
    near = (
        glances.join(firsts, "g")
        .filter((F.col("key") != F.col("b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")))
        .select(F.col("key").alias("a"), "b").distinct()
    )
    near = settled(near, "glanced")
    sets = _fetch(near, reps, texts, width)
    links = settled(_linked(near, sets, percent), "near-links")
    roots = settled(components(links), "roots")
    # The product, between components only.
    placed = reps.select("key", "n", "prefix").join(small_side(roots.withColumnRenamed("node", "key")), "key", "left").select(
        "key", "n", F.coalesce("root", "key").alias("comp"), F.posexplode("prefix").alias("pos", "column")
    )
    mixed_columns = settled(
        placed.groupBy("column").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("column"), "columns"
    )
    entries = settled(placed.join(mixed_columns, "column"), "entries")
    a, b = (entries.select("column", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "comp", "pos")]) for s in "ab")
    need = _bounded(F.col("n_a"), F.col("n_b"), percent)
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    product = (
        a.join(b, "column")
        .filter((F.col("key_a") < F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")))
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        # The first common column of two sets this large stands before these places.
        .filter((F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need))
        # The last common column of the prefixes bounds what is still to come; an earlier one bounds it more loosely.
        .groupBy("key_a", "key_b").agg(
            F.count("*").alias("overlap"), F.min(rest).alias("rest"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
        )
        .filter(F.col("overlap") + F.col("rest") - 1 >= need)
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    )
    product = settled(product, "product")
    more = _fetch(product, reps, texts, width, have=sets)
    found = _linked(product, sets.unionByName(more), percent)
    # Components of all links, named by their smallest document.
    all_links = reduce(DataFrame.unionByName, [links, found])
    final = settled(components(all_links), "components")
    smallest = (
        reps.select("key", "doc_id").join(final.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    )
    named = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_key = settled(smallest.join(named, "root").select("key", "component_id"), "component-of-key")
    own = F.coalesce(F.col("key"), F.xxhash64("doc_id"))  # rows without words must not all meet under null
    return (
        rows.select("doc_id", "n", own.alias("key"), F.col("key").isNull().alias("empty"))
        .join(of_key, "key", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("empty") | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The document with the smallest key of each component, with all its columns.

    Documents without words and rows without a key stay; rows that repeat a key are one document and stay or go together.
    """
    found = near_duplicates(docs, key, text, **rules)
    gone = settled(found.filter("component_id <> doc_id").select("doc_id").distinct(), "later-copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"))
    return rows.join(small_side(gone), "doc_id", "left_anti").select("row.*")
