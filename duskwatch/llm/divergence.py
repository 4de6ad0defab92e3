"""How far the sources of a language diverge in the terms they use: chi-square sums, in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import pieces, scratch, settled
from duskwatch.plans.joins import salted_join

#: Letters of a term stay, A-Z in small; every other ASCII character parts terms.
TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Shares are counted in parts of this; divided in two steps so that counts up to 10^14 stay within 64 bits.
PARTS = 1_000_000_000
#: What a task holds before it hands on: entries of counters, bytes of the texts they come from.
HELD_ENTRIES, HELD_BYTES = 300_000, 128_000_000
#: Entries of the rows of one tree. A larger table of rows makes several trees; their sums add up.
TREE_NODES = 400_000


# --- counts ----------------------------------------------------------------------------------


def _count_terms(batches):
    """Occurrences and documents of each term per group; a row with a null term names a group that occurs."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = size = 0

    def told():
        sizes = [len(n) + 1 for n, _ in groups.values()]
        group = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        terms, counts, docs = [], [], []
        for n, d in groups.values():
            terms += [None, *n]
            counts += [0, *n.values()]
            docs += [0, *map(d.__getitem__, n)]
        names = [pa.array([key[i] for key in groups], pa.string()).take(group) for i in range(2)]
        return pa.RecordBatch.from_arrays(
            [*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    for whole in batches:
        for batch in pieces(whole, 2):
            texts = batch.column(2).cast("binary").to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                words = text.translate(TERM_BYTES).split()
                n.update(words)
                d.update(set(words))
                entries += len(n) - before
                size += len(text)
            if entries >= HELD_ENTRIES or size >= HELD_BYTES:
                yield told()
                groups.clear()
                entries = size = 0
    if groups:
        yield told()


def term_counts(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, source, term, n, docs), each term's rows in one partition.

    Counted per task first, so a hot group or term is a few rows a task.
    """
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    narrow = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    told = narrow.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    return told.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares and their distance -------------------------------------------------------------------


def _share(count: Column, total: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / total), exact."""
    return F.lit(1) + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- the tree --------------------------------------------------------------------------------------


class TermTree:
    """A frequent-pattern tree: a path from the root is the sources that use a term, in order, each with its share.

    Rows that begin alike share their nodes; ``many`` counts the rows through a node. A node and one of its
    ancestors stand for the same pair of shares in all those rows, so the pair is worked out once for them all.

    ``sizes``: entries of each row; ``source`` and ``share``: the entries of all rows one after another; ``times``: how often
    each row occurs; ``base``: each source's share of a term it does not use. Rows come in order, so that those
    that begin alike follow each other; all of them are inserted at once.
    """

    def __init__(self, sizes, source, share, times, base):
        import numpy as np

        self.base = base
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.arange(len(source)) - (ends - sizes)[row]
        # The entry at the same depth of the row before, and the first depth where the two rows differ.
        before = np.where(row > 0, (ends - sizes)[row - 1] + depth, 0)
        same = (row > 0) & (depth < sizes[row - 1])
        same &= (source == source[before]) & (share == share[before])
        differ = np.minimum.reduceat(np.where(same, sizes[row], depth), ends - sizes) if len(sizes) else depth
        new = depth >= differ[row]
        # An entry that makes no node of its own goes through the last one made at its depth.
        order = np.lexsort((row, depth))
        made = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
        maker = np.empty(len(order), dtype=np.int64)
        maker[order] = order[made]
        number = np.cumsum(new)
        node = number[maker]
        at = np.flatnonzero(new)
        self.parent = np.r_[-1, np.where(depth[at] > 0, node[at - 1], 0)]
        self.source, self.share = np.r_[-1, source[at]], np.r_[0, share[at]]
        self.many = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(self.many, node, times[row])

    def corrections(self):
        """(pairs as source * sources + other, sums): what rows that hold both add to those of terms only one uses."""
        import numpy as np

        base, width = self.base, len(self.base)
        f = lambda p, q: (p - q) * (p - q) // q
        pairs, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        node = np.arange(1, len(self.parent))
        above = self.parent[node]
        while (inner := above > 0).any():
            node, above = node[inner], above[inner]
            for a, b in ((node, above), (above, node)):
                s, o, p, q = self.source[a], self.source[b], self.share[a], self.share[b]
                p0, q0 = base[s], base[o]
                value = self.many[node] * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
                pairs, at = np.unique(np.r_[pairs, s * width + o], return_inverse=True)
                total = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(total, at, np.r_[sums, value])
                sums = total
            above = self.parent[above]
        return pairs, sums


def _tree_sums(batches):
    """Rows (lang, path, many) in order; a tree per language and run of rows."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        langs = batch.column(0).to_pylist()
        offsets = batch.column(1).offsets.to_numpy()
        entries = batch.column(1).values
        times = batch.column(2).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(langs):
            end = start + 1
            while end < len(langs) and langs[end] == langs[start] and offsets[end + 1] - offsets[start] <= TREE_NODES:
                end += 1
            lo, hi = int(offsets[start]), int(offsets[end])
            named = entries.field("source").slice(lo, hi - lo).dictionary_encode()
            source = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            share, own = (entries.field(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
            base = np.zeros(len(named.dictionary), dtype=np.int64)
            base[source] = own
            pairs, sums = TermTree(np.diff(offsets[start : end + 1]).astype(np.int64), source, share, times[start:end], base).corrections()
            name = lambda i: named.dictionary.take(pa.array(i))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[start]] * len(pairs), pa.string()), name(pairs // max(len(base), 1)), name(pairs % max(len(base), 1)), pa.array(sums),
                ],
                names=["lang", "source", "item", "value"],
            )
            start = end


def pair_values(used: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every source of a language from every other one of it.

    A term that neither of two sources uses gives the same for all such terms; one that only one of them uses gives what
    depends on that source's share alone, taken from a histogram of shares; only terms that both use meet, in the tree.
    """
    g = groups.select("lang", "source", "terms", "p0")
    other = g.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    none = _distance(F.col("p0"), F.col("q0"))
    pairs = salted_join(g, other, ["lang"], "inner", spread=["source"]).filter("source <> item")
    resting = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * none).otherwise(0).alias("value"))
    shares = used.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("many"))
    single = salted_join(shares, other, ["lang"], "inner", spread=["source", "p"]).filter("source <> item")
    gained = single.groupBy("lang", "source", "item").agg(
        F.sum((F.col("many") * (_distance(F.col("p"), F.col("q0")) - none)).cast("decimal(38,0)")).alias("here"),
        F.sum((F.col("many") * (_distance(F.col("q0"), F.col("p")) - _distance(F.col("q0"), F.col("p0")))).cast("decimal(38,0)")).alias("there"),
    )
    gained = settled(gained, "single-sums")
    entry = F.struct("source", "p", "p0")
    rows = used.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("path")).filter(F.size("path") > 1)
    paths = settled(rows.groupBy("lang", "path").agg(F.count("*").alias("many")), "term-paths")
    # Rows that begin alike meet in one task and follow each other; what begins alike elsewhere only costs shared nodes.
    ordered = paths.repartition("lang", F.slice("path", 1, 3)).sortWithinPartitions("lang", "path")
    shared = ordered.mapInArrow(_tree_sums, "lang string, source string, item string, value bigint")
    columns = lambda df, *c: df.select("lang", *c, F.col("value").cast("decimal(38,0)").alias("value"))
    every = (
        columns(resting, "source", "item")
        .union(gained.select("lang", "source", "item", "here"))
        .union(gained.select("lang", "item", "source", "there"))
        .union(columns(shared, "source", "item"))
    )
    return every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit_sources(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, best_terms: int = 200,
) -> DataFrame:
    """Per source of a language: how far it is from each other source, and its most telling terms.

    Terms are runs of ASCII letters and other characters beyond ASCII, A-Z in small; a language keeps those in at
    least ``least_docs`` of its documents. A source or a language gives a kept term the share 1 + floor(10^9 (count + 1)
    / (all counts + kept terms)); the distance of shares p and q is floor((p - q)^2 / q). Rows of part ``pair`` hold the sum of
    distances over all kept terms, for every other source; those of part ``term`` the ``best_terms`` terms that
    the source uses more than its language. All numbers are whole and exact.

    Null text, lang and source are empty ones. A document without terms still makes its source occur; with no kept term every
    pair has value 0. Repeated rows are documents of their own. Equal values are ranked by item. An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        of_term = Window.partitionBy("lang", "term")
        counts = term_counts(docs, F.col(lang), F.col(source), F.col(text)).select(
            "lang", "source", "term", "n", F.sum("n").over(of_term).alias("all"), F.sum("docs").over(of_term).alias("docs"),
            (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"),
        )
        # A row without a term says that its source occurs.
        counts = settled(counts.filter((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs"), "term-counts")
        kept = counts.filter("term is not null")
        langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        size = F.col("total") + F.col("terms")
        groups = settled(
            groups.fillna(0, ["terms", "total", "lang_total"])
            .withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), size)).otherwise(1))
            .withColumn("q_size", F.col("lang_total") + F.col("terms")),
            "groups",
        )
        used = kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "p0", _share(F.col("n"), size).alias("p"), _share(F.col("all"), F.col("q_size")).alias("q")
        )
        used = settled(used, "shares")
        pairs = pair_values(used.drop("q"), groups)
        telling = used.filter("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
        part = lambda df, name: df.withColumn("rank", rank).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
        return keep(part(pairs, "pair").union(part(telling, "term").filter(F.col("rank") <= best_terms)), "source-divergence")
