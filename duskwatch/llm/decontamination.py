"""Copies of test items in training texts: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import LOWER, arrow_map, settled
from duskwatch.llm.jaccard import small_side

#: Items, and bytes of their texts, handled in one pass over the texts; more items take more passes, never more memory.
PACK_ITEMS, PACK_BYTES = 20_000, 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item, text) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of two arrays of word codes, places in ``text``."""
    score, end = _best(item, text)
    if not score:
        return 0, 0, 0
    _, back = _best(item[::-1], text[:end][::-1])
    return score, end - back, end


def _best(item, text) -> tuple[int, int]:
    import numpy as np

    steps = np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, dtype=np.int64)
    best, end = 0, 0
    for code in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(text == code, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - GAP * steps) + GAP * steps  # gaps in the item, in one sweep
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


class Items:
    """A pack of test items as word codes, and where their n-grams stand."""

    def __init__(self, rows: list[tuple], width: int):
        import numpy as np

        vocabulary: dict[bytes, int] = {}
        self.ids, self.codes = [], []
        for item_id, text in rows:
            words = (text or "").encode().translate(LOWER).split()
            if words:
                self.ids.append(item_id)
                self.codes.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64))
        self.vocabulary, self.width = vocabulary, width
        #: Per width: sorted distinct grams; per gram its (item, place) pairs.
        self.grams: dict[int, np.ndarray] = {}
        self.places: dict[int, list[list[tuple[int, int]]]] = {}
        found: dict[int, dict[int, list]] = {}
        for i, codes in enumerate(self.codes):
            w = min(width, len(codes))
            for at, gram in enumerate(self.of(codes, w).tolist()):
                found.setdefault(w, {}).setdefault(gram, []).append((i, at))
        for w, grams in found.items():
            order = sorted(grams)
            self.grams[w] = np.array(order, dtype=np.int64)
            self.places[w] = [grams[g] for g in order]

    def of(self, codes, width: int):
        """The gram of every run of ``width`` codes; negative where a word is in no item."""
        n = len(codes) - width + 1
        base = len(self.vocabulary) + 1
        total, known = codes[:n].copy(), codes[:n] >= 0
        for i in range(1, width):
            total = total * base + codes[i : n + i]
            known &= codes[i : n + i] >= 0
        # Past 64 bits numbers wrap; grams that then share one only bring a few more places to align.
        total &= (1 << 63) - 1
        total[~known] = -1
        return total

    def coded(self, text: str):
        import numpy as np

        words = text.encode().translate(LOWER).split()
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def hits(self, codes, width: int):
        """(place in codes, number of the gram) of every gram of an item."""
        import numpy as np

        if len(codes) < width:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        grams = self.of(codes, width)
        at = np.flatnonzero(grams >= 0)
        known = self.grams[width]
        number = np.searchsorted(known, grams[at])
        number[number == len(known)] = 0
        same = known[number] == grams[at]
        return at[same], number[same]

    def per_item(self) -> dict[int, set[tuple[int, int]]]:
        """The distinct grams (width, number) of each item."""
        out: dict[int, set[tuple[int, int]]] = {}
        for w, places in self.places.items():
            for number, spots in enumerate(places):
                for i, _ in spots:
                    out.setdefault(i, set()).add((w, number))
        return out

    def seeds_needed(self, least: float) -> dict[int, int]:
        """How many of its grams an item must keep so that every copy of similarity ``least`` still holds one.

        As many as such a copy can lack, and one more: it may have lost the grams of its edits, ``width`` each, or all outside
        of a part of the item that is copied whole.
        """
        needed = {}
        for i, grams in self.per_item().items():
            n = len(self.codes[i])
            edits = int(2 * n * (1 - least) / (MATCH - MISMATCH))
            part = max(0, -int(-least * n // 1) - self.width + 1)
            needed[i] = max(self.width * edits, len(grams) - part) + 1
        return needed

    def keep_rare(self, counts: dict[int, dict[int, int]], needed: dict[int, int]) -> None:
        """Leave each item its rarest grams as seeds, as many as it needs; those that no document holds take no place."""
        seeds = set()
        for i, grams in self.per_item().items():
            held = sorted((n, w, number) for w, number in grams if (n := counts.get(w, {}).get(number, 0)))
            seeds.update((i, w, number) for _, w, number in held[: needed[i]])
        for w, places in self.places.items():
            self.places[w] = [[s for s in spots if (s[0], w, number) in seeds] for number, spots in enumerate(places)]


def _packs(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    pack, held = [], 0
    for row in items.toLocalIterator():
        pack.append(tuple(row))
        held += len(row[1] or "")
        if len(pack) == size or held >= PACK_BYTES:
            yield pack
            pack, held = [], 0
    if pack:
        yield pack


def _count(shared):
    """Per batch of texts: how many of its documents hold each gram."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        pack = shared.value
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    codes = pack.coded(text)
                    for w in pack.grams:
                        seen.update((w, n) for n in set(pack.hits(codes, w)[1].tolist()))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["width", "number", "docs"],
        )

    return run


def _score(shared, least: float):
    import numpy as np

    def found(text: str, pack: Items) -> list[dict]:
        codes = pack.coded(text)
        starts: dict[int, set[int]] = {}
        for w, places in pack.places.items():
            for at, number in zip(*(x.tolist() for x in pack.hits(codes, w)), strict=True):
                for item, place in places[number]:
                    starts.setdefault(item, set()).add(at - place)
        out = []
        for item, begun in starts.items():
            wanted = pack.codes[item]
            best = (0, 0, 0)
            exact = next((b for b in sorted(begun) if b >= 0 and (codes[b : b + len(wanted)].tolist() == wanted.tolist())), None)
            if exact is not None:
                best = (MATCH * len(wanted), exact, exact + len(wanted))
            else:
                order, group = sorted(begun), []
                pad = len(wanted) // 3 + 2
                for b in [*order, None]:  # seeds far from each other are aligned apart
                    if group and (b is None or b - group[-1] > len(wanted)):
                        lo, hi = max(0, group[0] - pad), group[-1] + len(wanted) + pad
                        # A score this high needs so many words of the item at least.
                        if np.isin(codes[lo:hi], wanted).sum() >= least * len(wanted):
                            score, start, end = align(wanted, codes[lo:hi])
                            best = max(best, (score, lo + start, lo + end), key=lambda x: (x[0], -x[1]))
                        group = []
                    if b is not None:
                        group.append(b)
            similarity = best[0] / (MATCH * len(wanted))
            if similarity >= least:
                out.append({"item": item, "similarity": similarity, "start": best[1], "end": best[2]})
        return sorted(out, key=lambda r: r["item"])

    def run(texts: list[str | None]) -> list:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("item", pa.int32()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array([found(t, shared.value) if t else [] for t in texts], kind)]

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    width: int = 3, least: float = 0.5,
) -> DataFrame:
    """(document, item) pairs where the text holds the item or an edited copy of it, and where (in words).

    Seeds are each item's rarest word n-grams, rarity counted over all documents: as many as a copy at ``least`` can lack and one more,
    which for a ``least`` near one half is all that occur. Wherever one stands in a text,
    the item is aligned with the words around it: 2 for a match, -1 for a mismatch or a gap. The similarity is the
    score against that of the item itself; ``least`` and more are returned. Each item keeps
    seeds however frequent its n-grams are, so an item that many documents hold is found in all of them.

    The items travel to the tasks in packs of at most 20,000 and about 16 MB, each its own pass over the texts; texts stay
    where they are. Null or empty texts and items match nothing; repeated rows each get their pairs;
    items with equal text are all returned; empty tables give no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    made = "found array<struct<item:int,similarity:double,start:bigint,end:bigint>>"
    out = None
    for rows in _packs(items.select(item_key, item_text), PACK_ITEMS):
        pack = Items(rows, width)
        if not pack.ids:
            continue
        shared = spark.sparkContext.broadcast(pack)
        needed = pack.seeds_needed(least)
        if any(needed[i] < len(grams) for i, grams in pack.per_item().items()):  # else all are seeds, and nobody needs to count
            totals = (
                narrow.select("text").mapInArrow(_count(shared), "width int, number bigint, docs bigint")
                .groupBy("width", "number").agg(F.sum("docs").alias("docs"))
            )
            counts: dict[int, dict[int, int]] = {}
            for row in totals.toLocalIterator():  # one number per n-gram of the pack
                counts.setdefault(row["width"], {})[row["number"]] = row["docs"]
            pack.keep_rare(counts, needed)
            shared = spark.sparkContext.broadcast(pack)
        found = (
            arrow_map(narrow, "text", ["doc_id"], f"doc_id {kind}, {made}", _score(shared, least))
            .select("doc_id", F.explode("found").alias("f"))
        )
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(pack.ids)], _ids_schema(item_kind))
        part = found.join(F.broadcast(ids), F.col("f.item") == F.col("number")).select(
            "doc_id", "item_id", F.round("f.similarity", 6).alias("similarity"), F.col("f.start").alias("start_word"), F.col("f.end").alias("end_word")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return narrow.limit(0).select("doc_id", F.lit(None).cast(item_kind).alias("item_id"), *[
            F.lit(None).cast(t).alias(n) for n, t in (("similarity", "double"), ("start_word", "bigint"), ("end_word", "bigint"))
        ])
    return out


def _ids_schema(kind):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item_id", kind)])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Rows that repeat a key go together; rows with a null key stay.
    """
    gone = settled(contaminated(docs, items, key, text, **rules).select("doc_id").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"))
    return rows.join(small_side(gone), "doc_id", "left_anti").select("row.*")
