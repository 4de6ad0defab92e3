"""Best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import WORD

#: Documents packed together; a bin never spans two blocks.
BLOCK_ROWS = 4096
OUT = "piece int, piece_start bigint, piece_words bigint, bin bigint, bin_start bigint"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source, cluster), largest first.

    Open bins are kept in order of what room is left. The search starts at the tightest bin that
    the item fits and goes on to the next wider one until neither bitmap of the bin holds the item's
    source or cluster; only if all of them do, a bin is opened.
    """
    room: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    placed = [(0, 0)] * len(items)
    for at in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[at]
        s, c = 1 << source, 1 << cluster
        i = bisect_left(room, (size, -1))
        while i < len(room) and (sources[room[i][1]] & s or clusters[room[i][1]] & c):
            i += 1
        if i < len(room):
            left, bin_ = room.pop(i)
        else:
            left, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[bin_] |= s
        clusters[bin_] |= c
        placed[at] = (bin_, capacity - left)
        insort(room, (left - size, bin_))
    return placed


def _pack(table, capacity: int):
    import pyarrow as pa

    table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("row", "ascending")])
    block = table.column("block")[0].as_py() if table.num_rows else 0
    bits: tuple[dict, dict] = ({}, {})
    rows, items, pieces = [], [], []
    columns = (table.column(c).to_pylist() for c in ("n_words", "source", "cluster"))
    for row, (words, source, cluster) in enumerate(zip(*columns, strict=True)):
        s, c = bits[0].setdefault(source, len(bits[0])), bits[1].setdefault(cluster, len(bits[1]))
        for piece in range(max(1, -(-words // capacity))):
            start = piece * capacity
            rows.append(row)
            pieces.append((piece, start, min(capacity, words - start)))
            items.append((pieces[-1][2], s, c))
    placed = best_fit(items, capacity)
    out = table.select(["doc_id", "source", "cluster", "n_words"]).take(pa.array(rows, pa.int64()))
    for name, kind, values in (
        ("piece", pa.int32(), [p[0] for p in pieces]), ("piece_start", pa.int64(), [p[1] for p in pieces]),
        ("piece_words", pa.int64(), [p[2] for p in pieces]), ("bin", pa.int64(), [(block << 32) + b for b, _ in placed]),
        ("bin_start", pa.int64(), [o for _, o in placed]),
    ):
        out = out.append_column(name, pa.array(values, kind))
    return out


def pack_documents(
    docs: DataFrame, capacity: int = 1024, key: str = "doc_id", source: str = "source", text: str = "text",
    cluster: Column | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per piece of a document: its bin and its place there, in words.

    No bin holds two documents of one source or one duplicate cluster (default: equal texts).
    A longer text is cut at ``capacity`` words; the pieces conflict with each other like copies.
    Documents are dealt evenly into blocks by row, whatever source or cluster is hot, and each block
    is packed by itself: the blocks grow in number with the data, not in size.

    A null text has no words and takes a place of size 0; null sources conflict with each other, and so do
    null texts; repeated rows are packed one by one; an empty table gives no rows.
    """
    rows = docs.count()
    blocks = max(1, -(-rows // block_rows))
    body = F.col(text)
    narrow = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.xxhash64(body) if cluster is None else cluster).alias("cluster"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "source", "cluster", "n_words")) + ", " + OUT
    return narrow.groupBy("block").applyInArrow(lambda t: _pack(t, capacity), schema)
