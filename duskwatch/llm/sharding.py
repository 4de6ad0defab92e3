"""Shards from a weighted hash tree: region, rack, shard (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import settled

#: Parts that a shard's rows are numbered in, so that no task has to sort a whole shard.
PARTS = 1024


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks: int = 2) -> tuple[Shard, ...]:
    """A regular tree: racks of ``per_rack`` shards, regions of ``racks`` racks."""
    return tuple(Shard(s, s // (per_rack * racks), s // per_rack) for s in range(shards))


def grow(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region of its own, so that rows move into it and nowhere else."""
    new = (max(s.shard for s in tree) + 1, max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1)
    return (*tree, Shard(*new, weight))


def _children(pairs: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(w)).alias("weight")) for k, w in sorted(pairs.items())])


def _drawn(children: Column, key: Column, level: str) -> Column:
    """The child with the largest ``ln(u) / weight``, u drawn from key, level and child alone.

    A changed weight changes that child's draw only, so rows move to it or from it, never between others.
    """

    def draw(child: Column) -> Column:
        h = F.xxhash64(key, F.lit(level), child["id"])
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.log(u) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return F.array_max(F.transform(children, draw))["id"]


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of a key: one weighted draw among regions, one among its racks, one among its shards.

    Weights of racks and regions are the sums of their shards'. Shards of weight 0 get nothing.
    """
    live = [s for s in tree if s.weight > 0]
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for s in live:
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        inner = racks.setdefault(s.region, {})
        inner[s.rack] = inner.get(s.rack, 0.0) + s.weight
        leaves.setdefault(s.rack, {})[s.shard] = s.weight
    below = lambda level: F.create_map(*[x for k, v in sorted(level.items()) for x in (F.lit(k), _children(v))])
    region = _drawn(_children(regions), key, "region")
    rack = _drawn(below(racks)[region], key, "rack")
    return _drawn(below(leaves)[rack], key, "shard")


def hash_tree_shards(
    docs: DataFrame, tree: tuple[Shard, ...], grown: tuple[Shard, ...], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row's shard, its place in the shard, and its shard in the grown tree.

    Null keys draw like a key of their own; rows that repeat a key share its shard; a null text has
    size 16 and the checksum of no bytes; an empty table gives no rows. Slots number a shard's rows
    from 0 without gaps: rows are numbered inside even parts of the shard, and the parts are offset
    by counts, at most 1024 a shard. Parts are dealt by row, not by key, so a key that holds most
    rows fills them evenly. Only narrow rows are shuffled; texts stay where they are read.
    """
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("part"),
    )
    drawn = narrow.withColumns({
        "shard": shard_of(F.col("doc_id"), tree).cast("int"), "grown_shard": shard_of(F.col("doc_id"), grown).cast("int"),
    })
    rows = settled(drawn, "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "part"])  # at most shards x 1024 rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("offset") + F.col("row")).cast("long").alias("slot"), "grown_shard",
        )
    )
