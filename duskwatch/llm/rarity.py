"""How often hashed items occur in a corpus, in a table of fixed size; a global order from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duskwatch.llm.common import pieces

#: Cells of the table. Items that share a cell share a count: the order stays the same for everybody,
#: which is all that an exact prefix filter needs; counts only decide how selective the filter is.
CELLS = 1 << 20
RANGES = 64


def cell_counts(docs: DataFrame, text: str, items=None, of_column=None):
    """Occurrences per cell of ``items(text) -> uint64 array`` over all rows, as an int64 numpy array.

    ``of_column`` gives the items of a whole Arrow column of texts instead.

    Every task adds up its own rows and sends one array per range of cells; ranges are summed
    in parallel as they stream in. The result holds ``CELLS`` numbers, however large the corpus is.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        total = np.zeros(CELLS, dtype=np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole, 0)):
            found = [of_column(batch.column(0))] if of_column else [items(value) for value in batch.column(0).to_pylist() if value]
            if found:
                cells = np.concatenate(found) & np.uint64(CELLS - 1)
                total += np.bincount(cells.astype(np.int64), minlength=CELLS)
        parts = total.reshape(RANGES, -1)
        used = [i for i in range(RANGES) if parts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[i] for i in used], pa.list_(pa.int64()))], names=["part", "counts"]
        )

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = counts.values.to_numpy()
                sums[part] = sums[part] + values if part in sums else values.copy()
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([sums[k] for k in keys], pa.list_(pa.int64()))], names=["part", "counts"]
        )

    schema = "part int, counts array<bigint>"
    rows = docs.select(text).mapInArrow(count, schema).repartition(RANGES, "part").mapInArrow(add, schema).toArrow()
    out = np.zeros((RANGES, CELLS // RANGES), dtype=np.int64)
    for part, counts in zip(rows.column("part").to_pylist(), rows.column("counts"), strict=True):
        out[part] = counts.values.to_numpy()
    return out.reshape(-1)


def ranks(counts):
    """The counts as one byte each, log-scaled: what tasks order their items by, a megabyte in all."""
    import numpy as np

    return np.minimum(np.round(np.log2(counts + 1.0) * 6), 255).astype(np.uint8)


def by_rarity(items, rank):
    """``items`` with the rarest first, ties by hash: the same order in every document."""
    import numpy as np

    return items[np.lexsort((items, rank[(items & np.uint64(CELLS - 1)).astype(np.int64)]))]
